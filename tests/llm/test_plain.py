"""Language ID and the URL filter's trees against plain versions: sizes, ties, scores, features, cuts and verdicts."""

import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
import zstandard

from newstide.llm import langid, urls

WORDS = {"en": "the house and the river were there with many small birds", "de": "das haus und der fluss waren dort mit vielen kleinen tieren", "fr": "la maison et la rivière étaient là avec beaucoup de petits oiseaux"}


def text_of(lang, i, n):
    words = WORDS[lang].split()
    return " ".join(words[(i * 7 + j * (i + 3)) % len(words)] for j in range(n))


def plain_dict(texts):
    d = zstandard.ZstdCompressionDict(texts, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=6)
    return zstandard.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_dict_id=False)


def plain_language(text, coders):
    """lang_pred, score and rejected; coders in the order in which ties are settled."""
    if text is None or not coders or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    data = " ".join(text.lower().split()).encode()
    total = {}
    for lang, coder in coders.items():
        total[lang], at = 0, 0
        while at < len(data):
            total[lang] += len(coder.compress(data[at : at + 1024]))
            at += 1024
    best = min(total.values())
    first = next(lang for lang in total if total[lang] == best)
    odds = [math.exp(-30 * min((s - best) / len(data), 20)) for s in total.values()]
    others = [s for lang, s in total.items() if lang != first]
    return first, 1 / math.fsum(odds), bool(others) and (min(others) - best) / len(data) < 0.01


def test_languages_against_a_plain_version(spark):
    labelled = [(i, text_of(lang, i, 40), lang) for k, lang in enumerate(WORDS) for i in range(k * 100, k * 100 + 20 + 5 * k)]
    labelled += [(900, labelled[0][1], "en"), (901, None, "en"), (902, "no label", None)]
    dicts = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    assert list(dicts) == ["fr", "de", "en"]  # most labelled rows first
    for lang, data in dicts.items():  # every distinct text once, whatever the order
        texts = {t for _, t, x in labelled if x == lang and t is not None}
        left = data.decode()
        assert len(left) == sum(map(len, texts)) + len(texts) - 1 and all(t in left for t in texts)
    asked = [text_of(lang, 500 + i, 1 + i * 9) for lang in WORDS for i in range(12)] + [text_of("en", 3, 30) + " " + text_of("de", 4, 30), "the " * 4000, "ÉTAIENT\tlà", "x", "12 34", "", None, "   "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    coders = {lang: plain_dict(data) for lang, data in dicts.items()}
    got = {r.doc_id: r for r in langid.identify(docs, dicts).collect()}
    for i, text in enumerate(asked):
        want = plain_language(text, coders)
        assert (got[i].lang_pred, got[i].rejected) == (want[0], want[2]) and got[i].score == pytest.approx(want[1], abs=1e-9), text
    assert {got[i].rejected for i in got if got[i].lang_pred != "und"} == {True, False}


def test_ties_and_languages_with_nothing_to_teach(spark):
    same = [(i, text_of("en", i, 30)) for i in range(6)]
    rows = [(i, t, "b") for i, t in same] + [(i, t, "a") for i, t in same] + [(i + 10, t, "c") for i, t in same] + [(20, "", "c")] + [(30 + i, x, "void") for i, x in enumerate(("", " ", "\n"))]
    docs = spark.createDataFrame([(1, "the river and the birds"), (2, "zzz")], "doc_id long, text string")
    train = lambda which: langid.train(spark.createDataFrame(which, "doc_id long, text string, lang string"))
    got = langid.identify(docs, train(rows)).collect()
    assert all(r.lang_pred in ("a", "b", "c", "void") and 0 <= r.score <= 1 for r in got)
    two = train([r for r in rows if r[2] in "ab"])
    assert list(two) == ["a", "b"] and two["a"] == two["b"]  # as many rows: by name
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs, two).collect()} == {("a", 0.5, True)}
    more = train([r for r in rows if r[2] in "ab"] + [(0, same[0][1], "b")])  # a copy: a row more, the same dictionary
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, more).collect()} == {("b", 0.5)}
    assert {r.lang_pred for r in langid.identify(docs, train([r for r in rows if r[2] == "void"])).collect()} == {"void"}


def tree_of(debug):
    """Nested (feature, threshold, left, right) or a leaf's number from a tree's printed form."""
    lines = [line.strip() for line in debug.splitlines()[1:] if line.strip()]

    def read():
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = read()
        assert lines.pop(0).startswith("Else")
        return int(feature), float(threshold), left, read()

    return read()


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def parts(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else None
    if rest is None:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def suffix_of(host):
    return ".".join(host.split(".")[-3:])


def fold_of(url):
    seed = xxhash.xxh64_intdigest(b"fold", seed=42)
    h = seed if url is None else xxhash.xxh64_intdigest(url.encode(), seed=seed)
    return (h - (1 << 64) if h >> 63 else h) % 3


def features_of(url, suffixes, tops):
    host, path = parts(url)
    s = host + path
    n = max(len(s), 1)
    counts = Counter(s)
    b, k = suffixes.get(suffix_of(host), (0, 0))
    tb, tk = tops.get(host.split(".")[-1], (0, 0))
    return [len(url or ""), len(host), len(host.split(".")), host.count("-"), path.count("/"), sum(c in "0123456789" for c in s) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), len(re.findall(r"[?&][^=&#]+=", url or "")), (b + 0.5) / (k + 2), math.log1p(k), (tb + 0.5) / (tk + 2)]


def test_tree_verdicts_against_a_plain_version(spark, sf):
    rules = [("org", "/", "allow"), ("com", "/de/", "block")]
    given = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    given += [(10**6 + i, f"https://casino-{i}.bets{i % 7}.net/a{i}?x={i}&y=1") for i in range(60)] + [(10**6 + 99, None), (10**6 + 98, "no scheme"), (10**6 + 97, "HTTP://A-B.NET")]
    pages = spark.createDataFrame(given, "page_id long, url string")
    model, _, cut, _ = urls.fit(urls._labelled(pages, rules))
    trees = [(w, tree_of(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    assert any(isinstance(t, tuple) for _, t in trees)

    def ruled(host, path):
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1]))[2] if fit else None

    label, rule = {}, {}
    suffixes, tops = defaultdict(lambda: (0, 0)), defaultdict(lambda: (0, 0))
    for _, url in given:
        host, path = parts(url)
        rule[url] = ruled(host, path)
        label[url] = int(rule[url] == "block") if rule[url] else int(any(w in host for w in urls.BLOCK_WORDS))
        if fold_of(url) == 0:
            for table, key in ((suffixes, suffix_of(host)), (tops, host.split(".")[-1])):
                table[key] = (table[key][0] + label[url], table[key][1] + 1)
    p = {url: 1 / (1 + math.exp(-2 * sum(w * walk(t, features_of(url, suffixes, tops)) for w, t in trees))) for _, url in given}

    held = [(min(int(p[u] * 200), 199), label[u]) for _, u in given if fold_of(u) == 2 and rule[u] is None]
    sizes = Counter(y for _, y in held)
    gain = [round(sum(y for b, y in held if b >= k) / sizes[1] - sum(1 - y for b, y in held if b >= k) / sizes[0], 9) for k in range(201)]
    best = [k for k, g in enumerate(gain) if g == max(gain)]
    assert cut == best[len(best) // 2] / 200

    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert len(got) == len(given)
    for page, url in given:
        assert got[page].p_block == pytest.approx(p[url], abs=1e-9), url
        assert got[page].verdict == (rule[url] or ("block" if p[url] >= cut else "allow")), url
    assert len({got[i].verdict for i, u in given if rule[u] is None}) == 2
