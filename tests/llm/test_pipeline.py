"""The pipeline on the smallest tables, stage by stage and as a whole against plain versions, and on odd tables."""

import itertools
import math
import re
import zlib

import corpus_pipeline
import numpy as np
from newstide.llm import ngram_join, packing, quality, queries, rules
from newstide.llm.common import byte_bpe


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = ids(quality.score(docs).where("kept"))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality classifier"](spark, docs, sf)
    assert one.columns == docs.columns and ids(one) == kept
    one = one.cache()
    two = stages["quality rules"](spark, one, sf)
    assert two.columns == docs.columns and ids(two) == ids(rules.judge(one).where("kept"))
    two = two.cache()
    three = stages["n-gram Jaccard join"](spark, two, sf)
    assert three.columns == docs.columns
    assert ids(three) == ids(ngram_join.jaccard_components(two, 5, 80, 100).where("component_id = doc_id"))
    four = corpus_pipeline.run(spark, sf)
    want = packing.pack(three)
    digest = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(four) == digest(want)


BLANK = r"[\x20\x09-\x0D]+"


def plain_score(text, weights):
    """The scorer over features counted word by word."""
    words = text.split()
    if not words:
        return 0.0
    half = quality.DIMENSIONS // 2
    kind = lambda c: "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else "$" if c in "#*$%&|<>" else "."
    count = {}
    for w in words:
        shape = "".join(k for k, _ in itertools.groupby(map(kind, w)))
        for place in (zlib.crc32(w.lower().encode()) % half, half + zlib.crc32(shape.encode()) % (half // 2)):
            count[place] = count.get(place, 0) + 1
    variety = len({zlib.crc32(w.lower().encode()) % half for w in words})
    levels = [min(int(20 * sum(a == b for a, b in zip(words, words[1:])) / len(words)), 63)]
    if len(words) >= quality.VARIETY_FROM:
        levels.append(64 + min(int(8 * variety / len(words) ** 0.5), 63))
    if text.count("\n") + 1 >= quality.LINES_FROM:
        levels.append(128 + min(int(len(words) / (text.count("\n") + 1)), 63))
    for place in levels:
        count[half + half // 2 + place] = count.get(half + half // 2 + place, 0) + len(words)
    return 1 / (1 + math.exp(-sum(float(weights[at]) * math.sqrt(n / len(words)) for at, n in count.items()) - float(weights[-1])))


def plain_rules(docs):
    """doc_id to text without frequent lines, of the documents that stay; docs: doc_id to (text, host)."""
    words = lambda t: [w for w in re.split(BLANK, t) if w]
    norm = lambda line: " ".join(words(line.lower()))
    lines = {i: {norm(x) for x in t.split("\n") if words(x)} for i, (t, _) in docs.items()}
    texts, holders = {}, {}
    for i, (t, host) in docs.items():
        texts.setdefault(host, set()).add(t)
        for line in lines[i]:
            holders.setdefault((host, line), set()).add(t)
    gone = {k for k, t in holders.items() if len(t) > rules.MAX_TEXTS and len(t) > rules.MAX_SHARE * len(texts[k[0]])}
    out = {}
    for i, (t, host) in docs.items():
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1}
        repeated = {k + d for k, g in enumerate(grams) if g in many for d in range(3)}
        total = sum(len(line.split(" ")) for line in lines[i])
        lost = sum(len(line.split(" ")) for line in lines[i] if (host, line) in gone)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and total - lost >= rules.MIN_LEFT * total:
            out[i] = "\n".join(x for x in t.split("\n") if (host, norm(x)) not in gone) if lost else t
    return out


def plain_groups(docs):
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 on 5-word shingles."""
    sets = {}
    for i, t in docs.items():
        w = [x for x in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    head = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((head[a], head[b]))
            head = {i: low if h == high else h for i, h in head.items()}
    return {i: t for i, t in docs.items() if head[i] == i}


def test_whole_run_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, _ = quality.fit(docs)
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    one = {i: v for i, v in rows.items() if plain_score(v[0] or "", weights) >= quality.REJECT_UNDER}
    three = plain_groups(plain_rules(one))
    assert 100 < len(three) < len(one) < len(rows)
    bpe = byte_bpe().slow
    want = {}
    for i, t in three.items():
        ids = np.array(bpe.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[i, start] = (len(part), zlib.crc32(part.tobytes()), len(ids))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= math.ceil(sum(fill.values()) / 2048) + 1  # minimum bin slack leaves next to nothing


def test_odd_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ("gone", "_gone", "_k1", "_k2", "_row", "_lost", "lost_lines", "_host", "_t", "n", "text_", "rank", "salt", "piece", "draw", "score")
    clashing = docs.withColumns({c: docs["lang"] for c in names})
    nulls = docs.limit(3).selectExpr("cast(null as long) as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars")
    nulls = nulls.unionByName(docs.limit(2).selectExpr("doc_id + 9000000000000001 as doc_id", "cast(null as string) as text", "lang", "source", "cast(null as long) as n_chars"))
    odd = clashing.unionByName(docs.limit(20).withColumns({c: docs["lang"] for c in names})).unionByName(nulls.withColumns({c: nulls["lang"] for c in names}))
    for kind, table in {"odd": odd, "empty": clashing.where("false")}.items():
        path = f"{tmp_path}/{kind}"
        table.write.parquet(f"{path}/documents.parquet")
        at = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, path)
            assert out.columns == table.columns, name
            out.write.parquet(f"{path}/{name}")
            at = spark.read.parquet(f"{path}/{name}")
        n = corpus_pipeline.run(spark, path).count()
        assert n == 0 if kind == "empty" else n >= at.count() > 100


def test_every_query_runs(spark, sf):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() > 0, name


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), name
