"""Streaming BPE, fill-in-middle and alignment of tokenizers against the libraries and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newstide.llm import alignment, middle, queries, stream_bpe

ODD = [
    None, "", " ", "one", " \n\t ", "a  b ", "x" * 9000, "ha" * 5000 + " y", " " * 7000 + "z", "\n" * 300, "é ñ ▁ 日本 \U0001f600 ՘ \U00016ea0", "<|endoftext|> end<|endoftext|>",
    "<P> in it", "half <S", "don't we'll 'tis '", "tab\x00nul\r\nline", "日本語の文" * 900, "<s> x </s><unk> <0x41>", "fin  e", "12 345,6", "été",
]


@pytest.fixture(scope="module")
def rows():
    words = "the quick brown fox's tail jumped over 12 lazy dogs, wasn't it? Ünïcödé über-alles".split()
    rng = random.Random(5)
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(ODD + made + made[:3])] + [(None, "no id"), (None, None), (3, "one"), (3, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "key": F.lit("k"), "ids": F.lit("x"), "a": F.lit(0), "form": F.lit("?")}).repartition(5)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sort(rows):
    return sorted(rows, key=repr)


# ---- streaming BPE


def slow_bpe(merges, data):
    """Each merge in its order, everywhere from the left."""
    parts = [bytes([b]) for b in data]
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def random_merges(rng, size):
    """A merge list over three bytes in which parts come before wholes and no token is made twice."""
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(200):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 6 and len(merges) < size:
            merges.append((a, b))
            tokens.append(a + b)
    return merges


def test_lookahead_suffices_for_every_continuation():
    """What ends a lookahead before the end of a beginning is the same whatever follows, of all short strings; and the bound is reached."""
    rng, reached = random.Random(3), 0
    for _ in range(25):
        merges = random_merges(rng, rng.randint(2, 9))
        far = stream_bpe.lookahead(merges)
        for head in itertools.product(b"abc", repeat=5):
            told = []
            for tail in itertools.chain.from_iterable(itertools.product(b"abc", repeat=k) for k in range(4)):
                ends, out = 0, []
                for t in slow_bpe(merges, bytes(head + tail)):
                    ends += len(t)
                    out.append((ends, t))
                told.append(out)
            for out in told:
                assert [x for x in out if x[0] <= 5 - far] == [x for x in told[0] if x[0] <= 5 - far], (merges, head)
            if far and 6 - far > 0:
                reached += any([x for x in out if x[0] <= 6 - far] != [x for x in told[0] if x[0] <= 6 - far] for out in told)
    assert reached


def test_lookahead_refuses_merges_out_of_order():
    with pytest.raises(ValueError, match="later merge"):
        stream_bpe.lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_transducer_emits_what_the_whole_gives_in_constant_memory():
    rng = random.Random(4)
    for _ in range(40):
        merges = random_merges(rng, 12)
        ids = {t: i for i, t in enumerate([b"a", b"b", b"c", *[a + b for a, b in merges]])}
        table = stream_bpe.Merges(merges, ids)
        units = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 39))) for _ in range(50)]
        want = [[ids[t] for t in slow_bpe(merges, u)] for u in units]
        assert [list(x) for x in table.encode_many(units)] == want
        assert [table.encode(u) for u in units] == want
        data = bytes(rng.choice(b"abc") for _ in range(400))
        for step in (1, 7, 90):
            t, out = stream_bpe.Transducer(table, window=16), []
            for at in range(0, len(data), step):
                out += t.feed(data[at : at + step])
                assert len(t.held) <= 2 * 16 + table.lookahead + 6
            assert out + t.finish() == [ids[x] for x in slow_bpe(merges, data)]


def test_chunks_of_any_size_give_the_library_s_ids(library, rows, monkeypatch):
    bpe = stream_bpe.stream_bpe()
    assert 0 < bpe.merges.lookahead < 200
    monkeypatch.setattr(stream_bpe, "LONG_UNIT", 12)
    rng = random.Random(6)
    bits = ["a", "re", "'", "'l", "l", " ", "  ", "\n", "7", "!", "<|endoftext|>", "<|end", "é", "日", "՘", "\U0001f600", " the", "x" * 30, " " * 20]
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1, 2, 5, 1000):
            if len(text) > 2000 and size < 1000:
                continue
            got = list(itertools.chain.from_iterable(stream_bpe.encode_chunks(bpe, (text[i : i + size] for i in range(0, len(text), size)))))
            assert got == want, (text[:50], size)
    assert [x.tolist() for x in stream_bpe.encode_texts(bpe, [*texts, None])] == [*(library.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_decoder_reads_bytes_as_they_come(library):
    bpe, rng = stream_bpe.stream_bpe(), random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(len(bpe.tokens)) for _ in range(rng.randint(0, 12))] + [rng.randrange(188) for _ in range(6)]  # many bytes that are no UTF-8
        assert "".join(stream_bpe.decode_parts(bpe, ([i] for i in ids))) == library.decode(ids, skip_special_tokens=False)
    assert "".join(stream_bpe.decode_parts(bpe, [[None, 10**6, -1, 50256]])) == "<|endoftext|>"
    for data in (b"\xe2\x82", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xf4\x90\x80\x80", b"a\xc3", b"\xff\xfe", b"\xf0\x9f\x98\x80"):
        d = stream_bpe.Decoder([bytes([b]) for b in range(256)])
        assert "".join(d.feed([b]) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_streaming_bpe_rows(docs, rows, library, spark):
    got = stream_bpe.round_trip(docs)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sort((r.doc_id, list(r.ids), r.decoded) for r in got.collect()) == sort(want)
    assert sort((r.doc_id, list(r.ids)) for r in stream_bpe.encode(docs).collect()) == sort((i, x) for i, x, _ in want)
    back = stream_bpe.decode(spark.createDataFrame([(1, [50256, None, 64]), (2, None), (None, [])], "doc_id long, ids array<int>"))
    assert sort(map(tuple, back.collect())) == sort([(1, "<|endoftext|>a"), (2, ""), (None, "")])
    assert stream_bpe.round_trip(docs.where("false")).count() == 0


def test_op11_against_the_library(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sort(map(tuple, queries.op11_streaming_bpe(spark, sf).collect())) == sort(want)


# ---- fill in middle

PATTERNS = {
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "words_then_space": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
    "characters": r"[\s\S]",
}


@pytest.mark.parametrize("grammar", PATTERNS)
def test_units_are_those_of_the_grammar(docs, rows, grammar):
    got = docs.select("text", middle.units(F.col("text"), grammar).alias("u")).collect()
    for r in got:
        assert list(r.u) == re.findall(PATTERNS[grammar], r.text or ""), r.text


def test_class_units(spark):
    rows = spark.createDataFrame([("ab12 \tcd,.é́\U0001f600x٣",)], "text string")
    assert list(rows.select(middle.units(F.col("text"), "classes")).first()[0]) == ["ab", "12", " \t", "cd", ",.", "é́", "\U0001f600", "x", "٣"]


def test_grammars_that_need_more_than_two_characters_are_refused():
    for grammar in ("AB", "A*BA|B|A+"):
        with pytest.raises(ValueError):
            middle.boundaries(grammar, ["A", "B"])
    with pytest.raises(ValueError, match="letters"):
        middle.boundaries("a+", ["A"])


def brute_middle(doc_id, text):
    text = text or ""
    k = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(k[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = re.findall(PATTERNS["words"], text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(u), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_op12_against_brute_force(spark, docs, rows, tmp_path):
    many = docs.unionByName(docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("text", F.concat("text", F.lit(" <S")))
    for name, frame in (("as_is", docs), ("marked", many), ("none", docs.where("false"))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = [brute_middle(r.doc_id, r.text) for r in frame.collect()]
        assert sort(map(tuple, queries.op12_fill_in_middle(spark, f"{tmp_path}/{name}").collect())) == sort(want)
        assert name == "none" or {w[2] for w in want} == {"plain", "spm", "psm"}


# ---- alignment


def brute_alignment(rows, library):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    to_byte = stream_bpe.byte_of_character()
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(to_byte[c] for c in plain.id_to_token(i))) for i in plain.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in sp.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append([])
            continue
        cuts = set(itertools.accumulate(len(x) for _, x in a)) & set(itertools.accumulate(len(x) for _, x in b))
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            at = end = 0
            for i, x in tokens:
                groups[at][side].append(i)
                end += len(x)
                at += end in cuts
        found.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(pair for c in links for pair in c)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), groups, c in zip(rows, found, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), told))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("hot", [8192, 3])
def test_alignment_against_brute_force(docs, rows, library, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)  # with few hot pairs the others meet their counts in a shuffle
    got = sort(tuple(r) for r in alignment.align(docs).select(*COLUMNS).collect())
    want = sort(brute_alignment(rows, library))
    assert got == want
    assert any(w[4] > w[1] for w in want) and sum(not w[1] for w in want) >= 3


def test_large_groups_are_met_by_their_ids(monkeypatch):
    """Groups over the bound give the same pairs as those under it."""
    tools, con = alignment.Tokenizers("byte_bpe_50k", "piece_bpe_32k"), alignment._connection()
    found = tools.both(["\U0001f600\U0001f601 " * 30, "né ▁", None, "日本語の文" * 20])
    assert [x is None for x in found] == [False, True, True, False]
    one = alignment._slice(con, tools, found)
    monkeypatch.setattr(alignment, "LARGE", 1)
    two = alignment._slice(con, tools, found)
    for part in (one, two):  # pairs come in any order within a document
        for names in (("a", "b", "times"), ("seen_a", "seen_b", "seen")):
            rows_ = [sorted(zip(*(part[c][i].tolist() for c in names), strict=True)) for i in range(4)]
            part.update({names[0]: rows_, names[1]: None, names[2]: None})
    for name in one:
        if one[name] is None:
            continue
        assert [list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in one[name]] == [list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in two[name]]


def test_alignment_of_nothing(docs):
    assert alignment.align(docs.where("false")).count() == 0
    only = alignment.align(docs.where("text is null")).collect()
    assert [r.n_links for r in only] == [0] * len(only)


def test_op13_against_brute_force(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:7], sha(w[7]) if w[1] else "") for w in brute_alignment(rows, library)]
    got = queries.op13_cross_tokenizer_alignment(spark, sf).select(*COLUMNS[:-1], "groups_sha256").collect()
    assert sort(map(tuple, got)) == sort(want)
