"""Operators against brute force on small fixtures, with nulls, empties, repeats and odd columns."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import langid, licenses, ngram_join, order, packing, pieces, quality, rules, topk, urls
from newstide.llm.common import byte_bpe, id_bitmap, id_hash, in_bitmap
from newstide.llm.components import components

BASE = "the quick brown fox jumps over the lazy dog while seven old ships sail past a quiet harbour at dawn and nobody on the pier looks up from their nets".split()
ODD = [None, "", " \n\t ", "one", "Two words", "a b c", "A  B\tC", "x" * 5000, "é ñ ▁ 日本 \U0001f600", "<|endoftext|> end", "tab\x00nul\r\nline"]


def near(i, edits):
    words = [f"{w}{k}" for k, w in enumerate(BASE * 8)]
    for k in range(edits):
        words[(i * 31 + k * 57) % len(words)] = f"edit{i}x{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    texts = ODD + [near(i, i % 4) for i in range(24)] + [near(i, 12 + i % 9) for i in range(12)] + [near(3, 0)] * 5
    return [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(None, near(0, 0), "en", None, 1), (7, "x" * 5000, "en", "s", 5000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit(1)).withColumn("length", F.lit("x"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def word_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(docs, rows, k, num, den):
    sets = {i: word_set(t, k) for i, t, *_ in rows if i is not None}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    got = ngram_join.jaccard_components(docs, k, num, den).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
    kept = ngram_join.one_of_each(docs, k, num, den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, *_ in rows if i is not None and comp[i] == i)


def test_jaccard_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 4), (4, 9), (5, 6), (6, 7), (7, 8), (8, 5), *[(20, i) for i in range(21, 40)]]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 4, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, **{i: 20 for i in range(20, 40)}}


def test_bitmap(spark):
    ids = spark.range(0, 4000, 7)
    bitmap = id_bitmap(ids, "id")
    some = spark.range(4000).select("id", id_hash("id").alias("h")).toPandas()
    hit = in_bitmap(bitmap, some["h"])
    assert hit[some["id"] % 7 == 0].all() and hit.mean() < 0.2


def test_tokenizer_reads_alike():
    bpe = byte_bpe()
    for text in [*(t for t in ODD if t), " " * 100_000, "a" * 20_000, "can't stop\n\n\n  now  "]:
        assert bpe.encode(text).tolist() == bpe.slow.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_and_fills():
    counts = {1500: 3, 548: 3, 100: 40, 7: 500, 2047: 2, 1: 5}
    shapes = packing.plan(counts, 2048)
    used = {}
    for times, shape in shapes:
        assert sum(s * n for s, n in shape.items()) <= 2048
        for s, n in shape.items():
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    assert sum(times for times, _ in shapes) == math.ceil(sum(s * n for s, n in counts.items()) / 2048)


def test_closest_is_the_best_subset_sum():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = {int(s): int(rng.integers(1, 4)) for s in rng.integers(1, 60, 5)}
        head = max(counts)
        room = 100 - head
        items = [s for s, n in counts.items() for _ in range(n - (s == head))]
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room) if len(items) < 14 else None
        got = packing._closest(dict(counts), sorted(counts, reverse=True), room, head)
        assert all(n <= counts[s] - (s == head) for s, n in got.items())
        if best is not None:
            assert sum(s * n for s, n in got.items()) == best


def test_pack_round_trip(docs, rows, empty):
    got = packing.pack(docs, window=64, keep_ids=True).collect()
    bpe = byte_bpe()
    want = sorted(str(bpe.slow.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, *_ in rows)
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist()))
    for i in {i for i, *_ in rows if i not in (7, None)}:
        assert str([x for _, part in sorted(by_doc[i]) for x in part]) in want
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    out = packing.sequences(packing.pack(docs, window=64, keep_ids=True), 64).collect()
    assert {len(r.ids) for r in out} == {256} and len(out) == len(fill)
    assert packing.pack(empty).collect() == []


def test_merges_like_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = pieces.merge_model()
    texts = ["  a  b\n c d ", "Hello world, this is   a test.\n\nNew line", "naïve café 日本語", "a" * 100 + " " + "ab" * 40, " ".join(BASE)]
    for text, ids in zip(texts, pieces.encode_batch(model, texts, range(len(texts)), 1, 0.0), strict=True):
        assert ids.tolist() == sp.encode(text)


def test_dropout_is_seeded_lossless_and_the_same_side_by_side():
    model = pieces.merge_model()
    texts = [t or "" for t in ODD] + [near(i, 3) for i in range(5)] + ["  lead", "trail  ", "\n\n \n"]
    one = pieces.encode_batch(model, texts, range(len(texts)), 1, 0.3)
    assert [x.tolist() for x in one] == [x.tolist() for x in pieces.encode_batch(model, texts, range(len(texts)), 1, 0.3)]
    assert [pieces.decode(model, x) for x in one] == texts
    other = pieces.encode_batch(model, texts, range(len(texts)), 2, 0.3)
    assert sum(x.tolist() != y.tolist() for x, y in zip(one, other, strict=True)) > 4
    words = [f" {w}" for w in BASE] + [" antidisestablishment", "日本語x"]
    keys = np.arange(7, 7 + len(words)).astype(np.uint64)
    flat, lengths = pieces.encode_units(model, words, keys, 0.4)
    for w, key, ids in zip(words, keys, np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
        start = [int(model.char[ord(c)]) if model.char[ord(c)] >= 0 else -10 - i for i, c in enumerate(w)]
        alone = pieces.agenda(model, start, int(key), int(0.4 * (1 << 32)))
        assert pieces._expand(model, alone, w) == ids.tolist()


def test_every_occurrence_has_draws_of_its_own():
    model, rate = pieces.merge_model(), 0.1
    texts = [" ".join(["international"] * 3000 + ["of"] * 3000), "x" * 40 + " international" * 50]
    units = [pieces._UNIT.findall(" " + t) for t in texts]
    keys = pieces.unit_keys([5, 6], np.array([len(x) for x in units]), 1)
    got = pieces.encode_batch(model, texts, [5, 6], 1, rate)
    want = []
    for w, key in zip([w for x in units for w in x], keys.tolist(), strict=True):
        start = [int(model.char[ord(c)]) for c in w]
        want.append(pieces.agenda(model, start, key, int(rate * (1 << 32))))
    assert [x for ids in got for x in ids.tolist()] == [x for ids in want for x in ids]
    assert len(set(map(tuple, want[:3000]))) > 20  # 8 at most before
    one = [len(x) for x in want[3001:6000]]  # a word of two merges at most: some are skipped
    assert 0.05 < np.mean(np.array(one) > min(one)) < 0.3


def test_encode_rows(docs, rows, empty):
    got = pieces.encode(docs, keep_ids=True)
    assert got.where("not lossless").count() == 0 and got.count() == len(rows)
    texts = {r.doc_id: r.text for r in pieces.decode_ids(got).collect()}
    assert all(texts[i] == (t or "") for i, t, *_ in rows if i is not None)
    assert pieces.encode(empty).collect() == []


def test_permutation_is_one_to_one_and_inverts():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = order.permute(np.arange(n), n, 99)
        assert sorted(slots.tolist()) == list(range(n))
        assert order.permute(slots, n, 99, back=True).tolist() == list(range(n))
    assert order.permute(np.arange(1000), 1000, 1).tolist() != order.permute(np.arange(1000), 1000, 2).tolist()


def held(directory, rows, window, mark=None):
    """Checks every piece against the shards; returns the ids of each (doc_id, text) row's documents, end to end."""
    n = max(r.slot for r in rows) + 1
    data = order.read_slots(directory, 0, n, mark)
    docs = {}
    for r in rows:
        ids = data[r.slot, r.place : r.place + r.n_tokens]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        docs.setdefault(r.doc_id, {}).setdefault(r.start, []).append(ids.tolist())
    fill = {}
    for r in sorted(rows, key=lambda r: (r.slot, r.place)):
        assert fill.get(r.slot, 0) == r.place  # gapless
        fill[r.slot] = r.place + r.n_tokens
    assert sorted(fill) == list(range(n)) and max(fill.values()) <= window
    return docs, fill


def test_shards_hold_every_sequence(spark, docs, rows, empty, tmp_path):
    where = f"file://{tmp_path}/out"
    pieces_, shards, directory = order.materialise(docs, where, window=16, per_shard=50)
    got = pieces_.collect()
    found, fill = held(directory, got, 16)
    bpe = byte_bpe()
    for i, t, *_ in rows:
        if i not in (7, None):
            assert [x for start in sorted(found[i]) for x in found[i][start][0]] == bpe.slow.encode(t or "", add_special_tokens=False).ids + [1]
    assert sum(n < 16 for n in fill.values()) <= docs.rdd.getNumPartitions()  # only a partition's last sequence is padded
    manifest = shards.collect()
    assert sum(r.records for r in manifest) == len(fill)
    for r in got:
        assert r.shard == r.slot // 50 and r.byte_offset == (r.slot % 50) * 32 + 2 * r.place
    files = sorted((tmp_path / "out").glob("shard-*.bin"))
    assert [zlib.crc32(f.read_bytes()) for f in files] == [r.crc32 for r in sorted(manifest, key=lambda r: r.shard)]
    assert order.materialise(empty)[0].collect() == [] and order.read_slots(order.materialise(empty)[2], 0, 5).shape == (0, 512)


def test_a_run_resumes_whatever_the_partitions_and_never_mixes_keys(spark, docs, tmp_path):
    where = f"file://{tmp_path}/out"
    few = docs.where("doc_id is not null").coalesce(2)
    first = {(r.doc_id, r.start, r.slot) for r in order.materialise(few, where, window=16, per_shard=20, key=1)[0].collect()}
    files = sorted((tmp_path / "out").glob("shard-*.bin"))
    whole = {f: f.read_bytes() for f in files}
    stamp = {f: f.stat().st_mtime_ns for f in files}
    files[0].write_bytes(b"cut off")
    wrong = bytearray(whole[files[1]])
    wrong[5] ^= 1
    files[1].write_bytes(wrong)  # the right size, other bytes
    files[2].unlink()
    again = order.materialise(few.repartition(5), where, window=16, per_shard=20, key=1)[0]
    assert {(r.doc_id, r.start, r.slot) for r in again.collect()} == first
    assert {f: f.read_bytes() for f in files} == whole
    assert all(f.stat().st_mtime_ns == stamp[f] for f in files[3:])
    mark = next((tmp_path / "out").glob("order-*.json")).name[6:-5]
    two, _, directory = order.materialise(few, where, window=16, per_shard=20, key=2)
    held(directory, two.collect(), 16)  # the latest run
    held(directory, again.collect(), 16, mark)  # the one before is whole, too
    assert {(r.doc_id, r.start, r.slot) for r in two.collect()} != first
    (tmp_path / "out" / f"sequences-{mark}" / "_SUCCESS").unlink()  # a run that was cut off while it wrote its table
    third = order.materialise(few, where, window=16, per_shard=20, key=1)[0].collect()
    assert {f: f.read_bytes() for f in files} == whole and {(r.doc_id, r.start, r.slot) for r in third} == first


def test_sequences_hold_512_ids(spark):
    words = " ".join(["harbour"] * 400)
    ids = byte_bpe().encode(words).tolist() + [1]
    assert 256 < len(ids) <= 512
    pieces_, _, directory = order.materialise(spark.createDataFrame([(1, words)], "doc_id long, text string"))
    assert [(r.start, r.n_tokens, r.place) for r in pieces_.collect()] == [(0, len(ids), 0)]
    assert order.read_slots(directory, 0, 1)[0].tolist() == ids + [0] * (512 - len(ids))


def test_ids_that_16_bits_cannot_hold(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    pieces_, shards, directory = order.materialise(docs, window=8, end_id=70000)
    assert order.read_slots(directory, 0, 1).dtype == np.dtype("<u4") and 70000 in order.read_slots(directory, 0, 1)[0]
    assert shards.first().bytes == 32


LARGE = 2**53 + 1  # a double can't hold it


def test_large_ids_beside_null(spark):
    rows = [(None, "one text here", "en"), (LARGE, "another text here", "en"), (LARGE + 2, None, None), (None, None, "fr"), (3, "trois mots ici", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    want = sorted(str(i) for i, *_ in rows)
    got = {
        "op1": quality.score(docs),
        "op2": packing.pack(docs),
        "op3": pieces.encode(docs),
        "op4": ngram_join.jaccard_components(docs),
        "op5": rules.judge(docs.withColumn("source", F.lit("s"))),
        "op7": langid.identify(docs.select("doc_id", "text"), langid.train(docs)),
        "op10": order.materialise(docs)[0],
    }
    for name, df in got.items():
        assert sorted(str(r.doc_id) for r in df.collect()) == want, name
    assert {str(r.doc_id) for r in quality.keep(docs).collect()} <= set(want)
    assert {r.doc_id for r in pieces.decode_ids(pieces.encode(docs, keep_ids=True)).collect()} == {i for i, *_ in rows}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 460)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [2.0])]
    vectors = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 25 = 0"), 10).collect()]
    good = {i: np.pad(np.floor(1024 * np.array(v, dtype=np.float64)), (0, 6 - len(v))).astype(int) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 25 == 0):
        scored = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.where("false"), vectors, 10).collect() == []


def test_coordinate_pruning_loses_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    calls = []
    coordinate = topk._Bucket.coordinate

    def counted(self, q, cosine):
        at = coordinate(self, q, cosine)
        calls.append((cosine, len(at)))
        return at

    monkeypatch.setattr(topk._Bucket, "coordinate", counted)
    centres = rng.normal(size=(10, 8))
    for spread in (0.05, 0.3, 5.0):  # tight groups have high local cosines, the last one none
        m = np.floor(1024 * np.repeat(centres, 50, axis=0) + 1024 * spread * rng.normal(size=(500, 8)))
        ids = np.arange(500)
        bucket = topk._Bucket(ids, m)
        for i in range(0, 500, 25):
            scores = m @ m[i]
            floor = np.sort(scores)[-11]
            got = {int(x): int(s) for _, found, score in bucket.search(ids[i : i + 1], m[i : i + 1], np.array([floor]), 10) for x, s in zip(found, score, strict=True)}
            want = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:10]
            assert {j: int(-s) for s, j in want if -s >= floor} == got
    assert len(calls) > 10 and all(c >= topk.COSINE for c, _ in calls) and min(n for _, n in calls) < 250


def test_top_k_over_lengths_that_prune(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=5) * 3.0 ** (i % 7)).tolist()) for i in range(300)]
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 5 * 10)  # some 10 rows a block
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 4).collect()]
    m = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(m[q], v, strict=True)), i) for i, v in m.items() if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_products_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 3.0]])
    assert topk._product(a, np.array([[2.0**20 + 1, 1.0]]))[0, 0] == 2**60 + 2**40 + 3


def test_base_counts(spark, docs):
    texts = ["a b c a b c", "x\nx\n\n y \n y \n", "a a a a", " #1 $% \t&x|<> ", "w " * 60, *[t for t in ODD]]
    rows = [(i, t) for i, t in enumerate(texts)]

    def brute(t):
        import re

        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    got = rules.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_frequent_lines_deplete(spark, empty):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    pad, more = (" ".join(f"{c}{j}" for j in range(20)) for c in "pz")
    rows = [(i, f"Common   LINE of the host {pad}\n{own(i)}", "h") for i in range(40)]
    rows += [(100 + i, f"common line of the host {pad}\n{' '.join(f'v{i}x{j}' for j in range(20))}" + f"\nalso common {more}", "h") for i in range(40)]
    rows += [(200 + i, own(999), "h") for i in range(60)]  # copies of one text are one document
    rows += [(300, f"common line of the host {pad}\nshort " + "q " + " ".join(map(str, range(30))), "other"), (301, None, None), (302, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("line", "words", "texts", "lost_lines")})
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(got[i].kept and got[i].lost_words == 25 for i in range(40))
    assert not any(got[100 + i].kept for i in range(40)) and not any(got[100 + i].base_failed for i in range(40))
    assert all(got[200 + i].kept for i in range(60))
    assert not got[300].base_failed and not got[301].kept and got[302].base_failed
    cleaned = {r.doc_id: r.text for r in rules.clean(docs).collect()}
    assert set(cleaned) == {i for i, r in got.items() if r.kept} and cleaned[5] == own(5) and cleaned[200] == own(999)
    twice = docs.where("doc_id < 200").unionByName(docs.where("doc_id = 5"))
    assert rules.clean(twice).where("doc_id = 5").count() == 2
    assert rules.judge(empty).collect() == [] and rules.clean(empty).collect() == []


def test_language(spark):
    words = {"en": "the house is on that hill and we walk there", "fr": "la maison est sur cette colline et nous marchons", "de": "das haus steht auf dem berg und wir gehen hin"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.permutation(words[x].split() * 4)), x) for i, x in enumerate(list(words) * 30)]
    rows += [(900, None, "en"), (901, "12 34 !!", "fr"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", F.lit("x").alias("score")), langid.train(docs.where("doc_id < 45"))).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows[:90]) >= 88 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), langid.train(docs.where("false"))).collect()} == {"und"}


def test_language_is_learned_from_whole_texts(spark):
    words = {"en": "the house is on that hill and we walk there", "fr": "la maison est sur cette colline et nous marchons"}
    rng = np.random.default_rng(11)
    text = lambda x, n: " ".join(rng.permutation(words[x].split() * n))
    header = " ".join(f"notice{i}" for i in range(150))  # over 1,000 code points that all texts share
    rows = [(i, f"{header} {text(x, 60)}", x) for i, x in enumerate(list(words) * 20)]
    dicts = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"house" in dicts["en"] and b"maison" in dicts["fr"]
    docs = spark.createDataFrame([(i, text(x, 3), x) for i, x in enumerate(list(words) * 20)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, dicts).collect())


def test_weak_labels_find_the_planted_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.8
    rates = [0.95, 0.9, 0.85, 0.8, 0.9]
    votes = ["".join("g" if (rng.random() < r) == t else "b" for r in rates) + "---" for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    post = quality.estimate(counts)
    assert np.mean([(post[v] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93
    assert quality.estimate({}) == {}


def test_quality_keeps_prose(spark, docs, empty, sf):
    rng = np.random.default_rng(6)
    prose = lambda: ". ".join(" ".join(rng.choice(BASE, 12)).capitalize() for _ in range(8))
    rows = [(i, prose()) for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}$$$ |" for w in rng.choice(BASE, 60))) for i in range(30)]
    rows += [(2000 + i, " ".join(w for w in rng.choice(BASE, 6) for _ in range(30))) for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i] for i in range(300)]) > 0.97
    assert np.mean([got[1000 + i] for i in range(30)]) < 0.1 and np.mean([got[2000 + i] for i in range(30)]) < 0.1
    assert quality.score(docs).count() == docs.count()
    assert quality.score(empty).collect() == [] and quality.keep(empty).collect() == []


def test_repeated_documents_never_change_a_verdict(spark, sf):
    """Some documents stand 20,000 times: scores as without the repeats, and the sample keeps its bound."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    once = {r.doc_id: (round(r.quality_score, 6), r.kept) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for chosen in (4, 0):
        text = dict(rows)[chosen]
        copies = spark.range(20_000).select(F.lit(chosen).cast("long").alias("doc_id"), F.lit(text).alias("text"))
        many = spark.createDataFrame(rows, "doc_id long, text string").unionByName(copies)
        got = quality.score(many).select("doc_id", F.round("quality_score", 6).alias("s"), "kept").distinct().collect()
        assert {r.doc_id: (r.s, r.kept) for r in got} == once and len(got) == len(once)
        weights, _ = quality.fit(copies)
        assert weights is not None  # a table of one document's repeats has a scorer, too
        assert quality.keep(copies).count() in (0, 20_000)


def test_the_quality_sample_is_bounded_and_never_empty(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda at, *a: seen.append(len(at)) or train(at, *a))
    quality.fit(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "id").alias("text")))
    quality.fit(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "the only words here").otherwise(F.lit(" ")).alias("text")))
    assert seen == [50, 1]
    assert quality.fit(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))[0] is None


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/f.py", "nothing here"),
        ("a/x/g.py", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        ("a/x/h.py", None),
        ("z/h.py", ""),
        ("top.txt", "the free software and the version of any work"),
        (None, "Released under the MIT License."),
        ("a/x/h.py", None),
    ]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string").withColumn("license", F.lit(1)).withColumn("at", F.lit(1))
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.scan(docs).collect()}
    assert got == {
        0: ("MIT", "own", None),
        1: ("Apache-2.0", "own", None),
        2: ("Apache-2.0", "inherited", "a/b"),
        3: ("GPL-3.0", "own", None),
        4: ("MIT", "inherited", "a"),
        5: (None, "none", None),
        6: (None, "none", None),
        7: ("MIT", "own", None),
        8: ("MIT", "inherited", "a"),
    }
    assert licenses.scan(docs.where("false")).collect() == []


def test_url_rules_and_trees(spark):
    rules_ = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fixed = [
        ("http://A.EXAMPLE.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/1x?q=/es/", "example.org", "/en/1x", "example.org/en/1", "block"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com/DE/", "x.com", "/DE/", None, None),
        ("http://x.org?es", "x.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ]
    rows = [(i, r[0]) for i, r in enumerate(fixed)]
    rows += [(100 + i, f"http://good{i % 7}.example.org/a/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://casino-win.example.net/{i}/{i * 37}?a={i}&b=2") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("label", F.lit("x"))
    got = {r.page_id: r for r in urls.judge(pages, rules_).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(fixed):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert all(got[1000 + i].verdict == "block" for i in range(200))
    few = urls.judge(pages.where("page_id in (0, 7)"), rules_).collect()
    assert {r.page_id: r.verdict for r in few} == {0: "block", 7: "allow"}
    assert urls.judge(pages.where("false"), rules_).collect() == []


def test_urls_the_trees_judge_are_told_apart_on_the_held_out_fold(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url")
    from newstide.llm.queries import URL_RULES

    labelled = urls._labelled(pages, URL_RULES)
    model, stats, cut, auc = urls.fit(labelled)
    scored = urls._scored(labelled.where("fold = 2 and ruled is null"), stats, model).select("label", "p_block").toPandas()
    good, bad = (scored.loc[scored.label == x, "p_block"].to_numpy() for x in (0, 1))
    exact = (np.sign(bad[:, None] - good[None, :]) / 2 + 0.5).mean()
    assert len(good) > 50 and len(bad) > 5 and exact > 0.95 and abs(auc - exact) < 0.02
    assert (bad >= cut).mean() > 0.9 and (good >= cut).mean() < 0.1
    ruled = urls.judge(pages.withColumn("url", F.lit("https://casino-win.example.org/a")), URL_RULES).first()
    assert (ruled.rule, ruled.verdict) == ("org/", "allow")  # a rule goes before the list of words


def test_a_rare_class_of_urls_still_trains(spark):
    """10 listed URLs of 60,000, and then 2: the trees are there and block the listed hosts; repeats don't fill the sample."""
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 6000 == 5, F.concat(F.lit("http://casino-"), "id", F.lit(".bet-win.xyz/?a=1&b=2&c="), "id")).otherwise(F.concat(F.lit("http://site"), F.col("id") % 500, F.lit(".example.net/page/"), "id")).alias("url"))
    for frame, blocked in ((pages, 10), (pages.where("page_id < 12000"), 2)):
        assert urls.fit(urls._labelled(frame, [])) is not None
        got = urls.judge(frame, []).groupBy(F.col("host").contains("casino").alias("listed"), "verdict").count().collect()
        assert {(r.listed, r.verdict): r["count"] for r in got}.get((True, "block"), 0) >= 0.8 * blocked - 0.5
        assert sum(r["count"] for r in got if not r.listed and r.verdict == "block") < 0.05 * frame.count()
    copies = spark.range(30_000).select((F.col("id") + 100_000).alias("page_id"), F.lit("http://casino-5.bet-win.xyz/?a=1&b=2&c=5").alias("url"))
    model, *_ = urls.fit(urls._labelled(pages.unionByName(copies), []))
    assert model.numFeatures == len(urls.FEATURES)
    one_class = pages.where("page_id % 6000 <> 5")
    assert urls.fit(urls._labelled(one_class, [])) is None and {r.verdict for r in urls.judge(one_class, []).select("verdict").distinct().collect()} == {"allow"}


def test_urls_repeated_and_very_long(spark):
    long = "http://x.net/" + "a/" * 20_000 + "?" + "&".join(f"k{i}=v" for i in range(2000))
    rows = [(1, long), (1, long), (2, "http://casino.net/a"), (3, "://"), (4, "http://"), (None, None)] + [(10 + i, f"http://h{i}.net/{i}") for i in range(60)] + [(100 + i, f"http://casino{i}.net/{i}") for i in range(60)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), []).collect()
    assert len(got) == len(rows) and len({(r.verdict, r.p_block) for r in got if r.page_id == 1}) == 1
    assert {r.path for r in got if r.page_id == 1} == {"/" + "a/" * 20_000}


def brute_license(text, idf, rare):
    """Dense cosines of every passage with every template."""
    words = frozenset(t for _, x in licenses.TEMPLATES for t in licenses.terms(x))

    def vector(terms):
        terms = terms + [f"{a} {b}" for a, b in zip(terms, terms[1:])]
        return {t: (1 + math.log(terms.count(t))) * idf.get(t, rare) for t in set(terms)}

    best = []
    for terms in licenses.passages(text, words):
        x = vector(terms)
        for name, template in licenses.TEMPLATES:
            y = vector(licenses.terms(template))
            dot = sum(v * y.get(t, 0) for t, v in x.items())
            best.append((round(dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 9), len(y), name))
    top = max(best, default=(0, 0, None), key=lambda b: b[:2])
    return min(b[2] for b in best if b[:2] == top[:2]) if top[0] >= licenses.THRESHOLD else None


def test_licenses_against_brute_force(spark):
    texts = {
        "GPL-2.0": "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n Everyone is permitted to copy",
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
        "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",
        "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nThis version incorporates the terms of version 3 of the GNU General Public License",
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007",
        "BSD-2-Clause": "Copyright (c) 2001, A Person\nAll rights reserved.\n\n" + dict_of("BSD-2-Clause"),
        "BSD-3-Clause": "/*\n * Copyright (c) 2001, A Person\n *\n * " + dict_of("BSD-3-Clause").replace("\n", "\n * ") + "\n */\nint main(void) { return 0; }",
        "MIT": "The MIT License\n\nCopyright (c) 2001 A Person\n\n" + dict_of("MIT"),
        "ISC": dict_of("ISC"),
        "GPL": "It is under the\nGNU General Public License\nas is",
        "CC-BY-NC-4.0": "some prose first\nLicensed under CC BY-NC 4.0.\nand more prose after it",
        "none": "no permission was asked, and the public domain is large; a license to print money",
        "empty": "",
    }
    # a tree of three depths: root/, root/a/, root/a/b/
    rows = [(0, "root/LICENSE", texts["GPL-2.0"]), (1, "root/a/COPYING", texts["BSD-2-Clause"]), (2, "root/a/b/plain.c", "int x;"), (3, "root/c/d/e.c", None), (4, "root/a/b/LICENSE.md", texts["none"]), (5, "rootless/x", ""), (6, None, texts["MIT"])]
    rows += [(10 + i, f"other/{name}/file", t) for i, (name, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("k1", "K2", "at", "cosine", "dir")})
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    words = frozenset(t for _, x in licenses.TEMPLATES for t in licenses.terms(x))
    vocabulary = frozenset(t for _, x in licenses.TEMPLATES for t in licenses.pairs(licenses.terms(x)))
    held_ = [set(licenses.pairs([t for p in ps for t in p])) | {t for p in ps for t in licenses.pairs(p)} for _, _, t in rows if (ps := licenses.passages(t, words))]
    idf, rare = licenses.weights(len(held_), {t: sum(t in h for h in [{x for p in licenses.passages(t2, words) for x in licenses.pairs(p)} for _, _, t2 in rows]) for t in vocabulary}, vocabulary)
    own = {i: brute_license(t, idf, rare) for i, _, t in rows}
    assert {i: r.own_license for i, r in got.items()} == own
    for i, name in enumerate(texts):
        assert own[10 + i] == (None if name in ("none", "empty") else name), name
    assert (got[2].license, got[2].from_dir) == ("BSD-2-Clause", "root/a") and (got[3].license, got[3].from_dir) == ("GPL-2.0", "root")
    assert (got[4].license, got[4].origin) == ("BSD-2-Clause", "inherited") and got[5].origin == "none" and got[6].origin == "own"
    assert all(r.k1 == 1 and r.at == 1 and r.dir == 1 for r in got.values())


def test_identifier_lines_denials_and_whole_texts(spark):
    texts = {
        "// SPDX-License-Identifier: Apache-2.0\npackage x;": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-2.0-only\nimport os": "GPL-2.0",
        "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "LGPL-2.1",
        "SPDX-License-Identifier: MIT": "MIT",
        "Copyright 2001 A Person\n# spdx-license-identifier: bsd-3-clause\n": "BSD-3-Clause",
        "SPDX-License-Identifier: NoSuchLicense-1.0": None,
        "This file is not licensed under the GNU General Public License.": None,
        "It isn't distributed under the MIT License": None,
        "This work is licensed under the GNU General Public License.": "GPL",
        **{f"Copyright (c) 2001 A Person\n\n{dict_of(name)}\n\nint main;": name for name in ("0BSD", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense", "Zlib")},
    }
    docs = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_license, r.cosine) for r in licenses.scan(docs).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert got[i][0] == want, (text[:80], got[i])


def dict_of(name):
    return max((text for n, text in licenses.TEMPLATES if n == name), key=len)


def test_license_templates_all_hold_an_anchor():
    assert all(licenses.ANCHORS.search(text.lower()) for _, text in licenses.TEMPLATES)


def brute_metrics(text):
    """The labellers' measures, word by word."""
    words = (text or "").split()
    if not words:
        return None
    cls = lambda c: "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else "$" if c in "#*$%&|<>" else "."
    classes = ["".join(map(cls, w)) for w in words]
    letters = sum(c in "Aa" for k in classes for c in k)
    n, lines = len(words), sum(1 for line in text.split("\n") if line.strip())
    hashed = {zlib.crc32(w.lower().encode()) % (quality.DIMENSIONS // 2) for w in words}
    return [
        sum(k.count("$") for k in classes) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(k.count("A") for k in classes) / max(letters, 1),
        sum(len(k) > 1 and k[-1] in "$." and k[-2] in "$." for k in classes) / n,
        sum(sum(c in "Aa" for c in k) <= 3 and k[0] in "Aa" for k in classes) / n,
        len(hashed) / n**0.5 if n >= quality.VARIETY_FROM else 2.5,
        n / lines if lines >= quality.LINES_FROM else 3.0,
        n,
    ]


def brute_posteriors(patterns, rounds=50):
    """Expectation-maximisation, one document pattern and labeller at a time."""
    post = {v: (v.count("g") + 1) / (v.count("g") + 2 * v.count("b") + 2) for v in patterns}
    for _ in range(rounds):
        total = sum(patterns.values())
        share = min(max(sum(n * post[v] for v, n in patterns.items()) / total, 0.02), 0.98)
        new = {}
        for v in patterns:
            odds = math.log(1 - share) - math.log(share)
            for j, c in enumerate(v):
                if c == "-":
                    continue
                rate = []
                for side in (post.get, lambda u: 1 - post[u]):
                    mass = {x: 1 + sum(n * side(u) for u, n in patterns.items() if u[j] == x) for x in "gb"}
                    rate.append(mass[c] / sum(mass.values()))
                odds += math.log(rate[1]) - math.log(rate[0])
            new[v] = 1 / (1 + math.exp(min(max(odds, -50), 50)))
        post = new
    return post


def test_quality_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rows = [*((r.doc_id, r.text) for r in docs.collect()), (None, None), (-1, ""), (-2, "A" * 3000 + " " + "#" * 2000 + " b"), (-3, "w! " * 400)]
    for _, text in rows:
        got, want = quality.metrics(text), brute_metrics(text)
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want, rtol=0, atol=1e-12)), text[:80]
    patterns = {}
    for _, text in rows:
        patterns[quality.votes(text)] = patterns.get(quality.votes(text), 0) + 1
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("votes", F.lit(1))
    weights, posterior = quality.fit(table)
    want = brute_posteriors(patterns)
    assert set(posterior) == set(want) and all(abs(posterior[v] - want[v]) < 1e-6 for v in want)
    # every document's score is the scorer's sum over its features, and the scores find the labelled quality
    scored = {r.doc_id: r for r in quality.score(table).collect()}
    for i, text in rows[:200] + rows[-4:]:
        at, value = quality.features(text)
        score = 1 / (1 + math.exp(-sum(float(weights[a]) * v for a, v in zip(at.tolist(), value.tolist(), strict=True)) - float(weights[-1]))) if len(at) else 0.0
        assert abs(scored[i].quality_score - score) < 1e-4 and scored[i].kept == (scored[i].quality_score >= 0.5)
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()
    good, bad = ([scored[r.doc_id].quality_score for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_language_held_out_accuracy(spark, sf):
    from newstide.llm.queries import op7_language_by_compression

    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in op7_language_by_compression(spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    judged = [(r.lang_pred == lang[i], r.rejected) for i, r in got.items() if r.held_out and lang[i]]
    assert len(judged) > 200 and np.mean([ok for ok, _ in judged]) > 0.98 and np.mean([ok for ok, no in judged if not no]) > 0.99


def test_language_takes_whole_rows_up_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "DICT_CHARS", 300)
    rows = [(i, f"start{i} " + "middle " * 10 + f"end{i}", "en") for i in range(30)] + [(99, "début " + "x" * 2000, "fr")]
    dicts = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    taken = [i for i in range(30) if f"start{i} ".encode() in dicts["en"]]
    assert 1 <= len(taken) <= 3 and all(dicts["en"].count(f"end{i}".encode()) for i in taken) and len(dicts["fr"]) <= 301


def test_a_large_near_group_meets_by_hubs_before_all_that_are_left_meet(spark, monkeypatch):
    """Copies of which only some link to the first hub: with further hubs, far fewer meet in pairs, and the components are those of all pairs."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = [f"w{j}" for j in range(60)]
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for _, t in rows]
    head = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and head[a] != head[b]:
                low, high = sorted((head[a], head[b]))
                head = [low if h == high else h for h in head]
    met, pairs = [], ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda m: met.append(m.count()) or pairs(m))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == dict(enumerate(head)) and len(set(head)) > 1
    with_turns = met[-1]
    met.clear()
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()} == got
    assert 2 * with_turns < met[-1]
