"""Reprints by MinHash bands against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newstide.functions import text as T
from newstide.operators import minhash

DAY = dt.date(2020, 1, 6)
SCHEMA = "id long, source string, lang string, day date, text string, class string"


def articles(seed=5, n=700):
    """Titles of a few hundred words' vocabulary, many of them edited copies of earlier ones."""
    r = random.Random(seed)
    rows, titles = [], []
    for i in range(n):
        if titles and r.random() < 0.7:
            words = list(r.choice(titles))
            for _ in range(r.choice((0, 0, 1, 2))):
                at = r.randrange(len(words))
                words[at] = f"w{r.randrange(300)}" if r.random() < 0.7 else words[at]
        else:
            words = [f"w{r.randrange(300)}" for _ in range(r.choice((2, 9, 14, 22)))]
        titles.append(words)
        rows.append((i, r.choice(("wire", "a", "b", None)), r.choice(("fr", "fr", None)), DAY + dt.timedelta(days=r.randrange(8)), " ".join(words), "x"))
    return rows


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)} - {""}


def brute(rows):
    out = []
    shingles = [sets(r[4]) for r in rows]
    for a, s in zip(rows, shingles, strict=True):
        if a[1] == "wire":
            continue
        met = [(-len(s & t) / len(s | t), b[0]) for b, t in zip(rows, shingles, strict=True) if b[1] == "wire" and a[2] == b[2] and s and t and a[3] and b[3] and abs((a[3] - b[3]).days) <= 2 and 10 * len(s & t) >= 8 * len(s | t)]
        out.append((a[0], bool(met), -min(met)[0] if met else None, min(met)[1] if met else None))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in minhash.reprints(df, F.col("source") == "wire", T.shingles(F.col("text")), **how).collect()), key=repr)


def test_recall_and_exact_verification(spark):
    rows = articles()
    want, got = brute(rows), run(spark, rows)
    hits = {w for w in want if w[1]}
    assert len(hits) > 40 and len(got) == len(want)
    assert all(g in set(want) for g in got if g[1])  # what is told is verified
    assert len(hits & set(got)) >= 0.99 * len(hits)


def test_nulls_repeats_and_empty_tables(spark):
    long = "one two three four five six"
    rows = [
        (1, "wire", "fr", DAY, long, ""),
        (1, "wire", "fr", DAY, long, ""),
        (2, "a", "fr", DAY + dt.timedelta(days=2), long.upper() + " ", ""),
        (2, "a", "fr", DAY + dt.timedelta(days=2), long, ""),
        (3, "a", "fr", DAY + dt.timedelta(days=3), long, ""),
        (4, "a", None, DAY, long, ""),
        (5, None, "fr", DAY, long, ""),
        (6, "a", "fr", None, long, ""),
        (7, "a", "fr", DAY, None, ""),
        (8, "wire", "fr", DAY, "", ""),
        (9, "a", "fr", DAY, "  ", ""),
        (None, "a", "fr", DAY, long, ""),
        (10, "wire", None, DAY, long, ""),
    ]
    got = run(spark, rows)
    assert got == brute(rows) and [g[0] for g in got if g[1]].count(2) == 2 and (4, True, 1.0, 10) in got
    assert run(spark, []) == [] and all(not g[1] for g in run(spark, [r for r in rows if r[1] != "wire"]))


def test_a_copy_sent_often_is_one_class(spark):
    rows = [(i, "wire" if i % 2 else "a", "fr", DAY, "one two three four five six", "") for i in range(3000)]
    got = run(spark, rows)
    assert len(got) == 1500 and {g[1:] for g in got} == {(True, 1.0, 1)}


def test_estimate_is_near_the_similarity(spark):
    a, b = " ".join(f"w{i}" for i in range(202)), " ".join(f"w{i}" for i in range(22, 224))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(T.shingles(F.col("a")).alias("a"), T.shingles(F.col("b")).alias("b"))
    r = df.select(minhash.similarity(F.col("a"), F.col("b")), minhash.estimate(minhash.signature(F.col("a"), 256), minhash.signature(F.col("b"), 256)), minhash.estimate(minhash.signature(F.col("a")), minhash.signature(F.col("a")))).first()
    assert r[0] == pytest.approx(178 / 222) and abs(r[1] - r[0]) < 0.08 and r[2] == 1.0


def test_signatures_are_made_before_bands_read_them(spark, monkeypatch):
    """No plan after the classes' table makes a signature, and bands of a stored one are those of a made one."""
    made = []
    monkeypatch.setattr(minhash.readers, "stored", lambda df, name, f=minhash.readers.stored: made.append(name) or f(df, name))
    rows = spark.createDataFrame([(i, "en", dt.date(1996, 1, 1 + i % 3), f"a b c d e f {i // 2}") for i in range(20)], "id long, lang string, day date, headline string")
    got = minhash.reprints(rows, F.col("id") % 2 == 0, T.shingles(F.col("headline")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "reprint-classes" in made and "array_min" not in plan
    assert {(r.id, r.wire_id, r.similarity) for r in got.collect()} == {(i, i - 1, 1.0) for i in range(1, 20, 2)}


def test_shingles_split_a_text_once(spark):
    """30,000 words: some seconds, where a split for each shingle takes minutes."""
    import time

    words = [f"w{i}" for i in range(30_000)]
    rows = spark.createDataFrame([(" ".join(words),), ("A  b",), ("",), (None,), ("a b c a b c",)], "x string")
    start = time.time()
    got = [r.s for r in rows.select(T.shingles(F.col("x")).alias("s")).collect()]
    assert got[0] == [" ".join(words[i : i + 3]) for i in range(29_998)] and got[1:3] == [["a b"], [""]] and got[4] == ["a b c", "b c a", "c a b"]
    assert time.time() - start < 30
