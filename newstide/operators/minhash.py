"""Reprints by MinHash bands: signatures of word shingles, banded keys within days, exact verification.

Signatures are Spark expressions over a text's own shingles, so making them
shuffles nothing.  Texts with equal shingles are one class from then on, and
candidates are pairs of a class of an article and a class of the wire that share
a band within some days of each other: a copy sent a thousand times is one
class, and a common template meets the other side's classes of those days alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.sources import readers

#: 16 bands of 4 of the 64 values: two sets with a similarity of 0.8 miss each other in 1 of 5,000 cases, of 0.9 in 1 of 10 ** 7.
PERMUTATIONS, BANDS = 64, 16


def signature(shingles: Column, permutations: int = PERMUTATIONS) -> Column:
    """For each permutation the least hash of the shingles; nulls for an empty array."""
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(k, s))))


def estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures: the similarity's unbiased estimate."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda n, x: n + x) / F.size(a)


def band_keys(sig: Column, bands: int = BANDS, permutations: int = PERMUTATIONS) -> Column:
    """One hash for each band of a signature, its number included."""
    rows = permutations // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, F.lit(rows))))


def similarity(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def reprints(articles: DataFrame, is_wire: Column, shingles: Column, threshold: float = 0.8, days: int = 2) -> DataFrame:
    """id, reprint, similarity, wire_id for each row of articles(id, lang, day, ...) that isn't of the wire.

    An article is a reprint if some wire article in its language, dated within
    ``days`` of it, has shingles with a Jaccard similarity of the threshold or
    more.  similarity and wire_id tell the most similar one, ties to the smaller
    id; null without one.  A null or empty text has no shingles, a null day is
    near no other, a null language is one of its own; a null ``is_wire`` is not
    of the wire.  Repeated rows each have their row.
    """
    rows = articles.select("id", "lang", "day", F.coalesce(is_wire, F.lit(False)).alias("wire"), F.array_sort(F.array_distinct(F.array_remove(F.array_compact(shingles), ""))).alias("s"))
    rows = rows.withColumn("s", F.when(F.size("s") > 0, F.col("s"))).withColumn("class", F.when(F.col("s").isNotNull(), F.sha2(F.array_join("s", "\n"), 256)))
    rows = readers.stored(rows, "reprint-articles")
    dated = rows.where("class is not null and day is not null")
    classes = dated.groupBy("class").agg(F.any_value("s").alias("s"))  # a set is hashed once, however often it was sent
    # written between the steps: a signature is made once, not once for each band and each side that reads its keys
    classes = readers.stored(classes.withColumn("sig", signature(F.col("s"))), "reprint-classes")
    keys = classes.select("class", F.explode(band_keys(F.col("sig"))).alias("key"))
    lang = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("l")
    seen = dated.select("class", "wire", lang, F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d")).distinct()

    # a wire class is told of on each day near it, and meets the articles of that day
    wire = seen.where("wire").select("class", "l", F.explode(F.sequence(F.col("d") - days, F.col("d") + days)).alias("d")).distinct()
    sent = wire.join(keys, "class").select(F.col("class").alias("wire_class"), "l", "d", "key")
    met = seen.where("not wire").join(keys, "class").select("class", "l", "d", "key").join(sent, ["l", "d", "key"])
    pairs = met.select("class", "wire_class").distinct()
    a, b = classes.select("class", F.col("s").alias("a")), classes.select(F.col("class").alias("wire_class"), F.col("s").alias("b"))
    alike = pairs.join(a, "class").join(b, "wire_class").select("class", "wire_class", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)

    # the best wire article of each class, language and day, once
    first = dated.where("wire").select(F.col("class").alias("wire_class"), lang, F.datediff("day", F.lit("1970-01-01").cast("date")).alias("at"), "id")
    first = first.groupBy("wire_class", "l", "at").agg(F.min("id").alias("wire_id"))
    near = first.select("wire_class", "l", "wire_id", F.explode(F.sequence(F.col("at") - days, F.col("at") + days)).alias("d")).groupBy("wire_class", "l", "d").agg(F.min("wire_id").alias("wire_id"))
    best = seen.where("not wire").join(alike, "class").join(near, ["wire_class", "l", "d"])
    best = best.groupBy("class", "l", "d").agg(F.max("similarity").alias("similarity"), F.min_by("wire_id", F.struct(-F.col("similarity"), "wire_id")).alias("wire_id"))
    asked = rows.where("not wire").select("id", "class", lang, F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"))
    return asked.join(best, ["class", "l", "d"], "left").select("id", F.col("similarity").isNotNull().alias("reprint"), "similarity", "wire_id")
