"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (Euclidean norm) into geometric buckets, and
every bucket into blocks of bounded rows and bytes.  Queries are grouped by the
length that a candidate needs for them, into blocks alike.  A block of
candidates meets a block of queries only if its greatest length is not under the
least that these need.  With t the k-th best score that a query has so far, a bucket of
lengths up to L has the local cosine threshold t / (|q| * L): over 1 the bucket
holds nothing; when it is high, the coordinates of the unit query confine those
of the unit candidate to narrow ranges (coordinate pruning, over sorted
coordinate lists); else the bucket is scanned down by length (length pruning).
What is left is verified with exact integer products.

Thresholds start from a first pass over one bounded block of the longest
candidates, so that every block prunes from its first row on.

Nulls and edge cases: vectors that are null, or hold null or non-finite
components, take no part, nor do rows without vec_id; rows that repeat id and
vector count once.  Vectors of different sizes: missing components are 0.
Ties go to the smaller vec_id; a query with fewer candidates than k returns all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, stage_table

BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 8192, 1024, 1 << 24
RATIO = 1.05  # of the lengths in a bucket
#: Local cosine from which coordinates prune better than lengths.
COSINE = 0.8


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array of floor(scale * x)), bucket of vectors(vec_id, embedding)."""
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.lit(math.log(RATIO)))).otherwise(F.lit(-1)).cast("int")
    return vectors.where(fine).select("vec_id", v.alias("v")).dropDuplicates().withColumn("norm", norm).withColumn("bucket", bucket)


def _blocks(rows: DataFrame, size: int, by: str, *more: str) -> DataFrame:
    """Rows (vec_id, v, norm, more) gathered within groups ``by`` into blocks of some ``size`` rows and BLOCK_BYTES at most: by, ids, m, greatest norm, arrays of more."""
    told = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).collect()  # a row for each group: some hundred lengths
    if told:
        parts = {r[by]: -(-r.n // max(1, min(size, BLOCK_BYTES // (8 * max(r.width, 1))))) for r in told}
        salts = F.create_map(*[F.lit(int(x)) for item in parts.items() for x in item])[F.col(by)]
    else:
        salts = F.lit(1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit("block")), salts).cast("int"))
    gathered = salted.groupBy(by, "salt").agg(F.collect_list(F.struct("vec_id", "v", *more)).alias("rows"), F.max("norm").alias("norm"))
    return gathered.select(by, "norm", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("m"), *[F.col(f"rows.{c}").alias(c) for c in more])


def _matrix(m, width: int = 0):
    import numpy as np

    width = max([width, 1, *(len(x) for x in m)])
    out = np.zeros((len(m), width))
    for i, x in enumerate(m):
        out[i, : len(x)] = x
    return out


def _product(a, b):
    """Exact integer products of rows: in doubles while they hold them, else in Python's integers."""
    import numpy as np

    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores, ids, k: int):
    import numpy as np

    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class _Bucket:
    """One block of candidates of about one length, with its sorted coordinate lists when they are asked for."""

    def __init__(self, ids, m):
        import numpy as np

        self.norm = np.sqrt((m * m).sum(axis=1))
        by = np.argsort(-self.norm, kind="stable")
        self.ids, self.m, self.norm = ids[by], m[by], self.norm[by]
        self.lists = None

    def coordinate(self, q, cosine: float):
        """Candidates whose unit coordinates lie in the ranges that the cosine allows, by the two narrowest lists."""
        import numpy as np

        if self.lists is None:
            unit = self.m / np.where(self.norm > 0, self.norm, 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self.lists = order, np.take_along_axis(unit, order, axis=0), unit
        order, values, unit = self.lists
        focus = np.argsort(-np.abs(q))[:4]
        wide = np.sqrt(np.maximum(0, 1 - q * q) * max(0.0, 1 - cosine * cosine)) + 1e-9
        low, high = q * cosine - wide, q * cosine + wide
        low = np.where(q <= -cosine, -1.0, low)
        high = np.where(q >= cosine, 1.0, high)
        spans = [(np.searchsorted(values[:, f], low[f] - 1e-9), np.searchsorted(values[:, f], high[f] + 1e-9, side="right"), f) for f in focus]
        a, b, f = min(spans, key=lambda s: s[1] - s[0])
        at = order[a:b, f]
        inside = np.all((unit[np.ix_(at, focus)] >= low[focus] - 1e-9) & (unit[np.ix_(at, focus)] <= high[focus] + 1e-9), axis=1)
        return at[inside]

    def search(self, q_ids, q, floor, k: int):
        """(query number, ids, scores) that may be among the k best, given each query's least score so far."""
        import numpy as np

        length = np.sqrt((q * q).sum(axis=1))
        top = self.norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((length > 0) & (top > 0), floor / (length * top), -1.0)
        scan = []
        for i in np.flatnonzero(cosine <= 1 + 1e-9):
            if cosine[i] >= COSINE:
                at = self.coordinate(q[i] / length[i], min(1.0, cosine[i]))
                if len(at):
                    yield from self._verified(i, at, _product(q[i : i + 1], self.m[at])[0], q_ids, floor, k)
            else:
                scan.append(i)
        for part in (scan[j : j + 256] for j in range(0, len(scan), 256)):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((floor[part] > 0) & (length[part] > 0), floor[part] / length[part], -1.0).min()
            stop = int(np.searchsorted(-self.norm, -need * (1 - 1e-12), side="right")) if need > 0 else len(self.ids)
            scores = _product(q[part], self.m[:stop])
            for row, i in enumerate(part):
                yield from self._verified(i, np.arange(stop), scores[row], q_ids, floor, k)

    def _verified(self, i, at, scores, q_ids, floor, k):
        hit = (scores >= floor[i]) & (self.ids[at] != q_ids[i])
        if hit.any():
            ids, scores = self.ids[at[hit]], scores[hit]
            best = _best(scores, ids, k)
            yield i, ids[best], scores[best]


def _search(k: int):
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                width = max((len(x) for x in [*r.q_m, *r.m]), default=1)
                q_ids, ids = np.asarray(r.q_ids, dtype=np.int64), np.asarray(r.ids, dtype=np.int64)
                floor = np.array(r.q_floor, dtype=np.float64)
                bucket = _Bucket(ids, _matrix(r.m, width))
                out = [pd.DataFrame({"query_id": q_ids[i], "vec_id": found, "score": scores}) for i, found, scores in bucket.search(q_ids, _matrix(r.q_m, width), floor, k)]
                if out:
                    yield pd.concat(out)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


#: A floor for queries that have none yet: under every product of 64 bits.
NO_FLOOR = -9.3e18


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query's vector.

    vectors and queries have vec_id and embedding; a query never meets rows of
    its own vec_id.  Both sides are in blocks of bounded bytes.  The join of
    blocks has no equality: Spark broadcasts the smaller side's blocks if they
    are under its threshold, else it pairs partitions.
    """
    rows = stage_table(integer_vectors(vectors, scale), "vectors")
    asked = stage_table(integer_vectors(queries, scale), "queries")
    found_schema = "query_id long, vec_id long, score long"

    blocks = stage_table(_blocks(rows, BLOCK_ROWS, "bucket"), "blocks")
    open_ = asked.withColumn("f", F.lit(NO_FLOOR)).withColumn("need", F.lit(0))
    first = blocks.orderBy(F.desc("bucket"), F.size("ids").desc()).limit(1).select("ids", "m")  # one block: the longest candidates
    start = _top(map_slices(_queries(open_).crossJoin(F.broadcast(first)), _search(k), found_schema), k)
    floors = start.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    floored = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").withColumn("f", F.coalesce(F.col("s").cast("double"), F.lit(NO_FLOOR)))
    length = F.when((F.col("f") > 0) & (F.col("norm") > 0), F.col("f") / F.col("norm")).otherwise(F.lit(0.0))
    need = F.when(length > 0, F.floor(F.log(length) / F.lit(math.log(RATIO) * 4))).otherwise(F.lit(-1)).cast("int")
    q_blocks = stage_table(_queries(floored.withColumn("length", length).withColumn("need", need)), "query-blocks")
    # a product is at most the product of the lengths; the margin is for rounding
    met = blocks.select("ids", "m", "norm").join(q_blocks, F.col("norm") * (1 + 1e-9) >= F.col("length"))
    found = map_slices(met, _search(k), found_schema).distinct()
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _queries(asked: DataFrame) -> DataFrame:
    """Blocks of queries with the same need: q_ids, q_m, q_floor, and the least length that any of them needs."""
    out = _blocks(asked.withColumn("least", F.col("length") if "length" in asked.columns else F.lit(0.0)), QUERY_ROWS, "need", "f", "least")
    return out.select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("f").alias("q_floor"), F.array_min("least").alias("length"))
