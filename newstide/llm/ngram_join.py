"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when the Jaccard similarity of their sets of word k-grams is
at least num / den.  Equal sets are folded to one representative first.  The
members of a set are ordered rare-first by hashed counters over all documents,
as many as the corpus asks for up to 2^24 (any total order is right, a rare-first
one is fast), and a pair can only link if their prefixes of
n - ceil(n * num / den) + 1 members meet.

* Posting lists of the prefixes are joined in two steps.  First every member
  meets one hub of its list (linear in the list), the links found are closed
  into components; where large components still have many others beside them in
  their lists, this is done again with other hubs; then members of *different*
  components meet, so a group of near copies is never expanded into all its
  pairs, and no link between components is lost.
  Lists of one component alone fall out, and a long list is dealt to tasks by a
  salt.
* Length and positional filter, and the suffix filter, stand in the join
  condition.  The suffix filter bounds the symmetric difference from below by
  the popcount of the xor of two parity sketches (one flip a member): of 512
  bits in the join condition, then, for the pairs that are left, of as many bits
  as the set has members, at least (a larger sketch folds to a smaller one).
* Each pair that is left is verified once, on the whole sets.

Nulls and edge cases: a null text or one without words has the empty set and
links with nothing; rows without doc_id lead no group, and have the component
of their copies if there are any, else null.  Rows are judged by their own
text; rows that repeat a doc_id and lead their copies act as one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_bitmap, id_hash, in_bitmap, map_slices, resident, small_batches, stage_table
from .components import components

#: Shingles for each hashed counter of the rare-first order, about, and bounds of the counters' number (as powers of 2).
COUNTER_LOAD, COUNTERS = 64, (16, 24)
SEGMENT = 1 << 16  # counters that travel together
#: Entries of a posting list that meet in one task, about.
HOT = 2048
#: Further turns of hubs at most, hubs of a group in each, and meetings left for each entry (of its list's largest component with the others) that call for one.
TURNS, HUBS, LEFT = 4, 8, 4
WORDS = 8  # 64-bit words of a parity sketch

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds 131,072."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 17:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def _hashes() -> _WordHashes:
    return resident("word hashes", _WordHashes)


def shingles(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the word k-grams; of the whole sequence if it is shorter."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(words) - k + 1, 1)
    width = min(k, len(words))
    acc = h[:n] ^ np.uint64(0x9E3779B97F4A7C15 * width % 2**64)
    for j in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : n + j]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(acc ^ (acc >> np.uint64(31)))


def _counts(k: int, log2: int):
    """A task's counters, in compressed segments."""

    def run(batches):
        import numpy as np
        import zstandard

        total = np.zeros(1 << log2, dtype=np.uint32)
        for batch in batches:
            at = np.concatenate([shingles(text, k) for text in batch["text"]]) >> np.uint64(64 - log2)
            at.sort()  # neighbours in memory, one after the other
            np.add.at(total, at.astype(np.int64), np.uint32(1))
        coder = zstandard.ZstdCompressor(level=1)
        parts = total.reshape(-1, SEGMENT)
        rows = [(i, coder.compress(parts[i].tobytes())) for i in np.flatnonzero(parts.any(axis=1)).tolist()]
        yield pd.DataFrame(rows, columns=["segment", "counts"])

    return run


def _levels(batches):
    """Sums of the segments, one at a time, as an eighth of an octave in a byte."""
    import numpy as np
    import zstandard

    coder, sums = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for segment, counts in zip(batch["segment"].to_numpy(dtype=np.int64).tolist(), batch["counts"], strict=True):
            part = np.frombuffer(coder.decompress(counts), dtype=np.uint32)
            sums[segment] = sums[segment] + part if segment in sums else part.astype(np.int64)
    for segment, total in sums.items():
        yield pd.DataFrame({"segment": [segment], "levels": [np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8).tobytes()]})


def _order(docs: DataFrame, k: int):
    """Levels (8 an octave) of the counts of all documents' k-grams by hashed counter: one byte a counter, 16 MB at most.

    The counters' number follows the length of all texts.  Each task sends its
    counters in compressed segments, and only the levels reach the driver.
    """
    import numpy as np

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    log2 = min(max((chars // 6 // COUNTER_LOAD).bit_length(), COUNTERS[0]), COUNTERS[1])
    segments = (1 << log2) // SEGMENT
    sent = map_slices(docs.select("text"), _counts(k, log2), "segment long, counts binary")
    rows = map_slices(sent.repartition(segments, "segment"), _levels, "segment long, levels binary").collect()
    out = np.zeros(1 << log2, dtype=np.uint8)
    for r in rows:
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.levels, dtype=np.uint8)
    return out


def _profiles(k: int, num: int, den: int, order):
    def run(batches):
        import numpy as np
        import xxhash

        rank = order.value
        log2 = len(rank).bit_length() - 1
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, k)
                n = len(s)
                if not n:
                    out.append((doc_id, 0, None, None, None, None))
                    continue
                f = rank[(s >> np.uint64(64 - log2)).astype(np.int64)]
                prefix = s[np.argsort(f, kind="stable")[: n + (-num * n // den) + 1]]
                bits = max(64 * WORDS, 1 << (n - 1).bit_length())
                place = ((s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(30)).astype(np.int64) & (bits - 1)
                large = np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))
                sketch = np.bitwise_xor.reduce(large.reshape(-1, 8 * WORDS)).view(np.int64)
                out.append((doc_id, n, xxhash.xxh128_digest(s.tobytes()), prefix.view(np.int64), sketch, large.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "fp", "prefix", "sketch", "large"]).astype({"doc_id": "Int64"})

    return run


def _sets(k: int, bitmap):
    def run(batches):
        for batch in batches:
            hit = batch if bitmap is None else batch[in_bitmap(bitmap.value, batch["h"])]
            yield pd.DataFrame({"node": hit["doc_id"], "members": [shingles(t, k).tobytes() for t in hit["text"]]})

    return run


def _sketches_allow(num: int, den: int):
    """Pairs whose large sketches (x, y) don't differ more than linked sets of m and n members can."""

    def run(batches):
        import numpy as np

        for batch in batches:
            keep = []
            for x, y, m, n in zip(batch["x"], batch["y"], batch["m"], batch["n"], strict=True):
                x, y = sorted((np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)), key=len)
                apart = int.from_bytes((x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).tobytes()).bit_count()
                keep.append(apart <= m + n - 2 * -(-num * (m + n) // (num + den)))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _verify(num: int, den: int):
    def run(batches):
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (len(both) - common))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Length, positional and suffix filter for two entries of one posting list."""
    total = f"({x}.n + {y}.n)"
    popcount = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(WORDS))
    return (
        F.expr(f"{den} * least({x}.n, {y}.n) >= {num} * greatest({x}.n, {y}.n)")
        & F.expr(f"(least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos)) * {num + den} >= {num} * {total}")
        & F.expr(f"{popcount} <= {total} - 2 * ((({num} * {total}) + {num + den - 1}) div {num + den})")
    )


def _links(docs: DataFrame, groups: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link, verified on whole sets."""
    spark = docs.sparkSession
    x, y = (groups.select(F.col("node").alias(c), F.col("large").alias(d), F.col("n").alias(e)) for c, d, e in (("a", "x", "m"), ("b", "y", "n")))
    pairs = stage_table(map_slices(pairs.join(x, "a").join(y, "b"), _sketches_allow(num, den), "a long, b long").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bitmap = id_bitmap(asked, "doc_id")
    ids = docs.where("doc_id is not null").select("doc_id", "text", id_hash("doc_id").alias("h"))
    if bitmap is None:
        ids = ids.join(asked, "doc_id", "left_semi")
    else:
        bitmap = spark.sparkContext.broadcast(bitmap)
    sets = stage_table(map_slices(ids, _sets(k, bitmap), "node long, members binary"), "sets")
    if bitmap is not None:
        bitmap.destroy()
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return stage_table(map_slices(joined, _verify(num, den), "a long, b long").distinct(), "links", pairs, sets)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(_order(docs, k))
    profiles = stage_table(map_slices(docs, _profiles(k, num, den, order), "doc_id long, n long, fp binary, prefix array<long>, sketch array<long>, large binary"), "profiles")
    order.destroy()

    groups = profiles.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("large").alias("large"))
    groups = stage_table(groups, "groups")
    entries = groups.select("node", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    live = entries.join(shared, "token")
    live = stage_table(live.join(groups.select("node", "n", "sketch"), "node"), "postings")

    links = _links(docs, groups, _pairs(_star(live.withColumn("comp", F.col("node")), "node", num, den)), k, num, den)
    near, spent = components(links), [links]
    for turn in range(TURNS + 1):
        now = live.join(near, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        lists = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.max("c").alias("m")).where("s > m")
        lists = stage_table(lists, "lists")
        spent.append(lists)
        entries, left = lists.agg(F.sum("s"), F.sum(F.col("m") * (F.col("s") - F.col("m")))).first()
        now = now.join(lists.select("token"), "token", "left_semi")
        if turn == TURNS or (left or 0) <= LEFT * (entries or 0):
            break
        # members of a large group stand apart yet: other hubs, few for each group, before all that are left meet
        other = _links(docs, groups, _pairs(_star(now, F.xxhash64("node", F.lit(turn), F.pmod("token", F.lit(HUBS))), num, den)), k, num, den)
        spent.append(other)
        if other.isEmpty():
            break
        spent.append(near)
        near = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(other))
    now = now.withColumn("parts", F.ceil(F.col("c") / HOT).cast("int"))
    # a long list is dealt to several tasks: each entry of one side stands in one part, each of the other side in all
    x = now.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & F.expr("x.comp < y.comp") & _may_link("x", "y", num, den))
    more = _links(docs, groups, _pairs(rest), k, num, den)  # none of them is known: links found before are within a component
    # the first components are stars already: only what the last step found is new
    found = near if more.isEmpty() else components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    heads = groups.select("fp", "node").join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    heads = stage_table(heads.groupBy("fp").agg(F.min("component").alias("component")), "heads", groups, live, *spent, more, near, found)  # so that the join's two exchanges are its own, and a hot set can be split
    return profiles.select("doc_id", "n", "fp").join(heads, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _star(entries: DataFrame, order: Column | str, num: int, den: int) -> DataFrame:
    """Entries (token, comp, node, n, pos, sketch) beside a hub of their list: the first by order, or the last for those of the first one's component."""
    at = F.struct("comp", "node", "n", "pos", "sketch")
    hubs = entries.groupBy("token").agg(F.min_by(at, F.struct(order, "node")).alias("lo"), F.max_by(at, F.struct(order, "node")).alias("hi"))
    return (
        entries.join(hubs, "token")
        .select("comp", F.struct("node", "n", "pos", "sketch").alias("x"), F.when(F.col("comp") != F.col("lo.comp"), F.col("lo")).otherwise(F.col("hi")).alias("y"))
        .where(F.col("comp") != F.col("y.comp"))
        .where(_may_link("x", "y", num, den))
    )


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).where("a < b").distinct()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose document has the smallest doc_id of its component; rows without doc_id stay."""
    small_batches(docs.sparkSession)
    name = fresh("gone", docs.columns)
    gone = jaccard_components(docs, k, num, den).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    gone = stage_table(gone, "gone")
    bitmap = id_bitmap(gone, name)
    if bitmap is None:
        return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
    # texts whose id isn't in the bitmap stay where they are; only the others are shuffled to the exact join
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    maybe = F.pandas_udf(_in(shared), "boolean")(F.coalesce(id_hash("doc_id"), F.lit(-1).cast("long")))
    rest = docs.where(maybe)
    return docs.where(~maybe).unionByName(rest.join(gone, rest["doc_id"] == F.col(name), "left_anti"))


def _in(bitmap):
    def run(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, h.clip(lower=0)) & (h >= 0).to_numpy())

    return run
