"""Packing by minimum bin slack.

Documents become token ids with an end id, cut into whole windows and one
remainder.  Only the histogram of remainder lengths (at most ``window`` counts,
whatever the data) reaches the driver.  There each sequence shape is found by a
bitset subset-sum dynamic program over the remaining multiset: the largest
length left opens a window, the program finds the multiset that fills the rest
closest to capacity, counts are read back by backtracking, and the shape is
used as often as the counts allow.  Executors then number the pieces of each
length (ranked within salts, as many as a length's number of pieces asks for,
so that a length that a third of all documents share is not one task) and look
their place up in the plan.

Nulls and edge cases: a null or empty text is the end id alone; rows that
repeat are packed one by one (every piece has a number of its own); a null
doc_id stays null; an empty table has no sequences; other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_bpe, map_slices, stage_table

#: Each length is ranked in so many salts at least, and with about so many pieces in a salt at most.
SALTS, SALT_ROWS = 64, 1 << 16


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: pieces}) of the sequence shapes for a histogram of lengths."""
    left = {size: n for size, n in counts.items() if n > 0}
    shapes = []
    while left:
        sizes = sorted(left, reverse=True)
        head = sizes[0]
        shape = _closest(left, sizes, window - head, head)
        shape[head] = shape.get(head, 0) + 1
        times = min(left[size] // n for size, n in shape.items())
        shapes.append((times, shape))
        for size, n in shape.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return shapes


def _closest(left: dict[int, int], sizes: list[int], room: int, head: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to room from below, with one piece of head taken already."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sizes:
        have = min(left[size] - (size == head), room // size)
        step = 1
        while have > 0 and not reach >> room & 1:  # counts in binary parts: 1, 2, 4, ..., rest
            part = min(step, have)
            steps.append((size, part, reach))
            reach |= (reach << (size * part)) & mask
            have -= part
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for size, part, before in reversed(steps):
        if not before >> total & 1:
            total -= size * part
            out[size] = out.get(size, 0) + part
    return out


def _pieces(window: int, end_id: int, keep_ids: bool):
    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        bpe, number = byte_bpe(), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), number, *([part.tobytes()] if keep_ids else [])))
                    number += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", *(["ids"] if keep_ids else [])]).astype({"doc_id": "Int64"})

    return run


def _place(first, steps):
    """first: for each length its first cell and, by cell (a salt of a length), numbers of earlier pieces; steps: by length the plan's ranges of ranks."""

    def run(batches):
        import numpy as np

        start, before = first.value
        for batch in batches:
            length = batch["length"].to_numpy(dtype=np.int64)
            rank = batch["rank"].to_numpy(dtype=np.int64) - 1 + before[start[length] + batch["salt"].to_numpy(dtype=np.int64)]
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                upto, each, base, where = steps.value[int(size)]
                k = np.searchsorted(upto, rank[at], side="right")
                inner = rank[at] - np.where(k > 0, upto[k - 1], 0)
                sequence[at] = base[k] + inner // each[k]
                offset[at] = where[k] + inner % each[k] * size
            yield batch.drop(columns=["rank", "salt", "piece"]).assign(sequence_id=sequence, offset=offset)

    return run


def _counts(pieces: DataFrame, by: list[str], size: int):
    import numpy as np

    seen = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).toPandas()
    return seen, np.bincount(seen["length"].to_numpy(dtype=np.int64), weights=seen["n"].to_numpy(dtype=float), minlength=size).astype(np.int64)


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of docs(doc_id, text) with its place: sequence_id and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    with keep_ids also ids (little-endian unsigned 32-bit).
    """
    import numpy as np

    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    ids = ", ids binary" * keep_ids
    pieces = stage_table(map_slices(docs.select("doc_id", "text"), _pieces(window, end_id, keep_ids), f"{schema}, piece long{ids}"), "pieces")

    _, totals = _counts(pieces, ["length"], window + 1)  # at most window rows
    salts = np.maximum(SALTS, -(-totals // SALT_ROWS))
    salt = F.pmod(F.xxhash64("piece"), F.element_at(F.lit(salts.tolist()), (F.col("length") + 1).cast("int"))).cast("int")
    pieces = pieces.withColumn("salt", salt)
    seen, _ = _counts(pieces, ["length", "salt"], window + 1)  # at most a row for each SALT_ROWS pieces, and window * SALTS
    start = np.cumsum(salts) - salts
    cells = np.zeros(int(salts.sum()), dtype=np.int64)
    cells[start[seen["length"].to_numpy(dtype=np.int64)] + seen["salt"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy(dtype=np.int64)
    before = np.cumsum(cells) - cells
    before -= np.repeat(before[start], salts)

    ranges: dict[int, list] = {}
    sequence = 0
    for times, shape in [(int(totals[window]), {window: 1})] * bool(totals[window]) + plan({i: int(totals[i]) for i in range(1, window)}, window):
        offset = 0
        for size in sorted(shape, reverse=True):
            ranges.setdefault(size, []).append((times * shape[size], shape[size], sequence, offset))
            offset += size * shape[size]
        sequence += times
    steps = {}
    for size, parts in ranges.items():
        n, each, base, where = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        steps[size] = (np.cumsum(n), each, base, where)

    first, steps = spark.sparkContext.broadcast((start, before)), spark.sparkContext.broadcast(steps)
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece")).cast("long"))
    return map_slices(ranked, _place(first, steps), f"{schema}{ids}, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids: the padded sequences of pieces that were packed with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence: at most window pieces
    joined = pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    pad = F.lit(pad_id.to_bytes(4, "little") * window)
    return joined.withColumn("ids", F.concat("ids", F.substring(pad, F.lit(1), F.lit(4 * window) - F.length("ids"))))
