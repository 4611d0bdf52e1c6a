"""Training-order materialisation of token ids as fixed-stride binary shards.

The documents of an input partition are laid end to end and cut into sequences
of ``window`` ids, so that only a partition's last sequence is padded.  Every
sequence has a number from 0 to N-1: the offset of its part plus its place in
the part.  A keyed Feistel permutation over the smallest even number of bits
that holds N, walked along its cycle while outside [0, N), maps the number to a
global slot: a shuffle of the whole corpus without a sort, that any reader can
invert.  Sequences then go, in compressed blocks, to the task of their range of
slots, which writes the range as one shard with a record of fixed stride for
each slot.

Resuming: the folder holds the table of numbered sequences and the shards, all
under names with a fingerprint of what decides their bytes (documents, key,
window, end and pad id, tokenizer, records a shard).  A run over the same
documents with the same parameters takes the table that it finds complete, so
its numbers don't depend on how the input is split this time, and keeps the
shards whose size and crc32 fit; all else is written anew, beside what other
runs have left.  ``order.json`` names the latest complete run, and readers start
from it.  A lost executor's task writes the same bytes again.

Nulls and edge cases: a null or empty text is the end id alone; rows that
repeat are documents of their own; a null doc_id stays null; an empty table has
no shards; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bpe, map_slices, new_path, stage_table, whole

ROUNDS = 4
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(x, key: int, r: int, bits: int):
    import numpy as np

    u = np.uint64
    x = (x + u((key + r * 0x9E3779B97F4A7C15) % 2**64)) * u(_M1)
    x = (x ^ (x >> u(29))) * u(_M2)
    return (x >> u(32)) & u((1 << bits) - 1)


def _feistel(x, key: int, bits: int, back: bool):
    import numpy as np

    u, mask = np.uint64, np.uint64((1 << bits) - 1)
    left, right = x >> u(bits), x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, r, bits), left
        else:
            left, right = right, left ^ _round(right, key, r, bits)
    return (left << u(bits)) | right


def permute(numbers, n: int, key: int, back: bool = False):
    """The slots of sequence numbers in [0, n); with back, the numbers of slots."""
    import numpy as np

    bits = _half_bits(n)
    out = _feistel(np.asarray(numbers, dtype=np.uint64), key, bits, back)
    outside = np.flatnonzero(out >= n)
    while len(outside):  # cycle-walking: fewer than four steps a number on average
        out[outside] = _feistel(out[outside], key, bits, back)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def _windows(window: int, end_id: int, tokenizer: str, kind: str):
    """Sequences of a partition's documents laid end to end; each row lists the documents' pieces in it."""

    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        bpe, part, at = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        end, open_ids, fill, pieces, rows = np.array([end_id], dtype=kind), np.zeros(window, dtype=kind), 0, [], []

        def close():
            nonlocal at, fill, pieces
            rows.append((part, at, fill, open_ids[:fill].tobytes(), *map(list, zip(*pieces, strict=True))))
            at, fill, pieces = at + 1, 0, []

        def frame():
            out = pd.DataFrame(rows, columns=["part", "at", "n_ids", "ids", "doc_id", "start", "n_tokens", "ids_crc32", "place"])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(whole(batch["doc_id"]), batch["text"], strict=True):
                ids, start = np.concatenate((bpe.encode(text or "").astype(kind), end)), 0
                while start < len(ids):
                    data = ids[start : start + window - fill]
                    open_ids[fill : fill + len(data)] = data
                    pieces.append((doc_id, start, len(data), zlib.crc32(data.tobytes()), fill))
                    start, fill = start + len(data), fill + len(data)
                    if fill == window:
                        close()
                if len(rows) >= 4096:
                    yield frame()
            if rows:
                yield frame()
        if fill:
            close()
            yield frame()

    return run


_SEQUENCE = "part int, at long, n_ids int, ids binary, doc_id array<long>, start array<long>, n_tokens array<long>, ids_crc32 array<long>, place array<int>"


def _numbers(first, parts, at):
    """The sequences' numbers: first is a sorted pair of arrays (part, number of sequences before it)."""
    import numpy as np

    return first[1][np.searchsorted(first[0], np.asarray(parts))] + np.asarray(at)


def _slots(n: int, key: int, first):
    def run(part, at):
        import pandas as pd

        return pd.Series(permute(_numbers(first.value, part, at), n, key))

    return run


def _deal(n: int, key: int, per_shard: int, first, flush: int = 1 << 26):
    """Sequences gathered by shard into compressed blocks, at most some ``flush`` bytes held at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import zstandard

        coder = zstandard.ZstdCompressor(level=6)
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def blocks():
            rows = []
            for shard, (slots, ids) in held.items():
                lengths = np.fromiter(map(len, ids), dtype="<i4", count=len(ids))
                rows.append((shard, np.array(slots, dtype="<i8").tobytes(), lengths.tobytes(), coder.compress(b"".join(ids))))
            held.clear()
            return pd.DataFrame(rows, columns=["shard", "slots", "lengths", "ids"])

        for batch in batches:
            slot = permute(_numbers(first.value, batch["part"], batch["at"]), n, key)
            for at, ids in zip(slot.tolist(), batch["ids"], strict=True):
                slots, data = held.setdefault(at // per_shard, ([], []))
                slots.append(at)
                data.append(ids)
                size += len(ids)
            if size > flush:
                yield blocks()
                size = 0
        if held:
            yield blocks()

    return run


def _there(store, name: str, data) -> bool:
    """Whether the file holds just these bytes, by size and crc32."""
    from pyarrow import fs

    info = store.get_file_info(name)
    if info.type != fs.FileType.File or info.size != len(data):
        return False
    crc = 0
    with store.open_input_stream(name) as f:
        while part := f.read(1 << 22):
            crc = zlib.crc32(part, crc)
    return crc == zlib.crc32(data)


def _write(directory: str, mark: str, n: int, per_shard: int, stride: int, pad: bytes):
    """Writes the shards of a task's blocks; yields a row for each."""

    def run(batches):
        import uuid

        import numpy as np
        import pandas as pd
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory)
        coder = zstandard.ZstdDecompressor()
        shards: dict[int, bytearray] = {}
        for batch in batches:
            for shard, slots, lengths, ids in batch[["shard", "slots", "lengths", "ids"]].itertuples(index=False):
                if shard not in shards:
                    shards[shard] = bytearray(pad * (min(per_shard, n - shard * per_shard) * stride // len(pad)))
                data, start = coder.decompress(ids), 0
                for slot, length in zip(np.frombuffer(slots, "<i8").tolist(), np.frombuffer(lengths, "<i4").tolist(), strict=True):
                    at = (slot - shard * per_shard) * stride
                    shards[shard][at : at + length] = data[start : start + length]
                    start += length
        rows = []
        for shard, data in sorted(shards.items()):
            name = f"{root}/{_shard_name(mark, shard)}"
            if not _there(store, name, data):
                part = f"{root}/.{mark}-{shard:08d}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, name)
            rows.append((shard, shard * per_shard, len(data) // stride, len(data), zlib.crc32(data)))
        yield pd.DataFrame(rows, columns=["shard", "first_slot", "records", "bytes", "crc32"])

    return run


def _shard_name(mark: str, shard: int) -> str:
    return f"shard-{mark}-{shard:08d}.bin"


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _mark(docs: DataFrame, told: dict) -> str:
    """Fingerprint of the documents (whatever their order and partitions) and of the parameters."""
    h = F.xxhash64("doc_id", "text")
    seen = docs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return hashlib.sha256(json.dumps([told, *seen], sort_keys=True).encode()).hexdigest()[:16]


def materialise(docs: DataFrame, directory: str | None = None, window: int = 512, end_id: int = 1, pad_id: int = 0, key: int = 20250101, per_shard: int = 1 << 15, tokenizer: str = "byte_bpe_50k"):
    """Writes the shards of docs(doc_id, text); returns (pieces, shards, directory).

    pieces, a row for each part of a document in a sequence: doc_id, start (its
    document's ids before it), n_tokens, ids_crc32, slot, place (ids before it
    in the sequence), shard, byte_offset (of its first id in the shard).
    shards: shard, first_slot, records, bytes, crc32.  Records are little-endian
    unsigned ids of 16 bits (32 where the vocabulary needs them), padded to
    window with pad_id.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    directory = directory or new_path(spark, "shards")
    width = 2 if max(byte_bpe(tokenizer).size, end_id + 1, pad_id + 1) <= 1 << 16 else 4
    told = {"window": window, "end_id": end_id, "pad_id": pad_id, "key": key, "per_shard": per_shard, "tokenizer": tokenizer, "width": width}
    mark = _mark(docs, told)
    table = f"{directory}/sequences-{mark}"
    store, done = _store(spark, f"{table}/_SUCCESS")
    if not store.exists(done):
        cut = map_slices(docs, _windows(window, end_id, tokenizer, f"<u{width}"), _SEQUENCE)
        cut.write.options(compression="zstd", **{"parquet.compression.codec.zstd.level": "6"}).mode("overwrite").parquet(table)
    parts = spark.read.schema(_SEQUENCE).parquet(table)

    first, n = _first(parts)
    shards, stride = -(-n // per_shard), width * window
    dealt = map_slices(parts.select("part", "at", "ids"), _deal(n, key, per_shard, first), "shard long, slots binary, lengths binary, ids binary")
    dealt = dealt.repartitionById(max(1, shards), F.col("shard").cast("int"))
    written = stage_table(map_slices(dealt, _write(directory, mark, n, per_shard, stride, pad_id.to_bytes(width, "little")), "shard long, first_slot long, records long, bytes long, crc32 long"), "manifest")
    for name in (f"order-{mark}.json", "order.json"):  # only now: readers never see a run that was cut off
        _, path = _store(spark, f"{directory}/{name}")
        out = store.create(path, True)
        out.write(json.dumps(told | {"mark": mark, "records": n}, sort_keys=True).encode())
        out.close()

    slot = F.pandas_udf(_slots(n, key, first), "long")(F.col("part"), F.col("at"))
    each = F.inline(F.arrays_zip("doc_id", "start", "n_tokens", "ids_crc32", "place"))
    pieces = parts.withColumn("slot", slot).select("slot", each).withColumn("shard", F.floor(F.col("slot") / per_shard))
    offset = (F.col("slot") - F.col("shard") * per_shard) * stride + F.col("place") * width
    return pieces.select("doc_id", "start", "n_tokens", "ids_crc32", "slot", F.col("place").cast("long").alias("place"), "shard", offset.alias("byte_offset")), written, directory


def _first(parts: DataFrame):
    """Broadcast arrays (part, sequences before it), and the number of sequences.

    16 bytes for each task that cut sequences: the driver that schedules so
    many tasks holds more for each.
    """
    import numpy as np

    sizes = sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    part, size = (np.array(x, dtype=np.int64) for x in zip(*sizes, strict=True)) if sizes else (np.empty(0, dtype=np.int64),) * 2
    return parts.sparkSession.sparkContext.broadcast((part, np.cumsum(size) - size)), int(size.sum())


def read_slots(directory: str, first: int, count: int, mark: str | None = None):
    """Ids of the slots first to first + count - 1, one row each, read by seeking: how a training run resumes.

    mark picks a run by its fingerprint; else it is the latest one.
    """
    import numpy as np
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(directory)
    with store.open_input_stream(f"{root}/order-{mark}.json" if mark else f"{root}/order.json") as f:
        told = json.loads(f.read())
    window, width, per_shard = told["window"], told["width"], told["per_shard"]
    out = [np.empty((0, window), dtype=f"<u{width}")]
    count = min(count, told["records"] - first)
    while count > 0:
        shard, at = divmod(first, per_shard)
        take = min(count, per_shard - at)
        with store.open_input_file(f"{root}/{_shard_name(told['mark'], shard)}") as f:
            f.seek(at * width * window)
            out.append(np.frombuffer(f.read(take * width * window), dtype=f"<u{width}").reshape(-1, window))
        first, count = first + take, count - take
    return np.concatenate(out)
