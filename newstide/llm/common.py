"""Helpers that the operators share: stage tables, bounded bitmaps, tokenizers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where none is set, a local master gets a temporary one (tests); any other
    master has executors on machines of their own, so that raises.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: stage tables need a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="newstide-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/newstide/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes this application's stage tables and shards: for when no returned frame is to be read any more.

    Operators remove the tables that they are through with; those that their
    result still reads stay until then.
    """
    remove(spark, _own_dir(spark))


def stage_table(df: DataFrame, name: str, *drop: DataFrame, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage.

    Unlike checkpoint(), the plan runs once and readers prune columns.  The
    tables in ``drop`` (made by this function) are removed once df is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    for old in drop:
        remove(spark, getattr(old, "_stage_path", ""))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a worker holds as Python objects at a time, and bounds of the Arrow batches that reach it.
SLICE_ROWS, BATCH_ROWS, BATCH_BYTES = 512, 2048, 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes: of whole texts, the default of 10,000 rows is many megabytes in the JVM and in the worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", spark.conf.get(key).lower()).groups()
        if not 0 < int(digits) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def map_slices(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over slices of the Arrow batches, so that a worker holds a few hundred rows as objects, not a whole batch.

    Whole numbers keep their type where a column holds nulls (then pandas.NA).
    What a task has freed goes back to the system when it ends, as workers are
    kept for other tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches):
        import pandas as pd
        import pyarrow as pa

        whole = {pa.int64(): pd.Int64Dtype()}.get
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS).to_pandas(types_mapper=whole)

    def mapped(batches):
        import pyarrow as pa

        for out in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        give_back()

    return df.mapInArrow(mapped, schema)


def give_back() -> None:
    """Returns what a worker has freed to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_RESIDENT: dict = {}


def resident(key: str, make):
    """What make() builds, kept in the worker under ``key`` until another key is asked for.

    Workers outlive their tasks and serve one operator after another: only the
    tables of the latest one (a tokenizer, a cache of words) stay in memory.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def fresh(name: str, columns) -> str:
    """A column name that starts with name and is none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(column) -> list:
    """The values of a column of whole numbers as Python integers, None for null."""
    import pandas as pd

    return [None if x is pd.NA or x is None or x != x else int(x) for x in column]


#: Bits of a Bloom bitmap for each id, and at most.
BITS_PER_ID, MAX_BITS = 16, 1 << 26


def id_bitmap(ids: DataFrame, col: str):
    """A Bloom bitmap (one hash) of the ids in one column, of 16 bits an id; None if that is over MAX_BITS (8 MB).

    So a test passes at most some 6 % of other ids, and never misses one; an
    exact join follows.  Without a bitmap callers join on the ids themselves.
    It is built by Spark's bitmap aggregate: what reaches the driver is at most
    MAX_BITS / 32768 rows of 4 KB.
    """
    import numpy as np

    n = ids.count()
    if n * BITS_PER_ID > MAX_BITS:
        return None
    bits = 1 << max(20, (n * BITS_PER_ID - 1).bit_length())
    rows = (
        ids.select(F.pmod(F.xxhash64(F.col(col)), F.lit(bits)).alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        at = (r.b - 1) * 4096 if r.b > 0 else bits // 8
        out[at : at + len(part)] = part
    return out


def id_hash(col: str):
    """The column that :func:`in_bitmap` tests."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(MAX_BITS))


def in_bitmap(bitmap, h):
    import numpy as np

    # bitmap_bucket_number(v) is v // 32768 + 1 for v > 0, position v % 32768, as the built-ins define them
    bits = (len(bitmap) - 4096) * 8  # a power of two, so the remainder of the remainder is the remainder
    h = np.asarray(h, dtype=np.int64) & (bits - 1)
    b, p = _bucket(h), _position(h)
    at = np.where(b > 0, (b - 1) * 4096, bits // 8) + p // 8
    return (bitmap[at] >> (p % 8).astype(np.uint8)) & 1 == 1


def _bucket(v):
    import numpy as np

    return np.where(v > 0, 1 + (v - 1) // 32768, 0)


def _position(v):
    import numpy as np

    return np.where(v > 0, (v - 1) % 32768, 0)


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, by the fast reader of its rank file where that gives the same ids.

    The JSON file defines the ids.  tiktoken reads the same vocabulary some five
    times faster; texts that hold a special token's string, and those that the
    fast reader refuses (very long runs of white space), go to ``tokenizers``,
    which is loaded when the first of them comes.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None):
        import json

        self.path, self._slow, self.fast = json_path, None, None
        with open(json_path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.size = 1 + max([*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])])
        if rank_path:
            import base64

            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, text: str):
        import numpy as np

        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError, UnicodeError):
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def byte_bpe(name: str = "byte_bpe_50k") -> ByteBpe:
    """The public tokenizer ``name``; one is resident in a worker."""
    return resident(f"byte-bpe {name}", lambda: _load(name))


def _load(name: str) -> ByteBpe:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
