"""Alignment of two tokenizers over the same texts, and how often their tokens meet in a corpus.

Both tokenizers cut a space and the text into byte intervals.  Where a token of
each ends at one byte, a group ends; tokens of one group are linked.  The
interval tables of a slice of documents lie on one axis of bytes, one document
after the other, and DuckDB works on them inside the task: a token of A that
starts where one of B does opens a group, a window sum numbers the groups, an
ASOF join finds the group of each token of B, and links are counted by pairs of
ids within documents.  Groups of many tokens are met by their distinct ids, so
no list of all their pairs is made.  Each slice also tells in how many of its
documents it has seen each pair of ids; Spark adds that up over the corpus.

A second step gives every document the counts of its pairs.  The pairs that
hold at least 1 / HOT of all rows are HOT at most, so they go to the tasks by
broadcast; any other pair is a small share of the rows, and meets its count in
a shuffle.

Nulls and edge cases: null and empty texts, and texts whose tokens' bytes don't
join to a space and the text (U+2581, which the second tokenizer reads as a
space), have no tokens: zeros, no groups.  Strings of special tokens are plain
text.  Every row is a document, rows that repeat and rows without doc_id, too;
an empty table gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_slices, resident, stage_table

#: Bytes of text in a slice (a longer text is a slice of its own), pairs of tokens from which a group counts as large, pairs of ids that are broadcast.
SLICE_BYTES, LARGE, HOT = 1 << 21, 256, 8192
SPACE = "▁"
SCHEMA = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<long>, seen_a array<int>, seen_b array<int>, seen array<int>"


class Tokenizers:
    """Both tokenizers, with the bytes of every id; one is resident in a worker."""

    def __init__(self, byte_name: str, piece_name: str):
        import os

        import numpy as np
        import public_tokenizers
        import pyarrow as pa
        import sentencepiece

        from .common import ByteBpe

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = ByteBpe(public_tokenizers.path(f"{byte_name}.json"), public_tokenizers.path(f"{byte_name}.tiktoken"), public_tokenizers.PATTERN)
        self.json = public_tokenizers.path(f"{byte_name}.json")
        self.plain = None
        fast = self.a.fast
        self.width_a = np.zeros(self.a.size, dtype=np.int64)
        for i in range(fast.n_vocab):
            self.width_a[i] = len(fast.decode_single_token_bytes(i))
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{piece_name}.model"))
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in (self.b.id_to_piece(i),)]
        self.width_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        top = max(self.a.size, n)
        self.written = pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(top)], pa.large_string())  # ids with what follows them
        self.top = top

    def ids_a(self, text: str):
        """Ids of a text in which special tokens' strings are plain text."""
        import numpy as np

        try:
            return self.a.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except (ValueError, RuntimeError, UnicodeError):
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.json)
                self.plain.encode_special_tokens = True
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def both(self, texts: list[str | None]):
        """For each text its ids of both, None where it has no tokens."""
        import numpy as np

        full = [i for i, t in enumerate(texts) if t]
        out = [None] * len(texts)
        pieces = self.b.encode([texts[i] for i in full], num_threads=1) if full else []
        for i, found in zip(full, pieces, strict=True):
            raw = (" " + texts[i]).encode()
            b = np.array(found, dtype=np.int32)
            # the pieces are those of the text's own characters, but for U+2581, which takes a space's byte for three
            if int(self.width_b[b].sum()) != len(raw) or SPACE in texts[i] and b"".join(map(self.bytes_b.__getitem__, found)) != raw:
                continue
            a = self.ids_a(" " + texts[i])
            if int(self.width_a[a].sum()) == len(raw):
                out[i] = a, b
        return out


#: The work on one slice: tables ta(d, id, s) and tb(id, s) of tokens by document, id and start.
GROUPS = (
    # a token of A opens a group where a token of B starts, too
    "create or replace temp table ga as select d, id, s, opens, cast(sum(opens) over (order by s rows unbounded preceding) as int) as g "
    "from (select ta.d, ta.id, ta.s, cast(tb.s is not null as int) as opens from ta left join tb on ta.s = tb.s)",
    # the group of a token of B is the last that starts at or before it
    "create or replace temp table gb as select tb.id, tb.s, o.g from tb asof join (select s, g from ga where opens = 1) o on tb.s >= o.s",
)
#: Links by pairs of ids; those of large groups by their distinct ids.
LINKS = "create or replace temp table pairs as select ga.d as d, ga.id as a, gb.id as b, count(*) as times from ga join gb on ga.g = gb.g group by all"
LARGE_LINKS = """create or replace temp table pairs as select d, a, b, cast(sum(times) as bigint) as times from (
    select ga.d as d, ga.id as a, gb.id as b, 1 as times from ga join gb on ga.g = gb.g where ga.g not in (select g from large)
    union all
    select x.d, x.id, y.id, x.n * y.n from (select d, g, id, count(*) as n from ga where g in (select g from large) group by all) x
        join (select g, id, count(*) as n from gb where g in (select g from large) group by all) y on x.g = y.g
) group by all"""


def _connection():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("set threads = 1")
    con.execute("set memory_limit = '1GB'")
    return con


def _slice(con, tools: Tokenizers, found) -> dict:
    """Columns of SCHEMA, without key and doc_id, of a slice's documents; found: ids of both of each, or None."""
    import numpy as np
    import pyarrow as pa

    n = len(found)
    empty = np.empty(0, dtype=np.int32)
    ids_a = [f[0] if f else empty for f in found]
    ids_b = [f[1] if f else empty for f in found]
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    out = {"n_a": n_a, "n_b": n_b}
    if not len(a):
        zeros = np.zeros(n, dtype=np.int64)
        nothing = [empty] * n
        return out | {"n_groups": zeros, "n_links": zeros, "groups": [""] * n} | dict.fromkeys(("a", "b", "times", "seen_a", "seen_b", "seen"), nothing)
    # documents lie one after the other on an axis of bytes; int32 holds a slice, and int64 one text of over 2 GB
    end_a, end_b = np.cumsum(tools.width_a[a]), np.cumsum(tools.width_b[b])
    kind = np.int32 if end_a[-1] < 1 << 31 else np.int64
    doc = np.repeat(np.arange(n, dtype=np.int32), n_a)
    con.register("ta", pa.table({"d": doc, "id": a, "s": (end_a - tools.width_a[a]).astype(kind)}))
    con.register("tb", pa.table({"id": b, "s": (end_b - tools.width_b[b]).astype(kind)}))
    for step in GROUPS:
        con.execute(step)
    group_a = con.execute("select g from ga order by s").fetchnumpy()["g"]
    group_b = con.execute("select g from gb order by s").fetchnumpy()["g"]
    many_a, many_b = np.bincount(group_a), np.bincount(group_b)  # tokens of each group
    large = np.flatnonzero(many_a * many_b > LARGE)
    if len(large):
        con.register("large", pa.table({"g": large.astype(np.int32)}))
    con.execute(LARGE_LINKS if len(large) else LINKS)
    pairs = con.execute("select d, a, b, times from pairs order by d").fetchnumpy()
    seen = con.execute("select a, b, cast(count(*) as int) as seen from pairs group by all").fetchnumpy()
    for name in ["ta", "tb", *(["large"] if len(large) else [])]:
        con.unregister(name)
    cut = np.searchsorted(pairs["d"], np.arange(1, n))
    out["n_groups"] = np.bincount(doc, weights=np.diff(group_a, prepend=0), minlength=n).astype(np.int64)
    ends = np.append(0, np.cumsum(pairs["times"]))[np.concatenate([[0], cut, [len(pairs["d"])]])]
    out["n_links"] = np.diff(ends)
    out["groups"] = _written(tools, a, b, group_a, group_b, many_a, many_b, n_a + n_b)
    out |= {"a": np.split(pairs["a"], cut), "b": np.split(pairs["b"], cut), "times": np.split(pairs["times"], cut)}
    return out | {c: [seen[k]] + [empty] * (n - 1) for c, k in (("seen_a", "a"), ("seen_b", "b"), ("seen", "seen"))}


def _written(tools: Tokenizers, a, b, group_a, group_b, many_a, many_b, sizes) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each document: its groups in order, ids of A before those of B."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last = lambda g: np.append(g[1:] != g[:-1], True)
    at = np.empty(len(a) + len(b), dtype=np.int32)
    at[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a + last(group_a) * tools.top  # after all of B in earlier groups
    at[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b + last(group_b) * (2 * tools.top)  # after all of A up to its group
    ends = np.append(0, np.cumsum(sizes))
    at[ends[1:][np.flatnonzero(sizes)] - 1] += tools.top  # nothing follows a document's last id
    told = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tools.written.take(pa.array(at)))
    return pc.binary_join(told, pa.scalar("", pa.large_string())).to_pylist()


def groups(docs: DataFrame, byte_name: str = "byte_bpe_50k", piece_name: str = "piece_bpe_32k") -> DataFrame:
    """SCHEMA of each row of docs(doc_id, text): counts, the groups as text, and what :func:`scores` needs.

    a, b, times: the document's distinct linked pairs of ids and their links;
    seen_a, seen_b, seen: for one row of each slice, how many of the slice's
    documents hold each pair.  ``key`` names a row, and comes anew whenever the
    frame is computed: it is to be written once before it is read twice.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        tools = resident(f"alignment {byte_name} {piece_name}", lambda: Tokenizers(byte_name, piece_name))
        con, done = _connection(), 0
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                part = _slice(con, tools, tools.both(texts[at:to]))
                keys = [first + done + i for i in range(to - at)]
                yield pd.DataFrame({"key": keys, "doc_id": ids.iloc[at:to].array} | part)
                done, at = done + to - at, to
        con.close()
        give_back()

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA)


def counts(rows: DataFrame) -> DataFrame:
    """a, b, n (documents of the corpus that hold the pair) and best (no other pair of a has more), from written rows of :func:`groups`."""
    seen = rows.where("size(seen) > 0").select(F.explode(F.arrays_zip("seen_a", "seen_b", "seen")).alias("p"))
    summed = stage_table(seen.groupBy(F.col("p.seen_a").alias("a"), F.col("p.seen_b").alias("b")).agg(F.sum("p.seen").alias("n")), "pair-counts")
    most = summed.groupBy("a").agg(F.max("n").alias("_most"))
    return stage_table(summed.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best")), "pair-best", summed)


def scores(rows: DataFrame) -> DataFrame:
    """key, n_best (links whose pair is the best of its a) and count_sum (the pairs' counts over all links), from written rows of :func:`groups`."""
    found = counts(rows)
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(found.where(F.col("n") * F.lit(HOT) >= F.lit(total)))  # the n sum to total: HOT rows at most
    pairs = rows.where("size(a) > 0").select("key", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("key", "p.a", "p.b", "p.times")
    sums = [F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("times").cast("long") * F.col("n")).alias("count_sum")]
    near = pairs.join(hot, ["a", "b"]).groupBy("key").agg(*sums)
    cold = found.where(F.col("n") * F.lit(HOT) < F.lit(total))
    far = pairs.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(cold.hint("merge"), ["a", "b"]).groupBy("key").agg(*sums)
    return near.unionByName(far).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def scored(rows: DataFrame) -> DataFrame:
    """Written rows of :func:`groups` with n_best and count_sum."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = [c for c in rows.columns if c not in ("key", "a", "b", "times", "seen_a", "seen_b", "seen")]
    return rows.select("key", *kept).join(scores(rows), "key", "left").select(*kept, zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best and count_sum of each row of docs(doc_id, text)."""
    return scored(stage_table(groups(docs, **names), "aligned", compression="zstd"))
