"""Language identification by compression.

The whole texts of a bounded number of each language's labelled rows are a
zstandard raw-content dictionary.  A text is cut into blocks (so that a
dictionary still counts in long texts), each block is compressed with every
dictionary, and the language with the smallest sum wins; where the margin to the
next is narrow the answer is marked as rejected.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with
score 0; without any labelled row every text is; a null doc_id stays null.  Ties
go to the language with more labelled rows, then to the one that sorts first.
Rows with a null lang teach nothing.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, resident

#: Bounds of what is learned from, for each language: rows, and code points of their texts together.
SAMPLE_ROWS, DICT_CHARS = 400, 1 << 19
BLOCK = 1024
LEVEL = 6
#: A margin under this (bytes saved for each byte of text) is narrow.
NARROW = 0.01


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def train(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each lang of labelled(doc_id, text, lang), most labelled first: whole texts of hash-drawn rows.

    Rows are taken in the order of their draws, each with its whole text, while
    they are within SAMPLE_ROWS and their texts together within DICT_CHARS; a
    text that is longer than that alone gives a span of DICT_CHARS from a
    hash-drawn place.  So no part of a text is preferred.
    """
    labelled = labelled.where("lang is not null and text is not null")
    n = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not n:
        return {}
    share = F.create_map(*[x for lang, k in n.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * SAMPLE_ROWS / k)))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.lit("span"), "doc_id", "text"), F.greatest(F.length("text") - DICT_CHARS, F.lit(0)) + 1) + 1
    rows = labelled.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), F.substring(F.col("text"), start.cast("int"), F.lit(DICT_CHARS)).alias("text"))
    rows = rows.groupBy("lang", "text").agg(F.min("draw").alias("draw"))  # a copy teaches nothing more
    drawn = Window.partitionBy("lang").orderBy("draw", "text")  # some 2 * SAMPLE_ROWS rows of a language
    rows = rows.withColumn("rank", F.row_number().over(drawn)).withColumn("chars", F.sum(F.length("text") + 1).over(drawn))
    out: dict[str, list[bytes]] = {}
    for r in rows.where((F.col("rank") == 1) | (F.col("rank") <= SAMPLE_ROWS) & (F.col("chars") <= DICT_CHARS)).select("lang", "rank", "text").collect():
        out.setdefault(r.lang, []).append((r["rank"], _plain(r.text)))
    # the first draws last: zstandard finds what is near the end best
    return {lang: b" ".join(text for _, text in sorted(out[lang], reverse=True)) for lang in sorted(out, key=lambda lang: (-n[lang], lang))}


def _coders(dicts: dict[str, bytes]) -> dict:
    import zstandard as z

    coders = {}
    for place, (lang, data) in enumerate(dicts.items()):
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders[place, lang] = z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)
    return coders


def _predict(dicts, made_of: str):
    def run(batches):
        import math

        coders = resident(f"langid {made_of}", lambda: _coders(dicts.value))
        for batch in batches:
            lang, score, narrow = [], [], []
            for text in batch["text"]:
                data = _plain(text) if text is not None and coders and any(map(str.isalpha, text)) else b""
                if not data:
                    lang.append("und"), score.append(0.0), narrow.append(True)
                    continue
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                size = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in coders.items())
                rates = [s / len(data) for s, _ in size]
                lang.append(size[0][1][1])
                score.append(1 / sum(math.exp(-30 * min(r - rates[0], 20)) for r in rates))
                narrow.append(len(rates) > 1 and rates[1] - rates[0] < NARROW)
            yield batch.drop(columns=["text"]).assign(lang_pred=lang, score=score, rejected=narrow)

    return run


def identify(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """The columns of docs but text, with lang_pred, score (0 to 1) and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")  # the result's own names
    shared = docs.sparkSession.sparkContext.broadcast(dicts)
    made_of = hashlib.sha256(repr([(k, zlib.crc32(v), len(v)) for k, v in dicts.items()]).encode()).hexdigest()
    rest = [f for f in docs.schema if f.name != "text"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string", "score double", "rejected boolean"])
    return map_slices(docs, _predict(shared, made_of), ddl)
