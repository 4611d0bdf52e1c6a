"""The opN queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, langid, licenses, middle, ngram_join, oracles, order, packing, pieces, quality, rules, stream_bpe, topk, urls
from .common import stage_table, table


#: (host, path start, verdict) of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document by the weakly supervised scorer."""
    return quality.score(table(spark, sf_dir, "documents"))


def op2_pack_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"), seed=1, rate=0.1)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict by the frequency of its lines across documents."""
    return rules.judge(table(spark, sf_dir, "documents"), host="source")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own or inherited license of every document.

    Documents have no paths; a stand-in tree is made of source, language and
    two digits of the id, and every fifth document is a LICENSE file, at one of
    the tree's four depths; other documents lie in the deepest folders.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    digit = lambda n: (F.floor(F.col("doc_id") / n) % 10).cast("string")
    steps = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(digit(1000), F.lit("x")), F.coalesce(digit(100), F.lit("x")))
    is_license = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    depth = F.when(is_license, (F.floor(F.col("doc_id") / 5) % 4 + 1).cast("int")).otherwise(4)
    name = F.when(is_license, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    path = F.concat(F.array_join(F.slice(steps, 1, depth), "/"), F.lit("/"), name)
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op7_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    dicts = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), dicts)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule's, else the trees'."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and byte offset of every sequence of the documents' ids; the shards are written to the shared folder."""
    return order.materialise(table(spark, sf_dir, "documents"))[0]


def op11_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the streaming transducer, and what they decode to: their number and digests."""
    rows = stream_bpe.round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle example, and the text rebuilt from it: sizes and digests."""
    rows = middle.transform(table(spark, sf_dir, "documents"), "words", seed=42, percent=50, spm_percent=80)
    restored = middle.restore(F.col("output"), F.col("form"))
    sizes = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers' tokens in every document, scored by the documents that hold each pair."""
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    rows = alignment.groups(table(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups")
    return alignment.scored(stage_table(rows, "aligned", compression="zstd"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_pack_minimum_bin_slack,
        op3_merge_dropout,
        op4_ngram_jaccard_join,
        op5_quality_rules,
        op6_license_scan,
        op7_language_by_compression,
        op8_exact_top_k,
        op9_url_filter,
        op10_training_order,
        op11_streaming_bpe,
        op12_fill_in_middle,
        op13_cross_tokenizer_alignment,
    )
}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": oracles.OP4, "op5_quality_rules": oracles.OP5, "op8_exact_top_k": oracles.OP8, "op12_fill_in_middle": oracles.OP12}
