"""Quality rules: base counts of a text, and the frequency of its lines across documents.

Everything is DataFrame functions.  One pass over the texts leaves a table of
base counts and hashed, normalised lines (lower case, runs of white space as one
space); all else reads that.  The distinct documents of a host that hold a line
are counted, a document being its text: exact copies are one document, or else
every line of a text that is copied often would count as boilerplate.  A line
above the host's limit is removed, and a document that loses more than half the
words of its distinct lines is rejected as depleted.

Nulls and edge cases: a null text has no words (all counts 0, base failed); a
null host is the host of the empty name; rows that repeat get the same result
each; rows are matched by their number in the table or by hashes of id and
text, so repeated or null ids do no harm; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage_table

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"
#: A line is removed where more distinct texts of its host hold it than both: so many, and so great a share of the host's.
MAX_TEXTS, MAX_SHARE = 30, 0.05
#: A document is depleted when it keeps less than this share of the words of its distinct lines.
MIN_LEFT = 0.5


def _words(text: str) -> Column:
    bare = F.btrim(F.col(text), F.lit(BLANKS))
    return F.when(bare != "", F.split(bare, BLANK)).otherwise(F.expr("cast(array() as array<string>)"))


def base_counts(docs: DataFrame, *of_lines: Column) -> DataFrame:
    """docs(doc_id, text and others) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, without text.

    of_lines: named columns made of _l, the text's lines that hold a word.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    a = docs.select(*others, text.alias("_t"))
    a = a.select(*others, _words("_t").alias("_w"), F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_l"))
    n = F.size("_w")
    a = a.select(
        *others,
        *of_lines,
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)")).alias("_g"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    others = [c for c in a.columns if c not in (*counts, "_g")]
    # windows in order of their hash; only texts that repeat a window go on
    a = a.select(*others, *counts, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    a = a.select(*others, *counts, F.expr("filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = x.h))").alias("_r"))
    a = a.select(*others, *counts, F.sort_array(F.transform("_r", lambda x: x["i"])).alias("_p"))
    covered = F.expr("aggregate(_p, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)")
    # a partition id is never under 0; being non-deterministic it keeps a filter on the counts from being pushed into the array expressions, which would then be evaluated per element
    return a.select(*others, *counts, F.when(F.spark_partition_id() >= 0, F.coalesce(covered, F.lit(0).cast("long"))).alias("n_repeat_words"))


def _norm(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(x, F.lit(BLANKS))), BLANK, " ")


def _keys(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(doc_id, text), F.xxhash64(text, F.lit("key"), doc_id)]


def _profiles(docs: DataFrame, host: str) -> DataFrame:
    """One pass over docs(doc_id, text, host): doc_id, _k1, _k2, _host, _text, base counts, and _lines, the distinct lines with words as (line: hash, words)."""
    k1, k2 = _keys("doc_id", "text")
    rows = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    lines = F.transform("_l", _norm)
    hashed = F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))))
    counted = base_counts(rows.select("doc_id", "text", "_host", k1.alias("_k1"), k2.alias("_k2"), F.xxhash64("text").alias("_text"), F.col("text").isNotNull().alias("_there")), hashed.alias("_lines"))
    return stage_table(counted.withColumn("_row", F.monotonically_increasing_id()), "line-profiles")


def _lines(profiles: DataFrame) -> DataFrame:
    return profiles.where("_there").select("_row", "_host", "_text", F.inline("_lines"))


def _frequent(profiles: DataFrame) -> DataFrame:
    """_host, line, texts: the lines that more distinct texts of a host hold than its limit allows."""
    size = profiles.where("_there").select("_host", "_text").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("host_texts"))
    seen = _lines(profiles).select("_host", "line", "_text").distinct()
    often = seen.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > MAX_TEXTS)
    return often.join(size, "_host").where(F.col("texts") > F.col("host_texts") * MAX_SHARE).select("_host", "line", "texts")


def frequent_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """_host, line, texts: the lines that more distinct texts of a host hold than its limit allows."""
    return _frequent(_profiles(docs, host))


def _judged(docs: DataFrame, host: str) -> DataFrame:
    """The profiles with line_words, lost_words, lost_lines (hashes; null for none), base_failed and kept.

    Only frequent lines are joined to documents, and only documents that hold
    one are joined back: the rest of the corpus is not shuffled again.
    """
    profiles = _profiles(docs, host)
    hits = _lines(profiles).join(_frequent(profiles), ["_host", "line"]).groupBy("_row").agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("lost_lines"))
    line_words = F.when(F.col("_there"), F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + x["words"])).otherwise(F.lit(0)).cast("long")
    joined = profiles.withColumn("line_words", line_words).drop("_lines").join(hits, "_row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("line_words") - F.col("lost_words")) < MIN_LEFT * F.col("line_words")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, base counts, base_failed, all words and lost_words of distinct lines, and kept."""
    return _judged(docs, host).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_words", "lost_words")


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that are kept, their frequent lines removed from text (and n_chars, if there, counted anew)."""
    columns = docs.columns
    k1, k2, lost = (fresh(c, columns) for c in ("_k1", "_k2", "_lost"))
    verdict = _judged(docs, host).where("kept").select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("lost_lines").alias(lost)).dropDuplicates([k1, k2])
    made = dict(zip((k1, k2), _keys("doc_id", "text"), strict=True))
    joined = docs.withColumns(made).join(verdict, [k1, k2])
    cut = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(lost, F.xxhash64(_norm(x)))), "\n")
    out = joined.withColumn("text", F.when(F.size(lost) > 0, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
