"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame functions and Spark's own tree learner.  Labels: a URL
that a rule decides has the rule's verdict; of the rest, one whose host holds
one of a short list of words is labelled block, and all others are the
background, labelled allow.  So the trees learn what listed hosts look like, and
find hosts alike that the list doesn't name.  URLs are dealt into three folds by
hash: suffix statistics are taken over all of the first, a bounded sample of the
second trains the trees, drawn and weighed by class (of all folds, where the
second lacks a class), and the third, which neither saw, sets the probability from which the trees block (the greatest
difference of the two classes' shares, over the URLs that no rule decides).

Nulls and edge cases: a URL that is null or has no ``://`` has empty host and
path and is judged by the trees like any other; without two classes among the
labels every URL is allowed that no rule blocks; rows that repeat are judged
alike; very long URLs are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, stage_table

#: Words in a host that label its URLs block for training.
BLOCK_WORDS = ("adult", "porn", "xxx", "casino", "bets", "poker", "pills", "viagra", "spam", "ads-", "track")
#: URLs that the trees are trained on at most, half of each class, and bins of the held-out fold's probabilities.
SAMPLE_ROWS, BINS = 4000, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "host_labels", "hyphens", "depth", "digit_ratio", "entropy", "parameters", "suffix_share", "suffix_count", "top_share"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of rules (host, path start, verdict) that fits columns host and path: its string and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _lexical(urls: DataFrame) -> DataFrame:
    s = F.concat("host", "path")
    n = F.greatest(F.length("_s"), F.lit(1))
    share = lambda c: (F.length("_s") - F.length(F.replace(F.col("_s"), c, F.lit("")))) / n
    labels = F.split("host", r"\.")
    out = urls.withColumn("_s", s).withColumn("_c", F.array_distinct(F.split("_s", "")))
    return out.withColumns(
        {
            "url_length": F.coalesce(F.length("url"), F.lit(0)).cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "digit_ratio": F.length(F.regexp_replace("_s", "[^0-9]+", "")) / n,
            "entropy": F.aggregate(F.filter("_c", lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
            "parameters": F.coalesce(F.regexp_count("url", F.lit("[?&][^=&#]+=")), F.lit(0)).cast("double"),
            "suffix": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3))),
            "top": F.element_at(labels, -1),
        }
    ).drop("_s", "_c")


def _labelled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, ruled, features, label and fold of pages(page_id, url)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = first_rule(rules)
    urls = _lexical(urls.withColumn("rule", rule).withColumn("ruled", ruled))
    listed = F.col("host").rlike("|".join(BLOCK_WORDS))
    label = F.coalesce(F.col("ruled") == "block", listed).cast("double")
    return urls.withColumn("label", label).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(3)))


def fit(urls: DataFrame, trees: int = 10, depth: int = 3):
    """(model, suffix statistics, the probability to block from, held-out AUC) of labelled urls; None without two classes."""
    from pyspark.ml.classification import GBTClassifier

    once = urls.select("fold", "label", F.xxhash64("url").alias("u")).distinct().groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    known = {(r.fold, r.label): r.n for r in once}  # URLs, those that repeat counted once
    if not all(any(known.get((fold, label)) for fold in range(3)) for label in (0.0, 1.0)):
        return None
    stats = stage_table(urls.where("fold = 0").groupBy("suffix", "top").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")), "url-suffixes")
    own = all(known.get((1, label)) for label in (0.0, 1.0))  # else a class is so rare that the trees' fold has none of it: all folds teach
    teach, sample = urls.where("fold = 1") if own else urls, None
    draw = F.xxhash64(F.lit("urls"), "url")
    for label in (0.0, 1.0):
        n = sum(known.get((fold, label), 0) for fold in ([1] if own else range(3)))
        share = min(1.0, (SAMPLE_ROWS / 2 + 10 * (SAMPLE_ROWS / 2) ** 0.5) / n)  # ten deviations more than are wanted
        drawn = teach.where((F.col("label") == label) & (draw <= min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1))).withColumn("_draw", draw)
        drawn = drawn.dropDuplicates(["_draw"]).orderBy("_draw").limit(SAMPLE_ROWS // 2).withColumn("weight", F.lit(0.5 * SAMPLE_ROWS / min(n, SAMPLE_ROWS // 2)))
        sample = drawn if sample is None else sample.unionByName(drawn)
    sample = stage_table(_shares(sample, stats).select("label", "weight", *FEATURES), "url-sample")
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(_assembled(sample).coalesce(2))
    binned = _scored(urls.where("fold = 2"), stats, model).withColumn("bin", F.least(F.floor(F.col("p_block") * BINS), F.lit(BINS - 1)).cast("int"))
    seen = binned.groupBy("bin", F.col("ruled").isNull().alias("open"), "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 rows a bin
    remove(urls.sparkSession, sample._stage_path)
    return model, stats, *_cut(seen)


def _cut(seen) -> tuple[float, float | None]:
    """The middle of the bins that part the classes best, and the AUC by bins; of the URLs without a rule, if they have both classes."""
    import numpy as np

    for rows in ([r for r in seen if r.open], list(seen)):
        count = np.zeros((2, BINS + 1))
        for r in rows:
            count[int(r.label), r.bin] += r.n
        if count.sum(axis=1).all():
            break
    else:
        return 0.5, None
    share = count / count.sum(axis=1, keepdims=True)
    above = share[:, ::-1].cumsum(axis=1)[:, ::-1]  # of each class, at or over each bin
    gain = np.round(above[1] - above[0], 9)
    best = np.flatnonzero(gain == gain.max())
    auc = float((share[1] * (1 - above[0] + share[0] - share[0] / 2)).sum())
    return float(best[len(best) // 2]) / BINS, auc


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], trees: int = 10, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and p_block of pages(page_id, url)."""
    urls = _labelled(pages, rules)
    fitted = fit(urls, trees, depth)
    if fitted is None:
        none = F.lit(None).cast("double")
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), none.alias("p_block"))
    model, stats, cut, _ = fitted
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= cut, F.lit("block")).otherwise(F.lit("allow")))
    return _scored(urls, stats, model).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def _assembled(urls: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)


def _scored(urls: DataFrame, stats: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(_assembled(_shares(urls, stats))).withColumn("p_block", vector_to_array("probability")[1])


def _shares(urls: DataFrame, stats: DataFrame) -> DataFrame:
    """Smoothed share of blocked URLs, and their number, by suffix and top label."""
    for key in ("suffix", "top"):
        by = stats.groupBy(key).agg(F.sum("b").alias("_b"), F.sum("n").alias("_n"))
        b, n = F.coalesce("_b", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        urls = urls.join(by, key, "left").withColumns({f"{key}_share": (b + 0.5) / (n + 2.0), f"{key}_count": F.log1p(n.cast("double"))}).drop("_b", "_n")
    return urls
