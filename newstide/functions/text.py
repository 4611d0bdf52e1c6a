"""Text functions as Spark expressions; the one Arrow UDF is for Unicode normal forms and HTML entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Invisible marks that cleaning deletes.
MARKS = "[​-‏‪-‮⁦-⁩؜]"
#: French weekday and month names that template keys mask.
DATE_WORDS = "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février fevrier mars avril mai juin juillet août aout septembre octobre novembre décembre decembre".split()
#: Arabic month names of absolute dates.
ARABIC_MONTHS = {"جانفي": 1, "فيفري": 2, "مارس": 3, "أفريل": 4, "ماي": 5, "جوان": 6, "جويلية": 7, "أوت": 8, "سبتمبر": 9, "أكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12}
WORD = r"\p{L}\p{N}_"
_NUMBER = r"[0-9]+(?:[.,   ][0-9]+)*\s?%?"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    import html
    import unicodedata

    return text.fillna("").map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)))


def clean_text(text: Column) -> Column:
    """Entities unescaped, NFKC, invisible marks deleted, ends stripped; null is the empty text."""
    return F.regexp_replace(F.regexp_replace(_unescaped(text), MARKS, ""), r"^\s+|\s+$", "")


def arabic_match_form(text: Column) -> Column:
    """One form for alef, teh marbuta and alef maksura; no tatweel.  For matching only."""
    return F.translate(text, "أإآٱىةـ", "اااايه")


def script_counts(text: Column) -> Column:
    return F.struct(F.regexp_count(text, F.lit("[؀-ۿ]")).alias("arabic"), F.regexp_count(text, F.lit("[A-Za-zÀ-ɏ]")).alias("latin"))


def mixed_words(text: Column) -> Column:
    """Words of letters and digits that hold one of 2356789 and are no ordinals."""
    words = F.filter(F.split(text, rf"[^{WORD}]+"), lambda w: w.rlike("[A-Za-z]") & w.rlike("[2356789]") & ~w.rlike("(?i)^[0-9]+(er|ere|e|eme|ème|st|nd|rd|th)$"))
    return F.size(words)


def template_key(text: Column) -> Column:
    """Numbers masked by sign, date words masked, words alone left, one space between them."""
    x = F.lower(text)
    for sign, mask in ((r"\+\s?", "up#"), (r"[-−]\s?", "dn#"), ("", "#")):
        x = F.regexp_replace(x, rf"(?<![{WORD}#]){sign}{_NUMBER}" if sign else _NUMBER, mask)
    x = F.regexp_replace(x, rf"(?<![{WORD}])(?:{'|'.join(sorted(DATE_WORDS, key=len, reverse=True))})(?![{WORD}])", "@")
    x = F.regexp_replace(F.translate(x, "_", " "), r"[^\p{L}\p{N}#@]+", " ")
    return F.trim(F.regexp_replace(x, " +", " "))


def cluster_id(key: Column) -> Column:
    return F.sha1(key)


def stable_hash(seed: int, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256)


def tokens(key: Column) -> Column:
    """Distinct words and bigrams of a template key."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct word k-grams; a shorter text is one shingle."""
    words = F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " ")

    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(F.size(words) >= k, F.array_distinct(many)).otherwise(F.array(F.array_join(words, " ")))

    return F.transform(F.array(words), of)[0]  # a text is split once, not once for each of its shingles


def numbers_preserved(source: Column, target: Column) -> Column:
    """Every digit of source (French ordinals dropped) is in target as often."""
    plain = F.regexp_replace(source, "(?i)[0-9]+(er|ere|ème|eme|e)\\b", "")
    out = F.lit(True)
    for d in "0123456789":
        out = out & (F.regexp_count(plain, F.lit(d)) <= F.regexp_count(target, F.lit(d)))
    return out


def suspicious_translation(source: Column, target: Column) -> Column:
    """A word 3-gram three times or more, twice the length, or a pipe with a third gone."""
    words = F.split(F.lower(F.trim(target)), r"\s+")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))
    most = F.array_max(F.transform(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g))))
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    return ((F.size(words) >= 3) & (most >= 3)) | (ratio > 2) | (F.contains(source, F.lit("|")) & (ratio < 0.6))


def arabic_date(raw: Column) -> Column:
    """struct(date, category): absolute day month year, relative, or other."""
    form = r"^([0-9]{1,2})\s+(\S+)\s+([0-9]{4})$"
    months = F.create_map(*[x for name, n in ARABIC_MONTHS.items() for x in (F.lit(name), F.lit(f"{n:02d}"))])
    text = F.concat_ws("-", F.regexp_extract(raw, form, 3), F.try_element_at(months, F.regexp_extract(raw, form, 2)), F.lpad(F.regexp_extract(raw, form, 1), 2, "0"))
    date = F.when(raw.rlike(form), F.try_to_date(text, "yyyy-MM-dd"))
    return F.struct(date.alias("date"), F.when(date.isNotNull(), "abs").when(F.startswith(raw, F.lit("منذ")), "relative").otherwise("other").alias("category"))


def parsed_label(content: Column, labels: list[str]) -> Column:
    """struct(label, reason) of a reply: strict JSON, else the first object in it, else a pattern; invalid is null."""
    schema = "label string, reason string"
    strict, inner = F.from_json(content, schema), F.from_json(F.regexp_extract(content, r"(?s)(\{.*?\})", 1), schema)
    loose = F.struct(F.regexp_extract(content, r"""["']?label["']?\s*[:=]\s*["']?([A-Za-z_]+)""", 1).alias("label"), F.regexp_extract(content, r"""["']?reason["']?\s*[:=]\s*["']([^"']+)["']""", 1).alias("reason"))
    found = F.when(strict["label"].isNotNull(), strict).when(inner["label"].isNotNull(), inner).otherwise(loose)
    return F.when(found["label"].isin(labels) & (F.length(F.trim(found["reason"])) > 0), found)


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of keywords, in list order, that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords])


def mentions(text: Column, words: list[str]) -> Column:
    """One of words stands in text, with an optional plural s, between word borders."""
    return text.rlike(rf"(?iu)(?<![{WORD}])(?:{'|'.join(sorted(words, key=len, reverse=True))})s?(?![{WORD}])")


def relevance_tag(text: Column, home: list[str], issuers: list[str], world: list[str], foreign_words: list[str], home_words: list[str]) -> Column:
    """Cascade of keyword lists; a foreign word without a home word takes the home tags away."""
    low = F.lower(text)
    abroad = mentions(text, foreign_words) & ~mentions(text, home_words)
    return F.when(first_keyword(low, home).isNotNull() & ~abroad, "home_econ").when(first_keyword(low, issuers).isNotNull() & ~abroad, "home_econ").when(first_keyword(low, world).isNotNull(), "global_linked").otherwise("other")


def cluster_templates(headlines: DataFrame, first_source: str) -> DataFrame:
    """headlines(row_id, source, headline, published_date) with template_key, dup_cluster_id, cluster_size, is_canonical."""
    from pyspark.sql import Window

    keyed = headlines.withColumn("template_key", template_key(F.col("headline"))).withColumn("dup_cluster_id", cluster_id(F.col("template_key")))
    lead = F.min(F.struct(F.when(F.col("source") == first_source, 0).otherwise(1), F.coalesce("published_date", F.lit("9999-12-31").cast("date")), "row_id")).over(Window.partitionBy("dup_cluster_id"))
    sized = keyed.withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("dup_cluster_id")))
    return sized.withColumn("is_canonical", lead["row_id"] == F.col("row_id"))
