"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Headers and license files are found as passages: sentences or lines of which at
least half the words are words of the templates and that do not deny a license ("is
not licensed under"), the paragraphs and runs that such pieces form, and all of
them together.  Each passage is compared with the
templates (titles, notices, whole texts of the short licenses, and SPDX
identifier lines) in a sparse space of words and pairs of neighbouring words, so that versions and clauses
count.  Terms are weighted by their document frequency over all files that hold
an anchor, a word that no license goes without; terms outside the templates
weigh as the rarest.  A file's own license is the best template over the
threshold.  A file without one inherits from the nearest directory above it (its
own first) that holds a license file with a license of its own.

Nulls and edge cases: a null or empty text, or one without an anchor, has no own
license and may inherit; a null path has no directory and inherits nothing;
equal cosines go to the template with more terms, then to the name that sorts
first, and of several license files in a directory the one with the highest
cosine counts, then the smallest path.  Rows that repeat path and text get the
same result.  Input columns with a name of the result's are replaced by it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_slices, stage_table
from .license_texts import TEMPLATES

THRESHOLD = 0.7
#: Pieces further apart than so many others are in different runs.
GAP = 3
_TERM = re.compile(r"[a-z0-9.\-]*[a-z0-9]")
_PIECE = re.compile(r"(?<=[.!?:;])(?<!license-identifier:)\s+")  # an identifier stays with its line
#: A piece that says what does not hold names a license without granting it.
_DENIED = re.compile(r"(\bnot|n't|\bno longer|\bnever)(\s+\w+){0,2}\s+(licen[sc]ed|released|distributed|published|available|covered)\b")
#: Words that carry nothing in a notice; not part of the vector space.
STOP = frozenset("a an and any are as at be by for from in is it its may not of on or that the this to under was will with you your".split())
#: Every template holds one of these.
ANCHORS = re.compile("licen[sc]e|redistribut|permission|public domain")
#: Columns of the result: those of the input that have such names are replaced.
OWN = ("own_license", "cosine", "license", "origin", "from_dir")
LICENSE_NAME = r"(?i)^(license|licence|copying|notice)(\..*)?$"


def terms(text: str) -> list[str]:
    return [t for t in _TERM.findall(text.lower()) if t not in STOP]


def passages(text: str | None, words: frozenset) -> list[list[str]]:
    """The words of each passage of a whole text that may be a license; words are those of the templates."""
    low = (text or "").lower()
    if not ANCHORS.search(low):
        return []
    out: list[list[str]] = []
    paragraph: list[str] = []
    run: list[str] = []
    whole: list[str] = []
    since = 0  # pieces since the last candidate

    def close(passage: list[str]) -> None:
        if passage and passage not in out[-2:]:
            out.append(passage)

    for line in low.split("\n"):
        if not line.strip():
            close(paragraph)
            paragraph = []
            continue
        for piece in _PIECE.split(line):
            t = terms(piece)
            if not t:
                continue
            if 2 * sum(x in words for x in t) < len(t) or _DENIED.search(piece):
                since += 1
                close(paragraph)
                paragraph = []
                if since > GAP:
                    close(run)
                    run = []
                continue
            since = 0
            close(t)
            paragraph, run, whole = paragraph + t, run + t, whole + t
    close(paragraph)
    close(run)
    close(whole)
    return out


def pairs(words: list[str]) -> list[str]:
    """Words, and pairs of neighbours."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _found(words: frozenset, vocabulary: frozenset):
    """For each file with a passage: the templates' terms in it, and its passages."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                got = passages(text, words)
                if got:
                    out.append((k1, k2, sorted(vocabulary.intersection([t for p in got for t in pairs(p)])), got))
            yield pd.DataFrame(out, columns=["k1", "k2", "has", "passages"])

    return run


def _vector(words: list[str], idf: dict[str, float], rare: float) -> dict[str, float]:
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    v = {w: (1 + math.log(n)) * idf.get(w, rare) for w, n in count.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / size for w, x in v.items()}


class Index:
    """The templates' vectors by term."""

    def __init__(self, templates, idf: dict[str, float], rare: float):
        self.idf, self.rare = idf, rare
        self.names: list[tuple[str, int]] = []
        self.posting: dict[str, list[tuple[int, float]]] = {}
        for i, (name, text) in enumerate(sorted(templates)):
            v = _vector(pairs(terms(text)), idf, rare)
            self.names.append((name, len(v)))
            for w, x in v.items():
                self.posting.setdefault(w, []).append((i, x))

    def best(self, found: list[list[str]]) -> tuple[str, float]:
        """The license and cosine of the nearest template to any passage."""
        top, out = (0.0, 0), ("", 0.0)
        for words in found:
            score: dict[int, float] = {}
            for w, x in _vector(pairs(list(words)), self.idf, self.rare).items():
                for i, y in self.posting.get(w, ()):
                    score[i] = score.get(i, 0.0) + x * y
            for i in sorted(score):
                name, size = self.names[i]
                key = (round(score[i], 9), size)
                if key > top or key == top and name < out[0]:
                    top, out = key, (name, score[i])
        return out


def _match(templates, idf, rare):
    def run(batches):
        import pandas as pd

        index = Index(templates, idf, rare)
        for batch in batches:
            got = [index.best(found) for found in batch["passages"]]
            yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "license": [g[0] for g in got], "cosine": [g[1] for g in got]})

    return run


def weights(files: int, having: dict[str, int], vocabulary) -> tuple[dict[str, float], float]:
    """Weights of the templates' terms from their document frequencies, and that of terms outside them."""
    return {t: math.log((1 + files) / (1 + having.get(t, 0))) + 1 for t in vocabulary}, math.log((1 + files) / 2) + 1 if files else 1.0


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """path, other columns but text, own_license, cosine, license, origin (own, inherited or none), from_dir of files(path, text, ...)."""
    files = files.drop(*OWN)
    k1, k2, at = (fresh(c, files.columns) for c in ("k1", "k2", "at"))
    words = frozenset(t for _, text in templates for t in terms(text))
    vocabulary = frozenset(t for _, text in templates for t in pairs(terms(text)))
    keyed = files.withColumns({k1: F.xxhash64("path", "text"), k2: F.xxhash64("text", F.lit("key"), "path")})
    found = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text")
    found = stage_table(map_slices(found, _found(words, vocabulary), "k1 long, k2 long, has array<string>, passages array<array<string>>"), "license-passages")
    total = found.count()
    having = {r.term: r.n for r in found.select(F.explode("has").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the templates' terms
    idf, rare = weights(total, having, vocabulary)
    own = map_slices(found.select("k1", "k2", "passages"), _match(list(templates), idf, rare), "k1 long, k2 long, license string, cosine double").where(F.col("cosine") >= THRESHOLD)
    own = own.groupBy("k1", "k2").agg(F.max(F.struct("cosine", "license")).alias("m")).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("m.license").alias("own_license"), F.col("m.cosine").alias("cosine"))
    own = stage_table(own, "own-licenses", found)
    rows = keyed.drop("text").join(own, [k1, k2], "left")

    cut = F.split("path", "/")
    depth = F.size(cut) - 1
    sources = rows.where(F.col("own_license").isNotNull() & F.element_at(cut, -1).rlike(LICENSE_NAME))
    sources = sources.select(F.array_join(F.slice(cut, 1, depth), "/").alias("dir"), "own_license", "cosine", "path")
    lead = F.min_by("own_license", F.struct(-F.col("cosine"), "path"))
    dirs = sources.groupBy("dir").agg(lead.alias("license"))

    # every directory that has files, with its ancestors: joined by path, nearest one wins
    here = rows.where(F.col("path").isNotNull()).select(F.array_join(F.slice(cut, 1, depth), "/").alias(at)).distinct()
    parts = F.split(at, "/")
    above = here.select(at, F.explode(F.sequence(F.lit(0), F.size(parts))).alias("up")).select(at, "up", F.array_join(F.slice(F.split(at, "/"), 1, F.col("up")), "/").alias("dir"))
    nearest = above.join(dirs, "dir").groupBy(at).agg(F.max(F.struct("up", "dir", "license")).alias("n")).select(at, F.col("n.license").alias("license"), F.col("n.dir").alias("from_dir"))
    joined = rows.withColumn(at, F.array_join(F.slice(cut, 1, depth), "/")).join(nearest, at, "left")
    has, gets = F.col("own_license").isNotNull(), F.col("license").isNotNull()
    return joined.select(
        *[c for c in files.columns if c != "text"],
        "own_license",
        "cosine",
        F.coalesce("own_license", "license").alias("license"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )
