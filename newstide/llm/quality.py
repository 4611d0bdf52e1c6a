"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
What reaches the driver is the count of each vote pattern (at most
3 ** labellers rows, over all documents, those that repeat counted once); there expectation-maximisation
estimates each labeller's vote rates for good and bad documents and the class
balance, with no gold labels.  The posteriors of a bounded, hash-drawn sample
of documents then train a linear scorer on hashed words, word shapes and
repeats, which scores every document.

Nulls and edge cases: a null text or one without words has score 0 and is
rejected (a document with nothing to learn from); a null doc_id stays null; an
empty table gives an empty result; rows that repeat are scored alike; other
columns are kept by :func:`keep` and not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, resident, small_batches

#: The sample that the scorer is trained on (documents at most), and the hashed dimensions.
SAMPLE_ROWS, DIMENSIONS = 4000, 1 << 12
#: Documents whose probability of being good is under this are rejected.
REJECT_UNDER = 0.5

_RUNS = re.compile(r"(.)\1+")

#: (name, metric, bad, good): a labeller votes bad past its bad bound, good past its good bound, else abstains.
#: "over": bad above the first number, good below the second; "under" the other way round.
LABELLERS = (
    ("symbols", "over", 0.10, 0.02),
    ("repeats", "over", 0.30, 0.05),
    ("capitals", "over", 0.50, 0.20),
    ("tails", "over", 0.30, 0.05),
    ("function_words", "under", 0.05, 0.15),
    ("variety", "under", 2.0, 3.0),
    ("line_words", "under", 1.5, 4.0),
    ("words", "under", 1, 20),
)
#: Variety is judged from so many words, words a line from so many lines.
VARIETY_FROM, LINES_FROM = 20, 3


class _Classes(dict):
    """Code point to the letter of its class: A capital, a other letter, 9 digit, $ symbol, . anything else."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else "$" if c in "#*$%&|<>" else "."
        return out


_CLASSES = _Classes()


#: Words over so many code points have their letters, capitals and symbols counted one by one.
LONG = 500


class _Words(dict):
    """All that is needed of a word in one number; forgets all when it holds 131,072.

    Bits 0: word dimension, 16: shape dimension, 32: function word, 33: tail of
    marks, 34: letters, 44: capitals, 54: symbols, of words up to LONG; those of
    longer words are 0 and bit 63 is set.
    """

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        half = DIMENSIONS // 2
        classes = word.translate(_CLASSES)
        letters, capitals, symbols = _class_counts(classes)
        shape = _RUNS.sub(r"\1", classes)
        short, tail = letters <= 3 and classes[0] in "Aa", len(word) > 1 and classes[-1] in "$." and classes[-2] in "$."
        out = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % half | (half + zlib.crc32(shape.encode()) % (half // 2)) << 16 | short << 32 | tail << 33
        out = out | letters << 34 | capitals << 44 | symbols << 54 if len(word) <= LONG else out - (1 << 63)
        if len(word) <= LONG:
            self[word] = out
        return out


def _class_counts(classes: str) -> tuple[int, int, int]:
    """Letters, capitals and symbols."""
    capitals = classes.count("A")
    return capitals + classes.count("a"), capitals, classes.count("$")


def _codes(text: str | None):
    import numpy as np

    words = (text or "").split()
    return words, np.fromiter(map(resident("quality words", _Words).__getitem__, words), dtype=np.int64, count=len(words))


def _same(words: list[str], codes) -> int:
    """Words that equal the one before them: by their numbers first, which few different words share."""
    import numpy as np

    return sum(words[i] == words[i + 1] for i in np.flatnonzero(codes[1:] == codes[:-1]).tolist())


def metrics(text: str | None) -> list[float] | None:
    """The labellers' measures of a whole text, in the order of LABELLERS; None without words."""
    import numpy as np

    words, codes = _codes(text)
    n = len(words)
    if not n:
        return None
    lines = sum(1 for line in text.split("\n") if line.strip())
    letters, capitals, symbols = int((codes >> 34 & 1023).sum()), int((codes >> 44 & 1023).sum()), int((codes >> 54 & 511).sum())
    for i in np.flatnonzero(codes < 0).tolist():
        more = _class_counts(words[i].translate(_CLASSES))
        letters, capitals, symbols = letters + more[0], capitals + more[1], symbols + more[2]
    return [
        symbols / n,
        _same(words, codes) / n,
        capitals / max(letters, 1),
        np.count_nonzero(codes & 1 << 33) / n,
        np.count_nonzero(codes & 1 << 32) / n,
        int(np.count_nonzero(np.bincount(codes & 0xFFFF))) / n**0.5 if n >= VARIETY_FROM else 2.5,
        n / lines if lines >= LINES_FROM else 3.0,
        n,
    ]


def votes(text: str | None) -> str:
    """One letter for each labeller: g, b or - (abstains)."""
    m = metrics(text)
    if m is None:
        return "-" * (len(LABELLERS) - 1) + "b"
    out = []
    for x, (_, side, bad, good) in zip(m, LABELLERS, strict=True):
        if side == "under":
            x, bad, good = -x, -bad, -good
        out.append("b" if x > bad else "g" if x < good else "-")
    return "".join(out)


def features(text: str | None):
    """Dimensions and values of a whole text: square roots of the shares of hashed words, shapes and repeats."""
    import numpy as np

    words, codes = _codes(text)
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    half = DIMENSIONS // 2
    same = _same(words, codes)
    count = np.bincount(codes & 0xFFFF, minlength=DIMENSIONS) + np.bincount(codes >> 16 & 0xFFFF, minlength=DIMENSIONS)
    # the last quarter: levels of the repeat, variety and line measures, the last of each open above
    base = half + half // 2
    places = [min(int(20 * same / len(words)), 63)]
    if len(words) >= VARIETY_FROM:
        places.append(64 + min(int(8 * int(np.count_nonzero(count[:half])) / len(words) ** 0.5), 63))
    if (lines := text.count("\n") + 1) >= LINES_FROM:
        places.append(128 + min(int(len(words) / lines), 63))
    for place in places:
        count[base + place] += len(words)
    at = np.flatnonzero(count)
    return at, np.sqrt(count[at] / len(words))


def estimate(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation."""
    import numpy as np

    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    vote = np.array([["gb-".index(c) for c in k] for k in keys])
    good, bad = (vote == 0).sum(axis=1), (vote == 1).sum(axis=1)
    post = (good + 1.0) / (good + 2.0 * bad + 2.0)  # a bad vote counts double: heuristics fire for a reason
    for _ in range(rounds):
        share = min(max((n * post).sum() / n.sum(), 0.02), 0.98)
        log = np.zeros((2, len(keys)))
        for side, w in enumerate((n * post, n * (1 - post))):
            log[side] = np.log((share, 1 - share)[side])
            for j in range(vote.shape[1]):
                rate = np.bincount(vote[:, j], weights=w, minlength=3)[:2] + 1.0
                log[side] += np.append(np.log(rate / rate.sum()), 0.0)[vote[:, j]]  # to abstain says nothing
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return dict(zip(keys, post.tolist(), strict=True))


def train(at, values, labels, steps: int = 150, decay: float = 1e-4):
    """Weights (and, last, the bias) of a logistic scorer for soft labels, by full-batch Adam."""
    import numpy as np

    x = np.zeros((len(labels), DIMENSIONS + 1), dtype=np.float32)
    for i, (a, v) in enumerate(zip(at, values, strict=True)):
        x[i, a] = v
    x[:, -1] = 1
    y = np.asarray(labels, dtype=np.float32)
    weight = 0.5 * (y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1))  # both classes count alike
    w = np.zeros(DIMENSIONS + 1, dtype=np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (weight * (p - y)) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def _vote(batches):
    for batch in batches:
        yield pd.DataFrame({"draw": batch["draw"], "votes": [votes(t) for t in batch["text"]], "words": [bool((t or "").split()) for t in batch["text"]]})


def _sample(batches):
    for batch in batches:
        rows = [(v, *(x.tolist() for x in features(t))) for t, v in zip(batch["text"], (votes(t) for t in batch["text"]), strict=True)]
        yield pd.DataFrame(rows, columns=["votes", "at", "value"])


def fit(docs: DataFrame):
    """The scorer's weights, from all documents' votes and a bounded sample's posteriors; None where no document has a word.

    Rows that repeat an id and a text are one document here, so they neither
    sway the votes nor fill the sample.  The sample is the SAMPLE_ROWS documents
    with words of lowest hash, of those under a bound that some more lie under.
    """
    draw = F.xxhash64(F.lit("quality"), "doc_id", "text").alias("draw")
    rows = docs.select("doc_id", "text")
    voted = map_slices(rows.select(draw, "text"), _vote, "draw long, votes string, words boolean").distinct()
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.count_if("words").alias("worded")).collect()  # 3 ** labellers rows at most
    posterior = estimate({r.votes: r.n for r in counts})
    worded = sum(r.worded for r in counts)
    if not worded:
        return None, posterior
    share = min(1.0, (SAMPLE_ROWS + 10 * SAMPLE_ROWS**0.5) / worded)  # ten deviations more than are wanted
    bound = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    drawn = rows.where((draw <= bound) & F.col("text").rlike(r"[^\s\x1c-\x1f\x85\xa0]")).groupBy(draw).agg(F.any_value("text").alias("text"))
    drawn = drawn.orderBy("draw").limit(SAMPLE_ROWS)
    sample = map_slices(drawn.select("text"), _sample, "votes string, at array<int>, value array<float>").toPandas()
    sample = sample[sample["at"].map(len) > 0]
    return train(sample["at"], sample["value"], [posterior.get(v, 0.5) for v in sample["votes"]]), posterior


def _score(weights):
    def run(batches):
        import numpy as np

        w = weights.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                at, value = features(text)
                out.append(1 / (1 + np.exp(-float(w[at] @ value + w[-1]))) if len(at) and w is not None else 0.0)
            yield pd.DataFrame({c: batch[c] for c in batch if c != "text"} | {"quality_score": np.array(out, dtype=float)})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, quality_score (probability of good) and kept of each row of docs(doc_id, text)."""
    weights, _ = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    scored = map_slices(docs.select("doc_id", "text"), _score(shared), "doc_id long, quality_score double")
    return scored.withColumn("kept", F.col("quality_score") >= REJECT_UNDER)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns."""
    weights, _ = fit(docs)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    good = F.pandas_udf(_score_text(shared), "double")
    return docs.where(good("text") >= REJECT_UNDER)


def _score_text(weights):
    def run(text: pd.Series) -> pd.Series:
        return next(_score(weights)(iter([pd.DataFrame({"text": text})])))["quality_score"]

    return run


