"""A text classifier of character n-grams inside words: TF-IDF with sublinear counts and a balanced logistic model.

Each word is padded with a space on both sides and gives its n-grams of every
length; none crosses words.  The vocabulary is the ``most`` most frequent grams
of those in ``min_df`` texts or more, found by Spark's two-phase top-k (ties go
to the smaller gram), so what reaches the driver and the tasks is bounded.
Fitting reads sparse vectors of the labelled texts; scoring is one pass over any
texts, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.sources import readers


def grams(text: Column, low: int, high: int) -> Column:
    """All padded n-grams of a text, as often as they stand in it."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded, size = F.concat(F.lit(" "), word, F.lit(" ")), F.length(word) + 2
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), size)), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(words, of_word))


def padded_grams(text: str, low: int, high: int, words: list[str] | None = None) -> Counter:
    """The same in Python, for tasks; of ``words`` as they are, if given."""
    out: Counter = Counter()
    for word in text.lower().split() if words is None else words:
        word = f" {word} "
        for n in range(low, min(high, len(word)) + 1):
            out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


#: What a task remembers of words: so many, none longer; and the grams that it counts before it hands them on.
WORDS, LONGEST, COUNTED = 1 << 13, 64, 1 << 17


def remembered(known: dict, word: str, make):
    """make(word), made once for each word while ``known`` has room."""
    got = known.get(word)
    if got is None:
        got = make(word)
        if len(word) <= LONGEST:
            if len(known) >= WORDS:
                known.clear()
            known[word] = got
    return got


def counted(rows: DataFrame, low: int, high: int) -> DataFrame:
    """gram, times, texts of rows(text): how often each gram stands in them, and in how many.

    No gram crosses words, so a task takes words apart once, and hands on sums:
    what is shuffled grows with its distinct grams, not with the texts.
    """

    def add(batches):
        known: dict = {}
        words: Counter = Counter()
        texts: Counter = Counter()

        def sums() -> pd.DataFrame:
            times: Counter = Counter()
            for word, n in words.items():
                for g, k in padded_grams(word, low, high, [word]).items():
                    times[g] += n * k
            return pd.DataFrame({"gram": list(texts), "times": [times[g] for g in texts], "texts": list(texts.values())})

        for batch in batches:
            for own in batch["words"]:
                if own is None:
                    continue
                own = Counter(own)
                words.update(own)
                texts.update(set().union(*[remembered(known, w, lambda w: frozenset(padded_grams(w, low, high, [w]))) for w in own]))
                if len(texts) >= COUNTED or len(words) >= COUNTED:
                    yield sums()
                    words.clear()
                    texts.clear()
        if texts:  # an empty table of strings can't be sent
            yield sums()

    readers.small_batches(rows.sparkSession)  # of the words of 10,000 texts, a worker's objects are hundreds of megabytes
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    parts = rows.select(words.alias("words")).mapInPandas(add, "gram string, times long, texts long")
    return parts.groupBy("gram").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))


def vocabulary(rows: DataFrame, low: int = 2, high: int = 5, min_df: int = 2, most: int = 60_000) -> tuple[list[str], list[float]]:
    """The grams of rows(text), most frequent first, and their inverse document frequencies."""
    top = counted(rows, low, high).where(F.col("texts") >= min_df).orderBy(F.desc("times"), "gram").limit(most).collect()  # ``most`` rows at most
    n = rows.count()
    return [r.gram for r in top], [math.log((1 + n) / (1 + r.texts)) + 1 for r in top]


#: 1 + the logarithm of small counts.
_SUBLINEAR = [0.0, *(1 + math.log(i) for i in range(1, 256))]


def weigh(text: str | None, at: dict[str, int], idf, low: int, high: int, known: dict | None = None):
    """Places and values of a text's vector, of length 1; ``known`` remembers the places of words' grams from text to text."""
    import numpy as np

    known = {} if known is None else known

    def of_word(word: str):
        return np.array([at[g] for g in padded_grams(word, low, high, [word]).elements() if g in at], dtype=np.int64)

    found = [remembered(known, w, of_word) for w in (text or "").lower().split()]
    places, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.array([], dtype=np.int64), np.array([], dtype=np.int64))
    if len(count) and count.max() >= len(_SUBLINEAR):
        values = np.array([1 + math.log(n) for n in count.tolist()]) * idf[places]
    else:
        values = np.array(_SUBLINEAR)[count] * idf[places]
    size = math.sqrt(float(values @ values))
    return places, values / size if size else values


class TextModel:
    """A fitted classifier: transform() adds ``prediction`` and ``probability``, of the most probable class."""

    def __init__(self, words: list[str], idf: list[float], weights, intercepts, low: int, high: int):
        self.words, self.idf, self.weights, self.intercepts, self.low, self.high = words, idf, weights, intercepts, low, high

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.words, self.idf, self.weights, self.intercepts))
        low, high = self.low, self.high
        held: dict = {}
        known: dict = {}

        @F.pandas_udf("struct<prediction:double,probability:double>")
        def told(texts: pd.Series) -> pd.DataFrame:
            import numpy as np

            words, idf, weights, intercepts = shared.value
            if not held:
                held.update({w: i for i, w in enumerate(words)})
            idf = np.asarray(idf)
            out = []
            for t in texts:
                places, values = weigh(t, held, idf, low, high, known)
                margin = weights[:, places] @ values + intercepts
                share = np.exp(margin - margin.max())
                out.append((float(margin.argmax()), float(share.max() / share.sum())))
            return pd.DataFrame(out, columns=["prediction", "probability"])

        return rows.withColumn("_told", told(F.col(text))).select(*rows.columns, "_told.prediction", "_told.probability")


def fit(rows: DataFrame, low: int = 2, high: int = 5, min_df: int = 2, most: int = 60_000, c: float = 2.0) -> TextModel:
    """The classifier of rows(text, label), labels 0, 1, ..; classes weigh the same, and c is the inverse strength of the l2 penalty."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = rows.where("text is not null and label is not null").select("text", F.col("label").cast("double").alias("label"))
    words, idf = vocabulary(rows, low, high, min_df, most)
    told = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    n, size = sum(told.values()), len(words)
    at, scale = {w: i for i, w in enumerate(words)}, np.asarray(idf)
    shared = rows.sparkSession.sparkContext.broadcast((at, scale))
    known: dict = {}

    @F.udf(VectorUDT())
    def vector(text):  # labelled texts alone
        places, values = weigh(text, *shared.value, low, high, known)
        return SparseVector(max(size, 1), places.tolist(), values.tolist())

    balance = F.lit(0.0)
    for label, count in told.items():
        balance = F.when(F.col("label") == label, n / (len(told) * count)).otherwise(balance)
    # equal texts with one label are one row of the loss, as often as they came
    once = rows.groupBy("text", "label").agg(F.count(F.lit(1)).alias("times"))
    data = once.select(vector("text").alias("features"), "label", (balance * F.col("times")).alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=500, tol=1e-9).fit(data)
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(intercepts) == 1:  # two classes: the first is the other one's opposite
        weights, intercepts = np.vstack([np.zeros_like(weights[0]), weights[0]]), np.array([0.0, intercepts[0]])
    return TextModel(words, idf, weights, intercepts, low, high)
