"""Whole studies in numpy: yearly panel walks, grids, ablations, outlet weights and calibrated controls.

Spark hands each kernel a frame of sessions or of units already reduced; years,
arms, grid cells and seeds are groups that run side by side.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newstide.sources import readers

from . import inference, walk


def _sums(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """n, sums s_i and products p_i_j (i <= j) of cols by group."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p_{i}_{j}") for i, j in pairs])


def _matrix(row, k: int):
    """Symmetric matrix of products of a row of sums."""
    import numpy as np

    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"p_{i}_{j}"] or 0.0
    return out


def _linear(terms: list[tuple[object, str]]):
    out = F.lit(0.0)
    for c, name in terms:
        out = out + c * F.col(name)
    return out


def _known_sums(rows: DataFrame, by: list[str], cols: list[str], years: DataFrame) -> DataFrame:
    """:func:`_sums` by _year and ``by`` of the rows whose next session is before each of years(_year).

    A row is added up once, with its own year's; a year adds up the years before it.
    """
    own = _sums(rows.withColumn("_told", F.year("next_session")), ["_told", *by], cols)
    own = readers.stored(own.where("_told is not null"), "own-sums")
    return own.join(F.broadcast(years), F.col("_told") < F.col("_year")).groupBy("_year", *by).agg(*[F.sum(c).alias(c) for c in own.columns if c not in ("_told", *by)])


def firm_models(units: DataFrame, features: list[str], years: DataFrame) -> tuple[DataFrame, dict[int, list[float]], dict[int, float]]:
    """Least squares of y with an intercept for each firm, one model for each of years(_year) on what is known at its start: (_year, firm, alpha), slopes and mean intercepts.

    Sums by firm give the within-firm cross products; a row for each model
    reaches the driver.
    """
    import numpy as np

    by, cols, k = "_year", [*features, "y"], len(features)
    sums = readers.stored(_known_sums(units, ["firm"], cols, years), "firm-sums")
    inner = [(F.sum(F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n"))).alias(f"p_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    slopes = {}
    for r in sums.groupBy(by).agg(*inner).collect():
        m = _matrix(r, k + 1)
        slopes[r[by]] = (np.linalg.pinv(m[:k, :k], rcond=1e-12) @ m[:k, k]).tolist()
    table = units.sparkSession.createDataFrame([(y, *b) for y, b in slopes.items()], f"{by} int, " + ", ".join(f"b_{i} double" for i in range(k)))
    alphas = sums.join(F.broadcast(table), by).select(by, "firm", ((F.col(f"s_{k}") - _linear([(F.col(f"b_{i}"), f"s_{i}") for i in range(k)])) / F.col("n")).alias("alpha"))
    means = {r[by]: r["a"] for r in alphas.groupBy(by).agg(F.avg("alpha").alias("a")).collect()}
    return alphas, slopes, means


#: Events and quarters of the training years that a word must be in to be looked at.
LEAST_EVENTS, LEAST_QUARTERS = 30, 6


def eligible_words(events: DataFrame) -> DataFrame:
    """_year, token, n and k (labelled events and those labelled 1) of the words in enough of events(_year, quarter, label, tokens)."""
    words = events.select("_year", "quarter", "label", F.explode(F.array_distinct("tokens")).alias("token"))
    counts = words.groupBy("_year", "token").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("quarter").alias("quarters"), F.count("label").alias("n"), F.sum("label").cast("long").alias("k"))
    return counts.where((F.col("events") >= LEAST_EVENTS) & (F.col("quarters") >= LEAST_QUARTERS)).select("_year", "token", "n", "k")


def screened_words(events: DataFrame, q: float = 0.1) -> DataFrame:
    """_year, token, side (1 big, -1 small) of events(_year, firm, session, quarter, label, tokens) known at each year.

    Eligible words are tested by an exact binomial of their share of label 1
    against the year's, with Benjamini and Hochberg's correction.  Counts are
    Spark's; each distinct (n, k, base) is tested once.
    """
    base = events.groupBy("_year").agg(F.avg("label").alias("base"))
    counts = eligible_words(events).where("n > 0").join(F.broadcast(base), "_year").where("base > 0 and base < 1")

    @F.pandas_udf("double")
    def p_value(n: pd.Series, k: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([inference.binomial_p(int(x), int(m), float(z)) for m, x, z in zip(n, k, b, strict=True)])

    tested = counts.select("_year", "n", "k", "base").distinct().withColumn("p", p_value("n", "k", "base"))
    counts = readers.stored(counts.join(tested, ["_year", "n", "k", "base"]), "tested-words")
    # of the correction only p up to q matters, and equal p-values share the last of their ranks
    low = counts.where(F.col("p") <= q).groupBy("_year", "p").agg(F.count(F.lit(1)).alias("c"))
    ranked = low.withColumn("up_to", F.sum("c").over(Window.partitionBy("_year").orderBy("p"))).join(F.broadcast(counts.groupBy("_year").agg(F.count(F.lit(1)).alias("m"))), "_year")
    bars = ranked.where(F.col("p") <= q * F.col("up_to") / F.col("m")).groupBy("_year").agg(F.max("p").alias("bar"))
    share = F.col("k") / F.col("n")
    side = F.when(share > F.col("base"), 1).when(share < F.col("base"), -1)
    return counts.join(F.broadcast(bars), "_year").where("p <= bar").select("_year", "token", side.alias("side")).where("side is not null")


def logit_weights(events: DataFrame, words: DataFrame) -> DataFrame:
    """_year, token, weight of an l2 logistic fit of label on which of the year's screened words an event holds; the intercept's token is null.

    Events that hold the same words and have one label are counted first, so a
    year's fit reads its distinct sets of words, those without any as one row.
    """
    import numpy as np

    told = events.where("label is not null").select("_year", "firm", "session", "label", "tokens")
    held = told.select("_year", "firm", "session", F.explode(F.array_distinct("tokens")).alias("token")).join(words.select("_year", "token"), ["_year", "token"])
    held = held.groupBy("_year", "firm", "session").agg(F.sort_array(F.collect_set("token")).alias("held"))  # an event's own screened words
    sets = told.drop("tokens").join(held, ["_year", "firm", "session"], "left").groupBy("_year", "held", "label").agg(F.count(F.lit(1)).alias("times"))

    def fit(key, pdf):
        rows = [[] if h is None else list(h) for h in pdf["held"]]
        names = sorted({w for r in rows for w in r})
        if not names or pdf["label"].nunique() < 2:
            return pd.DataFrame(columns=["_year", "token", "weight"])
        at = {w: i for i, w in enumerate(names)}
        x = np.zeros((len(rows), len(names)))
        for i, r in enumerate(rows):
            x[i, [at[w] for w in r]] = 1
        w = walk.logit(x, pdf["label"].to_numpy(float), times=pdf["times"])
        return pd.DataFrame({"_year": key[0], "token": [None, *names], "weight": w})

    return sets.groupBy("_year").applyInPandas(fit, "_year int, token string, weight double")


#: Cells of a year's range of ``rest``, moments of a cell that sums are made of, and the largest exponent within a cell for which these tell them to 1e-13.
CELLS, MOMENTS, LEAST_CERTAIN = 2048, 9, 0.125


def _newton(goal, sums, slope, low, high):
    """One step of Newton's method with a bracket for each slope: (slope, low, high, whether it still moves), given the sums s0, s1, s2 at the slopes."""
    import numpy as np

    s0, s1, s2 = sums
    with np.errstate(all="ignore"):
        mean = s1 / s0
        gap, bend = mean - goal, s2 / s0 - mean**2
        high, low = np.where(gap > 0, slope, high), np.where(gap > 0, low, slope)
        new = np.where(bend > 0, slope - gap / bend, np.nan)
        half = np.where(np.isfinite(low + high), (low + high) / 2, 2 * slope + np.where(gap < 0, 1.0, -1.0))
        new = np.where((low < new) & (new < high), new, half)
        return new, low, high, ~(np.abs(new - slope) <= 1e-10 * (1 + np.abs(slope)))


def slopes_of_cells(goal, low, high, cells, rounds: int):
    """The slope b of each goal at which the mean of rest, weighed by exp(b * rest), is the goal; nan where the cells don't tell it.

    low and high are the ends of rest; cells has a row for each cell that holds
    something: its number, and the sums of m * v ** k, v being the place in the
    cell from -1 to 1.  exp(b * rest) is exp(b * centre) times a power series in
    v, so sums over all events are sums over cells and moments.
    """
    import numpy as np

    half = (high - low) / CELLS / 2
    centre, told = low + (2 * cells[:, 0] + 1) * half, cells[:, 1:]
    out = np.full(len(goal), np.nan)
    out[(goal <= low) | (goal >= high)] = 0.0  # no finite slope
    for first in range(0, len(goal), 256):
        at = first + np.flatnonzero(np.isnan(out[first : first + 256]))
        b, lo, hi = np.zeros(len(at)), np.full(len(at), -np.inf), np.full(len(at), np.inf)
        for _ in range(rounds):
            if not len(at):
                break
            e = np.exp(b[:, None] * (centre - np.where(b > 0, high, low)[:, None]))  # the largest exponent is 0
            s0, s1, s2 = np.zeros((3, len(at)))
            series = np.ones(len(at))
            own = e @ np.hstack([told, told * centre[:, None], told * (centre**2)[:, None]])
            n = told.shape[1]
            for k in range(n - 2):
                m, c, cc = own[:, k:n], own[:, n + k : 2 * n], own[:, 2 * n + k :]
                s0 += series * m[:, 0]
                s1 += series * (c[:, 0] + half * m[:, 1])
                s2 += series * (cc[:, 0] + 2 * half * c[:, 1] + half**2 * m[:, 2])
                series = series * (b * half) / (k + 1)
            new, lo, hi, moves = _newton(goal[at], (s0, s1, s2), b, lo, hi)
            out[at[~moves]] = new[~moves]
            on = moves & (np.abs(new) * half <= LEAST_CERTAIN)  # else beyond what the moments tell: left to the events themselves
            at, b, lo, hi = at[on], new[on], lo[on], hi[on]
    return out


def poisson_weights(events: DataFrame, eligible: DataFrame, rounds: int = 60) -> DataFrame:
    """_year, token, weight: for each eligible word the slope of a Poisson regression of its count on what the firm model leaves.

    events(_year, firm, session, rest, tokens); the offset is the logarithm of
    the eligible words in the event.  The intercept has a closed form given the
    slope b, and then the mean of ``rest`` over the word's events must equal
    that over all events, weighed by their words and exp(b * rest).  Those sums
    are the same function of b for all words of a year, so the events are added
    up once, into moments of ``rest`` within CELLS cells of its range, and words
    are solved side by side from these.  A slope too steep for the cells is
    solved over the events, a round of Newton's method (with a bracket) at a
    time, to the same bound.  Cells reach the driver, and of words such ones.
    """
    import numpy as np

    spark = events.sparkSession
    hits = events.select("_year", "rest", "firm", "session", F.explode(F.array_distinct("tokens")).alias("token")).join(eligible.select("_year", "token"), ["_year", "token"])
    words = hits.groupBy("_year", "token").agg(F.avg("rest").alias("goal"))
    sizes = hits.groupBy("_year", "firm", "session").agg(F.count(F.lit(1)).alias("m"), F.first("rest").alias("rest"))
    sizes = readers.stored(sizes.groupBy("_year", "rest").agg(F.sum("m").cast("double").alias("m")), "word-exposure")
    ends = {r["_year"]: (r.a, r.b) for r in sizes.groupBy("_year").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).collect()}
    wide = [(y, a, (b - a) / CELLS) for y, (a, b) in ends.items() if 0 < (b - a) / CELLS < np.inf]
    dealt = sizes.join(F.broadcast(spark.createDataFrame(wide, "_year int, _a double, _w double")), "_year")
    dealt = dealt.withColumn("cell", F.least(F.floor((F.col("rest") - F.col("_a")) / F.col("_w")), F.lit(CELLS - 1)).cast("int"))
    v = 2 * ((F.col("rest") - F.col("_a")) / F.col("_w") - F.col("cell")) - 1
    power = [F.lit(1.0)]
    while len(power) < MOMENTS + 2:
        power.append(power[-1] * F.col("_v"))
    summed = dealt.withColumn("_v", v).groupBy("_year", "cell").agg(*[F.sum(F.col("m") * x).alias(f"m_{k}") for k, x in enumerate(power)])
    cells: dict = {}
    for r in summed.collect():  # CELLS rows a year at most
        cells.setdefault(r["_year"], []).append(list(r)[1:])
    cells = {y: np.array(sorted(rows)) for y, rows in cells.items()}

    def solve(batches):
        for batch in batches:
            for y, own in batch.groupby("_year"):
                goal = own["goal"].to_numpy(float)
                yield own.assign(weight=slopes_of_cells(goal, *ends[y], cells[y], rounds) if y in cells else np.nan)[["_year", "token", "goal", "weight"]]

    told = readers.stored(words.mapInPandas(solve, "_year int, token string, goal double, weight double"), "word-slopes")
    steep = told.where("weight is null").collect()  # Arrow's form of nan
    solved = told.where("weight is not null").select("_year", "token", "weight")
    return solved.unionByName(_steep_weights(sizes, steep, ends, rounds)) if steep else solved


def _steep_weights(sizes: DataFrame, words: list, ends: dict[int, tuple[float, float]], rounds: int) -> DataFrame:
    """_year, token, weight of the words (rows of _year, token, goal), each round three sums over the events of sizes(_year, rest, m) for each word, which Spark adds up."""
    import numpy as np

    names, goal, slope, low, high = {}, {}, {}, {}, {}
    for y in sorted({r["_year"] for r in words}):
        own = sorted((r.token, r.goal) for r in words if r["_year"] == y)
        names[y], goal[y] = [t for t, _ in own], np.array([g for _, g in own], float)
        slope[y], low[y], high[y] = np.zeros(len(own)), np.full(len(own), -np.inf), np.full(len(own), np.inf)
    going = {y: np.arange(len(names[y])) for y in names}
    for _ in range(rounds):
        now = {y: (at, slope[y][at]) for y, at in going.items() if len(at)}
        if not now:
            break

        def sums(batches, now=now):
            for batch in batches:
                out = []
                for y, own in batch.groupby("_year"):
                    if y not in now:
                        continue
                    r, m = own["rest"].to_numpy(), own["m"].to_numpy()
                    for first in range(0, len(now[y][0]), 256):
                        at, b = now[y][0][first : first + 256], now[y][1][first : first + 256]
                        far = np.where(b > 0, ends[y][1], ends[y][0])  # the largest exponent is 0
                        e = m[:, None] * np.exp(b * (r[:, None] - far))
                        for j, s0, s1, s2 in zip(at.tolist(), e.sum(axis=0), r @ e, (r * r) @ e, strict=True):
                            out.append((y, j, float(s0), float(s1), float(s2)))
                yield pd.DataFrame(out, columns=["_year", "word", "s0", "s1", "s2"])

        added = sizes.mapInPandas(sums, "_year int, word int, s0 double, s1 double, s2 double").groupBy("_year", "word").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2")]).collect()
        going = {}
        for y in now:
            own = sorted((r.word, r.s0, r.s1, r.s2) for r in added if r["_year"] == y)
            at = np.array([r[0] for r in own], dtype=int)
            slope[y][at], low[y][at], high[y][at], moves = _newton(goal[y][at], np.array([r[1:] for r in own]).T, slope[y][at], low[y][at], high[y][at])
            going[y] = at[moves]
    for y, at in going.items():
        slope[y][at] = 0.0  # no finite slope
    rows = [(y, t, float(b)) for y in names for t, b in zip(names[y], slope[y], strict=True)]
    return sizes.sparkSession.createDataFrame(rows, "_year int, token string, weight double")


def yearly_walk(units: DataFrame, events: DataFrame, years: list[int], features: list[str], arms: dict[str, list[str]], test_from: str, method: str = "card") -> DataFrame:
    """firm, session, y, f0, score and each arm's forecast of events, by year; nothing later than 1 January is learned from.

    units(firm, next_session, y, features) and events(firm, session,
    next_session, y, features, quarter, tokens), one a firm and session.  For
    each year the firm model is fitted on units, and the word screen on events
    (labels: the outer terciles of what the model leaves), whose next session is
    before the year.  Then, but for the first year, the arms are fitted on the
    earlier scored events since test_from; columns that are 0 in all of them are
    left out.  All fits go through sums: a row a year reaches the driver.

    method: how a year's event is scored by its words: card, (big - small) /
    (big + small + 1) of the screened words; logit, the margin of
    :func:`logit_weights`; dmr, the mean of :func:`poisson_weights` over its
    eligible words.
    """
    import numpy as np

    spark = units.sparkSession
    year = F.broadcast(spark.createDataFrame([(y,) for y in years], "_year int"))
    start = F.make_date("_year", F.lit(1), F.lit(1))
    known = F.col("next_session") < start
    alphas, slopes, means = firm_models(units, features, year)
    fitted = spark.createDataFrame([(y, means[y], *b) for y, b in slopes.items()], "_year int, _mean double, " + ", ".join(f"_b{i} double" for i in range(len(features))))
    f0 = F.coalesce("alpha", "_mean") + _linear([(F.col(f"_b{i}"), c) for i, c in enumerate(features)])
    each = events.crossJoin(year).where(known | (F.year("session") == F.col("_year"))).join(F.broadcast(fitted), "_year").join(alphas, ["_year", "firm"], "left")
    each = readers.stored(each.withColumn("f0", f0).withColumn("_known", known).drop("alpha", "_mean", *[f"_b{i}" for i in range(len(features))]), "yearly-events")
    rest = F.col("y") - F.col("f0")
    told = each.where("_known").withColumn("rest", rest)
    if method != "dmr":  # which learns from the rest itself
        edges = told.groupBy("_year").agg(F.percentile("rest", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_e"))
        label = F.when(F.col("rest") > F.col("_e")[1], 1.0).when(F.col("rest") < F.col("_e")[0], 0.0)
        told = told.join(F.broadcast(edges), "_year").withColumn("label", label).drop("_e")
    if method == "card":
        weights = screened_words(told).select("_year", "token", F.col("side").cast("double").alias("weight"))
    elif method == "logit":
        told = readers.stored(told, "labelled-events")
        weights = readers.stored(logit_weights(told, readers.stored(screened_words(told), "screened-words")), "logit-weights")
    elif method == "dmr":
        words = eligible_words(told.withColumn("label", F.lit(None).cast("double")))
        weights = poisson_weights(told, readers.stored(words, "eligible-words"))
    else:
        raise ValueError(method)

    now = each.where(F.year("session") == F.col("_year"))
    found = now.select("_year", "firm", "session", F.explode(F.array_distinct("tokens")).alias("token")).join(weights, ["_year", "token"])
    found = found.groupBy("_year", "firm", "session").agg(F.sum("weight").alias("_w"), F.sum(F.abs("weight")).alias("_size"), F.count(F.lit(1)).alias("_n"))
    scored = now.join(found, ["_year", "firm", "session"], "left")
    total = F.coalesce("_w", F.lit(0.0))
    if method == "card":
        score = total / (F.coalesce("_size", F.lit(0.0)) + 1)
    elif method == "logit":
        scored = scored.join(F.broadcast(weights.where("token is null").select("_year", F.col("weight").alias("_i"))), "_year", "left")
        score = total + F.coalesce("_i", F.lit(0.0))
    else:
        score = total / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    scored = scored.withColumn("score", score).drop("_known", "_w", "_size", "_n", "_i", "tokens", "quarter", "_year")

    cols = sorted({c for a in arms.values() for c in a})
    later = F.broadcast(spark.createDataFrame([(y,) for y in years[1:]], "_year int"))
    one = readers.stored(scored, "scored-events").withColumn("_one", F.lit(1.0))
    fits = []
    names = ["_one", *cols, "y"]
    for r in _known_sums(one.where(F.col("session") >= F.lit(test_from).cast("date")), [], names, later).collect():
        m = _matrix(r, len(names))
        row = [r["_year"]]
        for wanted in arms.values():
            at = [0, *[1 + cols.index(c) for c in wanted if m[1 + cols.index(c), 1 + cols.index(c)] > 0]]
            b = np.zeros(len(cols) + 1)
            b[at] = np.linalg.pinv(m[np.ix_(at, at)], rcond=1e-12) @ m[at, -1]
            row += b.tolist()
        fits.append(tuple(row))
    schema = "_year int" + "".join(f", `{a}_{i}` double" for a in arms for i in range(len(cols) + 1))
    got = one.withColumn("_year", F.year("session")).join(F.broadcast(spark.createDataFrame(fits, schema)), "_year")
    return got.select("firm", "session", "y", "f0", "score", *[_linear([(F.col(f"`{a}_{i}`"), c) for i, c in enumerate(["_one", *cols])]).alias(a) for a in arms])


def yearly_scores(corpus: DataFrame, labelled: DataFrame, years: list[int], fit, least: int = 200, at_once: int = 1) -> DataFrame:
    """corpus(id, day, text) with label and train_end: each year's rows by a model of the labels strictly before it.

    fit(rows with text and label) gives a Spark model whose transform() adds
    ``prediction``.  A year with under ``least`` earlier labels, or of one
    class alone, stays blank and is never filled.  So many fits run ``at_once``:
    their steps are short jobs, which leave cores to others.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    spark, columns = corpus.sparkSession, corpus.columns
    # both are read once: the labels for the fits of all years, the corpus into a folder for each year
    labelled = readers.stored(labelled.select("day", "text", "label"), "yearly-labels")
    path = readers.shared_path(spark, "yearly-corpus")
    dated = corpus.withColumn("_year", F.year("day"))
    dated.write.partitionBy("_year").parquet(path)
    corpus = spark.read.schema(dated.schema).parquet(path)
    counts = labelled.groupBy("day", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = readers.stored(counts, "yearly-label-counts")  # a row a day and class
    blank = corpus.withColumn("label", F.lit(None).cast("double")).withColumn("train_end", F.lit(None).cast("date")).select("_year", *columns, "label", "train_end")
    out = blank.where(~F.coalesce(F.col("_year").isin(years), F.lit(False)))
    before = {year: F.col("day") < F.lit(f"{year}-01-01").cast("date") for year in years}
    told = {year: counts.where(before[year]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("label").alias("classes")).first() for year in years}
    wanted = [year for year in years if told[year].n >= least and told[year].classes >= 2]
    with ThreadPool(max(1, min(at_once, len(wanted)))) as pool:  # a model a year: some ten fits, as the years of the calendar
        models = dict(zip(wanted, pool.map(inheritable_thread_target(lambda year: fit(labelled.where(before[year]).select("text", "label"))), wanted, chunksize=1), strict=True))
    for year in years:
        own = F.col("_year") == year
        if year not in models:
            out = out.unionByName(blank.where(own))
            continue
        done = models[year].transform(corpus.where(own & F.col("text").isNotNull()))
        done = done.select("_year", *columns, F.col("prediction").cast("double").alias("label")).withColumn("train_end", F.lit(f"{year}-01-01").cast("date"))
        out = out.unionByName(done).unionByName(blank.where(own & F.col("text").isNull()))
    return out.drop("_year")


def evaluate(y, score, constant) -> dict[str, float]:
    """Accuracy of the forecast's sign, the constant's, the lift, the exact McNemar p and R2 out of sample against a forecast of 0."""
    import numpy as np

    y, up = np.asarray(y, float), np.asarray(y, float) > 0
    right, base = (np.asarray(score, float) > 0) == up, (np.asarray(constant, float) > 0) == up
    b, c = int((right & ~base).sum()), int((~right & base).sum())
    accuracy, flat = float(right.mean()), float(base.mean())
    return {"n": len(y), "accuracy": accuracy, "constant": flat, "lift": accuracy - flat, "mcnemar_p": inference.binomial_p(min(b, c), b + c) if b + c else 1.0, "oos_r2": float(1 - ((y - score) ** 2).sum() / (y**2).sum())}


def sensitivity_grid(frame: DataFrame, features: list[str], target: str, min_train: list[int], refit: list[int], kind: str = "regress") -> DataFrame:
    """min_train, refit, n, accuracy, constant, lift, mcnemar_p, oos_r2: the walk-forward in every cell, cells side by side."""
    cells = frame.sparkSession.createDataFrame([(a, b) for a in min_train for b in refit], "min_train int, refit int")
    each = cells.crossJoin(frame.select("session", *sorted({*features, target})))

    def one(key, pdf):
        p = walk.walk(pdf.sort_values("session"), features, target, kind, min_train=int(key[0]), refit=int(key[1]))
        if not len(p):
            return pd.DataFrame(columns=["min_train", "refit", "n", "accuracy", "constant", "lift", "mcnemar_p", "oos_r2"])
        return pd.DataFrame([{"min_train": key[0], "refit": key[1]} | evaluate(p["y"], p["pred"], p["constant"])])

    return each.groupBy("min_train", "refit").applyInPandas(one, "min_train int, refit int, n long, accuracy double, constant double, lift double, mcnemar_p double, oos_r2 double")


def stability(grid: DataFrame) -> DataFrame:
    """One row: whether every cell beats the constant, and three quarters of them beyond chance."""
    significant = F.col("mcnemar_p") < 0.05
    return grid.agg(
        F.min(F.col("lift") > 0).alias("beats_everywhere"),
        F.count_if(significant).alias("significant"),
        F.count(F.lit(1)).alias("cells"),
        F.min("accuracy").alias("accuracy_low"),
        F.max("accuracy").alias("accuracy_high"),
        (F.min(F.col("lift") > 0) & (F.avg(significant.cast("double")) >= 0.75)).alias("stable"),
    )


def common_window(frame: DataFrame, present: list[str]) -> DataFrame:
    """The sessions from the first to the last on which all of the columns are there and not 0."""
    active = F.lit(True)
    for c in present:
        active = active & F.coalesce(F.col(c) != 0, F.lit(False))
    ends = frame.where(active).agg(F.min("session").alias("_a"), F.max("session").alias("_b"))
    return frame.crossJoin(F.broadcast(ends)).where("session between _a and _b").drop("_a", "_b")


def covered_together(frame: DataFrame, sources: list[str], least: int) -> list[str]:
    """As many of the sources, best covered first, as share a window of ``least`` sessions or more; under two: none.

    A source is there on a session where its column is neither null nor 0.  A
    session counts for the k best covered sources if all of them are there; their
    window goes from the first such session to the last.
    """
    there = {c: F.coalesce(F.col(c) != 0, F.lit(False)) for c in sources}
    if not sources:
        return []
    seen = frame.agg(*[F.count_if(x).alias(c) for c, x in there.items()]).first()
    order = sorted(sources, key=lambda c: (-seen[c], c))
    together, so_far = F.lit(0), F.lit(True)
    for c in order:
        so_far = so_far & there[c]
        together = together + so_far.cast("int")
    numbered = frame.select("session", together.alias("_k"), F.row_number().over(Window.orderBy("session")).alias("_i"))  # a row a session
    spans = numbered.groupBy("_k").agg(F.min("_i").alias("a"), F.max("_i").alias("b")).collect()  # a row for each number of sources
    for k in range(len(order), 1, -1):
        ends = [(r.a, r.b) for r in spans if r["_k"] >= k]
        if ends and max(b for _, b in ends) - min(a for a, _ in ends) + 1 >= least:
            return order[:k]
    return []


def source_ablation(frame: DataFrame, base: list[str], sources: list[str], target: str, min_train: int = 500, refit: int = 20, parts: int = 1) -> DataFrame:
    """source, accuracy_without, accuracy_full, drop, place, status: what the walk-forward loses without each source's column.

    All sources that share a window of min_train + 100 sessions are ranked on it;
    those left out by :func:`covered_together` have a row without numbers.
    """
    ranked = covered_together(frame, sources, min_train + 100)
    told = frame.sparkSession.createDataFrame([(s, "ranked" if s in ranked else "covers too little") for s in sources], "source string, status string")
    none = F.lit(None)
    if not ranked:
        return told.select("source", *[none.cast("double").alias(c) for c in ("accuracy_without", "accuracy_full", "drop")], none.cast("int").alias("place"), "status")
    frame = common_window(frame, ranked).fillna(0.0, subset=ranked)
    arms = {"": [*base, *ranked]} | {s: [*base, *(x for x in ranked if x != s)] for s in ranked}
    p = walk.walk_forward(frame, arms, target, "regress", parts=parts, min_train=min_train, refit=refit)
    scored = p.groupBy("arm").agg(F.avg(((F.col("pred") > 0) == (F.col("y") > 0)).cast("double")).alias("accuracy"))
    scored = readers.stored(scored, "ablation")
    full = scored.where("arm = ''").select(F.col("accuracy").alias("accuracy_full"))
    lost = scored.where("arm <> ''").crossJoin(F.broadcast(full)).select(F.col("arm").alias("source"), F.col("accuracy").alias("accuracy_without"), "accuracy_full", (F.col("accuracy_full") - F.col("accuracy")).alias("drop"))
    lost = lost.withColumn("place", F.row_number().over(Window.orderBy(F.desc("drop"), "source")))  # a row for each source
    return told.join(lost, "source", "left").select("source", "accuracy_without", "accuracy_full", "drop", "place", "status")


def outlet_arms(base: list[str], sources: list[str]) -> dict[str, list[str]]:
    """The price arm, each source added alone, all sources, and all but each: a source's columns are its tone and whether it has any."""
    own = lambda s: [f"sent_{s}", f"has_{s}"]
    every = [c for s in sources for c in own(s)]
    return {"base": base} | {f"add:{s}": [*base, *own(s)] for s in sources} | {"all": [*base, *every]} | {f"without:{s}": [*base, *(c for c in every if c not in own(s))] for s in sources}


def outlet_ranking(frame: DataFrame, base: list[str], sources: list[str], target: str, min_train: int = 500, refit: int = 20, parts: int = 1) -> DataFrame:
    """arm, against, n, accuracy, auc, delta_auc, loss_diff, dm_z, dm_p of each outlet added to the prices, and of all outlets against all but it."""
    p = readers.stored(walk.walk_forward(frame, outlet_arms(base, sources), target, "regress", parts=parts, min_train=min_train, refit=refit), "outlets")
    pairs = [(f"add:{s}", "base") for s in sources] + [("all", "base")] + [("all", f"without:{s}") for s in sources]
    told = frame.sparkSession.createDataFrame(pairs, "arm string, against string")
    cols = ["session", "y", "pred"]
    met = told.join(p.select("arm", *cols), "arm").join(p.select(F.col("arm").alias("against"), "session", F.col("pred").alias("other")), ["against", "session"])

    def one(key, pdf):
        pdf = pdf.sort_values("session")
        y, a, b = (pdf[c].to_numpy(float) for c in ("y", "pred", "other"))
        d = (y - a) ** 2 - (y - b) ** 2
        se = inference.newey_west(d, int(4 * (len(d) / 100) ** (2 / 9)))
        z = float(d.mean() / se) if se > 0 else 0.0
        auc, base_auc = roc_auc(y > 0, a), roc_auc(y > 0, b)
        return pd.DataFrame([{"arm": key[0], "against": key[1], "n": len(y), "accuracy": float(((a > 0) == (y > 0)).mean()), "auc": auc, "delta_auc": auc - base_auc, "loss_diff": float(d.mean()), "dm_z": z, "dm_p": inference.normal_p(z)}])

    return met.groupBy("arm", "against").applyInPandas(one, "arm string, against string, n long, accuracy double, auc double, delta_auc double, loss_diff double, dm_z double, dm_p double")


def roc_auc(y, score) -> float:
    y = pd.Series(y).reset_index(drop=True)
    rank = pd.Series(score).rank()
    pos, neg = int(y.sum()), int((~y).sum())
    return float((rank[y].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else math.nan


def hac_ols(x, y, lags: int = 5):
    """(coefficients with the intercept first, their Newey-West standard errors)."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.pinv(a.T @ a)
    b = inverse @ a.T @ y
    e = a * (y - a @ b)[:, None]
    meat = e.T @ e
    for k in range(1, lags + 1):
        g = e[k:].T @ e[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    return b, np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))


def outlet_weights(frame, base: list[str], sources: list[str], target: str, lags: int = 5):
    """source, beta, t, p of standardised in-sample least squares over base, tone and presence columns (pandas)."""
    import numpy as np
    cols = [*base, *(c for s in sources for c in (f"sent_{s}", f"has_{s}"))]
    data = frame.dropna(subset=[target, *cols]).sort_values("session")
    sd = data[cols].std(ddof=1).replace(0, np.nan)
    use = [c for c in cols if sd[c] == sd[c]]
    b, se = hac_ols(((data[use] - data[use].mean()) / sd[use]).to_numpy(float), (data[target] / data[target].std(ddof=1)).to_numpy(float), lags)
    rows = []
    for s in sources:
        if f"sent_{s}" in use:
            i = 1 + use.index(f"sent_{s}")
            rows.append({"source": s, "beta": float(b[i]), "t": float(b[i] / se[i]), "p": inference.normal_p(float(b[i] / se[i]))})
    return pd.DataFrame(rows, columns=["source", "beta", "t", "p"])
