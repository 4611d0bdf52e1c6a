"""Controls of a forecasting test: made-up columns and spoilt data that go through the same paired walk-forwards.

A run is a kind, an effect and a seed.  Its frame is made in the task from those
three, the walk is done with and without the columns on trial, and what comes
back is one row: the difference of losses and the statistic of the nested
comparison.  Runs are groups of a grid, so hundreds go side by side; what is
read off them (medians, counts of finds, centre and spread) are aggregates.

Kinds: noise, columns with the spectrum and the values of the news but random
phases; planted, a normal column of which ``effect`` standard deviations of the
target are added to the target, with such noise for the other columns; permuted,
the target in shuffled blocks; stale, the news moved on by 250 sessions and more;
real, nothing changed.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inference

KINDS = ("noise", "planted", "permuted", "stale", "real")
#: Fixed values of the protocol: the median statistic sought, the finds of 100 that power of 80 % allows, the false finds of 100 that a test at 5 % allows, and the normal bound.
SOUGHT, BAND, MOST_FALSE, BOUND = 2.8, (72, 88), 9, 1.96
#: Sessions by which news is stale at least, and of a permuted block.
STALE, BLOCK = 250, 20


def trial(frame: pd.DataFrame, news: list[str], target: str, kind: str, effect: float, seed: int) -> tuple[pd.DataFrame, list[str]]:
    """The frame of a run (sorted by session), and the columns that are on trial in it."""
    import numpy as np

    rng = np.random.default_rng([KINDS.index(kind), seed])
    out = frame.copy()
    if kind == "real":
        return out, news
    if kind == "stale":
        away = STALE + int(rng.integers(max(1, len(out) - 2 * STALE)))
        out[news] = np.roll(out[news].to_numpy(float), away, axis=0)
        return out, news
    if kind == "permuted":
        told = out[target].notna().to_numpy()
        values = out.loc[told, target].to_numpy(float)
        out.loc[told, target] = values[inference.permute_blocks(len(values), BLOCK, rng)]
        return out, news
    made = [f"_{kind}{i}" for i in range(len(news))]
    out[made] = inference.surrogate(out[news].to_numpy(float), rng)
    if kind == "planted":
        out[made[0]] = rng.normal(size=len(out))
        out[target] = out[target] + effect * out[target].std() * out[made[0]]
    return out, made


def nested(y, small, large) -> tuple[float, float]:
    """Mean difference of squared errors (large less small), and the statistic of the nested comparison.

    The larger model is given back what its own noise costs, the squared
    distance of the two forecasts; over 0 it is the better one.
    """
    import numpy as np

    y, small, large = (np.asarray(v, float) for v in (y, small, large))
    gain = (y - small) ** 2 - (y - large) ** 2
    lent = gain + (small - large) ** 2
    se = inference.newey_west(lent, int(4 * (len(lent) / 100) ** (2 / 9)))
    return float(-gain.mean()), float(lent.mean() / se) if se > 0 else 0.0


def forecasts(x, y, min_train: int = 500, refit: int = 20, embargo: int = 5):
    """Expanding least-squares forecasts of the rows from min_train on, as ``walk.walk`` has them: cross products grow from refit to refit."""
    import numpy as np

    sd = x.std(axis=0)
    a = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)])  # forecasts don't hang on the scale
    out, gram, with_y, done = np.empty(max(0, len(x) - min_train)), np.zeros((a.shape[1],) * 2), np.zeros(a.shape[1]), 0
    for start in range(min_train, len(x), refit):
        cut = max(1, start - embargo)
        gram += a[done:cut].T @ a[done:cut]
        with_y += a[done:cut].T @ y[done:cut]
        done = cut
        out[start - min_train : start - min_train + refit] = a[start : start + refit] @ (np.linalg.pinv(gram, rcond=1e-12) @ with_y)
    return out


def runs(frame: DataFrame, features: list[str], news: list[str], target: str, grid: list[tuple[str, float, int]], **how) -> DataFrame:
    """kind, effect, seed, n, loss_diff, stat of each run of the grid over frame(session, features, news, target)."""
    spark = frame.sparkSession
    rows = frame.select("session", *dict.fromkeys([*features, *news, target])).dropna(subset=[*features, *news])
    each = spark.createDataFrame(grid, "kind string, effect double, seed long").crossJoin(rows)

    def one(key, pdf):
        kind, effect, seed = key[0], float(key[1]), int(key[2])
        made, on_trial = trial(pdf.sort_values("session").reset_index(drop=True), news, target, kind, effect, seed)
        made = made.dropna(subset=[target])
        y = made[target].to_numpy(float)
        large, small = (forecasts(made[columns].to_numpy(float), y, **how) for columns in ([*features, *on_trial], features))
        if not len(large):
            return pd.DataFrame(columns=["kind", "effect", "seed", "n", "loss_diff", "stat"])
        diff, stat = nested(y[len(y) - len(large) :], small, large)
        return pd.DataFrame([{"kind": kind, "effect": effect, "seed": seed, "n": len(large), "loss_diff": diff, "stat": stat}])

    return each.groupBy("kind", "effect", "seed").applyInPandas(one, "kind string, effect double, seed long, n long, loss_diff double, stat double")


def planted_at(medians: list[tuple[float, float]], sought: float = SOUGHT) -> float | None:
    """The effect at which the median statistic first reaches ``sought``, between the effects of a ladder by logarithms; None if none does."""
    last = None
    for effect, median in sorted(medians):
        if median >= sought:
            if last is None:
                return effect
            part = (sought - last[1]) / (median - last[1])
            return math.exp(math.log(last[0]) + part * (math.log(effect) - math.log(last[0])))
        last = effect, median
    return None


def on_a_line(medians: list[tuple[float, float]], sought: float = SOUGHT) -> float | None:
    """The effect at which the least-squares line through (effect, median statistic) reaches ``sought``."""
    import numpy as np

    slope, base = np.polyfit([e for e, _ in medians], [m for _, m in medians], 1)
    return float((sought - base) / slope) if slope > 0 else None


def positive(frame: DataFrame, features: list[str], news: list[str], target: str, rungs: int = 9, each: int = 50, fresh: int = 100, **how) -> DataFrame:
    """effect, found, of, median_stat, passed: of an effect at the edge of what the test can see, how many fresh runs see it.

    The effect is read off a ladder from 0.005 to 1 standard deviations, and then
    off a line through a narrow ladder about it; all rungs and seeds of a ladder
    go side by side.  No row if even the highest rung is too small to be seen.
    """

    def medians(ladder: list[float], first: int) -> list[tuple[float, float]]:
        tried = runs(frame, features, news, target, [("planted", e, first + s) for e in ladder for s in range(each)], **how)
        return [(r.effect, r.m) for r in tried.groupBy("effect").agg(F.percentile("stat", 0.5).alias("m")).collect()]  # a row a rung

    effect = planted_at(medians([0.005 * 200 ** (i / (rungs - 1)) for i in range(rungs)], 0))
    if effect is not None:
        effect = on_a_line(medians([effect * 2 ** (2 * i / (rungs - 1) - 1) for i in range(rungs)], each))
    grid = [("planted", effect, 2 * each + s) for s in range(fresh)] if effect else []
    last = runs(frame, features, news, target, grid, **how).groupBy("effect")
    found = last.agg(F.count_if(F.col("stat") > BOUND).alias("found"), F.count(F.lit(1)).alias("of"), F.percentile("stat", 0.5).alias("median_stat"))
    share = 100 * F.col("found") / F.col("of")
    return found.withColumn("passed", (share >= BAND[0]) & (share <= BAND[1]))


def negative(frame: DataFrame, features: list[str], news: list[str], target: str, seeds: int = 100, **how) -> DataFrame:
    """kind, found, better, worse, of, passed: finds in spoilt data, of which a sound test has few."""
    tried = runs(frame, features, news, target, [(k, 0.0, s) for k in ("permuted", "stale", "noise") for s in range(seeds)], **how)
    told = tried.groupBy("kind").agg(F.count_if(F.abs("stat") > BOUND).alias("found"), F.count_if(F.col("stat") > BOUND).alias("better"), F.count_if(F.col("stat") < -BOUND).alias("worse"), F.count(F.lit(1)).alias("of"))
    return told.withColumn("passed", F.col("found") * 100 <= MOST_FALSE * F.col("of"))


def matched_noise(frame: DataFrame, features: list[str], news: list[str], target: str, seeds: int = 100, **how) -> DataFrame:
    """loss_diff, noise_mean, noise_sd, z, mde, at_or_below, runs: the real columns' loss against that of as many noise columns."""
    tried = runs(frame, features, news, target, [("real", 0.0, 0), *[("noise", 0.0, s) for s in range(seeds)]], **how)
    real = tried.where("kind = 'real'").select(F.col("loss_diff").alias("real"))
    told = tried.where("kind = 'noise'").crossJoin(F.broadcast(real))  # one row
    told = told.groupBy("real").agg(F.avg("loss_diff").alias("noise_mean"), F.stddev_samp("loss_diff").alias("noise_sd"), F.count_if(F.col("loss_diff") <= F.col("real")).alias("at_or_below"), F.count(F.lit(1)).alias("runs")).withColumnRenamed("real", "loss_diff")
    z = (F.col("loss_diff") - F.col("noise_mean")) / F.col("noise_sd")
    return told.withColumn("z", z).withColumn("mde", SOUGHT * F.col("noise_sd")).select("loss_diff", "noise_mean", "noise_sd", "z", "mde", "at_or_below", "runs")
