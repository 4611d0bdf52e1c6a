"""Walk-forward models: numpy kernels run once for each arm by applyInPandas.

Everything that is learned is fitted on rows before i - embargo, in blocks of
``refit`` rows, so one pass per arm replaces a loop of distributed fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.sources import readers

from . import newton


def ols(x, y):
    """Coefficients with the intercept first."""
    import numpy as np

    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def logit(x, y, c: float = 1.0, balanced: bool = False, rounds: int = 50, times=None):
    """Newton's method for an l2-penalised logistic fit (intercept free): intercept first.  times: how often each row stands."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    weight = np.ones(len(y)) if times is None else np.asarray(times, float)
    if balanced:
        weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    ridge = np.eye(a.shape[1]) / c
    ridge[0, 0] = 1e-9
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def softmax(x, label, c: float = 1.0, rounds: int = 100):
    """Newton's method for an l2-penalised multinomial fit (intercepts free): one row of weights for each class that ``label`` holds, intercept first.

    With two classes the fit is :func:`logit`'s, with one it is certain.  A step
    that doesn't lower the loss is halved.
    """
    import numpy as np

    classes = np.unique(label)
    a = np.column_stack([np.ones(len(x)), x])
    k, p = len(classes), a.shape[1]
    if k < 3:
        w = np.zeros((k, p))
        if k == 2:
            w[1] = logit(x, (label == classes[1]).astype(float), c)
        return classes, w
    hit = (np.asarray(label)[:, None] == classes).astype(float)
    ridge = np.tile(np.append(0.0, np.full(p - 1, 1 / c)), k)

    def loss(w):
        s = a @ w.reshape(k, p).T
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - (s * hit).sum(axis=1)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(k * p)
    for _ in range(rounds):
        prob = shares(a, w.reshape(k, p))
        slope = ((prob - hit).T @ a).ravel() + ridge * w
        bend = np.empty((k * p, k * p))
        for i in range(k):
            for j in range(k):
                both = prob[:, i] * ((i == j) - prob[:, j])
                bend[i * p : (i + 1) * p, j * p : (j + 1) * p] = (a * both[:, None]).T @ a
        bend[np.diag_indices(k * p)] += ridge + 1e-9  # intercepts are told up to a common shift
        step, size, here = np.linalg.solve(bend, slope), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > here:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return classes, w.reshape(k, p)


def shares(a, w):
    """Class probabilities of rows a (intercept first) under rows of weights."""
    import numpy as np

    s = a @ w.T
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def tercile(y, edges):
    """0 under the first edge, 2 over the second, else 1: a value on an edge is in the middle."""
    import numpy as np

    return np.where(y < edges[0], 0, np.where(y > edges[1], 2, 1))


def boost(x, y, rounds: int = 200, rate: float = 0.05, depth: int = 3, bins: int = 255, least: int = 20):
    """Gradient-boosted regression trees over histograms of quantile bins, for squared error; a function that forecasts rows."""
    import numpy as np

    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = lambda z: np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, z.T, strict=True)])
    codes, base = binned(x), float(np.mean(y))
    width = max(len(e) for e in edges) + 1
    rest, trees = y - base, []

    def grow(rows, deep: int):
        value = float(rest[rows].mean())
        if deep == depth or len(rows) < 2 * least:
            return value
        best = (1e-12, None, None)
        for f in range(x.shape[1]):
            c = codes[rows, f]
            n = np.cumsum(np.bincount(c, minlength=width))[:-1]
            g = np.cumsum(np.bincount(c, weights=rest[rows], minlength=width))[:-1]
            total = float(rest[rows].sum())
            fine = (n >= least) & (len(rows) - n >= least)
            gain = np.where(fine, g**2 / np.maximum(n, 1) + (total - g) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), -np.inf)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] is None:
            return value
        left = codes[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[left], deep + 1), grow(rows[~left], deep + 1)

    def leaves(tree, z, rows, out):
        if isinstance(tree, float):
            out[rows] = tree
        else:
            f, k, a, b = tree
            left = z[rows, f] <= k
            leaves(a, z, rows[left], out)
            leaves(b, z, rows[~left], out)
        return out

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        rest = rest - rate * leaves(tree, codes, np.arange(len(y)), np.empty(len(y)))

    def forecast(z):
        z = binned(z)
        return base + rate * sum((leaves(t, z, np.arange(len(z)), np.empty(len(z))) for t in trees), np.zeros(len(z)))

    return forecast


def residual(x, controls, rows):
    """x less its regression on controls, fitted on ``rows`` (a slice, or the number of first rows) alone."""
    import numpy as np

    rows = rows if isinstance(rows, slice) else slice(0, rows)
    b = ols(controls[rows], x[rows])
    return x - np.column_stack([np.ones(len(x)), controls]) @ b


def walk(frame, features: list[str], target: str, kind: str = "regress", min_train: int = 500, refit: int = 20, horizon: int = 1, residualise: tuple[str, list[str]] | None = None, window: int | None = None, part: tuple[int, int] = (0, 1)):
    """Predictions of one arm (pandas in, pandas out) for rows from min_train on.

    regress: pred; boost: pred of boosted trees; sign: probability of a rise;
    logvar: exp of the fit times the smearing factor; terciles: p0, p1, p2 with
    edges of the training slice.  The training slice expands, or with window
    slides over so many rows.  part (i, n) does every n-th refit from the i-th.
    """
    import numpy as np
    import pandas as pd

    use = frame.dropna(subset=[*features, target]).reset_index(drop=True)
    x, y, embargo, out = use[features].to_numpy(float), use[target].to_numpy(float), max(5, horizon), []
    for start in range(min_train + refit * part[0], len(use), refit * part[1]):
        stop = max(1, start - embargo)
        train, test = slice(max(0, stop - window) if window else 0, stop), slice(start, min(start + refit, len(use)))
        z = x
        if residualise:
            z = x.copy()
            k = features.index(residualise[0])
            z[:, k] = residual(x[:, k], use[residualise[1]].to_numpy(float), train)
        mean, sd = z[train].mean(axis=0), z[train].std(axis=0)
        z = (z - mean) / np.where(sd > 0, sd, 1)
        one = np.column_stack([np.ones(test.stop - test.start), z[test]])
        got = {"session": use["session"][test], "y": y[test]}
        if kind == "regress":
            got["pred"] = one @ ols(z[train], y[train])
        elif kind == "boost":
            got["pred"] = boost(x[train], y[train])(x[test])
        elif kind == "sign":
            got["pred"] = 1 / (1 + np.exp(-one @ logit(z[train], (y[train] > 0).astype(float))))
        elif kind == "logvar":
            b = ols(z[train], np.log(y[train]))
            rest = np.log(y[train]) - np.column_stack([np.ones(train.stop - train.start), z[train]]) @ b
            got["pred"] = np.exp(one @ b) * np.exp(rest).mean()
        elif kind == "terciles":
            edges = np.quantile(y[train], [1 / 3, 2 / 3])
            classes, w = softmax(z[train], tercile(y[train], edges))
            p = np.zeros((len(one), 3))  # a class that training lacks has probability 0
            p[:, classes] = shares(one, w)
            got |= {"pred": p @ np.arange(3), "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2], "y": tercile(y[test], edges).astype(float)}
        else:
            raise ValueError(kind)
        got["constant"] = float((y[train] > 0).mean() >= 0.5)
        out.append(pd.DataFrame(got))
    columns = ["session", "y", "pred", "constant", *(["p0", "p1", "p2"] if kind == "terciles" else [])]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def walk_forward(frame: DataFrame, arms: dict[str, list[str]], target: str, kind: str = "regress", parts: int = 1, **how) -> DataFrame:
    """arm, session, y, pred, constant of each arm's features over frame(session, ...): arms, and parts of their refits, run side by side."""
    spark = frame.sparkSession
    wanted = sorted({c for cols in arms.values() for c in cols} | {target, "session"} | set((how.get("residualise") or ("", []))[1]))
    each = spark.createDataFrame([(a, i) for a in arms for i in range(parts)], "arm string, part int").crossJoin(frame.select(*wanted))

    def one(key, pdf):
        pdf = pdf.sort_values("session")
        return walk(pdf, arms[key[0]], target, kind, part=(int(key[1]), parts), **how).assign(arm=key[0])

    schema = "session date, y double, pred double, constant double, arm string" if kind != "terciles" else "session date, y double, pred double, constant double, p0 double, p1 double, p2 double, arm string"
    return each.groupBy("arm", "part").applyInPandas(one, schema)


def panel_blocks(panel: DataFrame, features: list[str], event: str, warm: int = 250, ahead: int = 20, step: int = 20) -> DataFrame:
    """Pooled logistic warnings: each block of ``step`` positions is fitted on pos < k - ahead; alarm at the training 95th percentile.

    panel(pos, firm, session, features, event).  All blocks are fitted at once
    by Newton steps that Spark adds up; a block without both classes before it
    has no rows.
    """
    rows = panel.select("pos", "firm", "session", *features, event).dropna(subset=features)
    fitted, known = newton.expanding(rows, features, event, warm, ahead, step, balanced=True)
    bar = newton.score_quantile(known, features, fitted, 0.95)
    block = F.floor((F.col("pos") - warm) / step).cast("int")
    scored = newton.with_scores(rows.where(F.col("pos") >= warm), features, fitted, block, _bar=bar)
    return scored.select(F.col("pos").cast("long").alias("pos"), F.col("firm").cast("long").alias("firm"), "session", F.col(event).cast("double").alias("event"), (1 / (1 + F.exp(-F.col("score")))).alias("prob"), (F.col("score") >= F.col("_bar")).alias("alarm"))


#: Blocks of positions that share a task and a copy of the history before them.
TOGETHER = 5


def with_history(rows: DataFrame, warm: int, step: int) -> DataFrame:
    """Rows with ``_block``, the first position of a run of TOGETHER blocks: once for the run that they are in, and once for each later one."""
    size = step * TOGETHER
    own = F.greatest(F.lit(warm), warm + F.floor((F.col("pos") - warm) / size) * size).cast("long")
    last = F.broadcast(rows.agg(F.max("pos").cast("long").alias("_last")))  # one row
    runs = F.when(own <= F.col("_last"), F.sequence(own, F.col("_last"), F.lit(size).cast("long")))
    return rows.crossJoin(last).withColumn("_block", F.explode(runs)).drop("_last")


def isotonic(x, y):
    """Pool-adjacent-violators: (sorted x, fitted values)."""
    import numpy as np

    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v in np.asarray(y, float)[order]:
        blocks.append([v, 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.asarray(x, float)[order], np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])


def calibrate(frame, method: str = "platt", warm: int = 260, step: int = 20, ahead: int = 20):
    """frame(pos, prob, event) with ``calibrated``: each block fitted on rows whose outcome was known."""
    import numpy as np

    frame = frame.sort_values("pos").copy()
    frame["calibrated"] = np.nan
    for k in range(warm, int(frame["pos"].max()) + 1, step):
        past = frame[(frame["pos"] < k - ahead) & frame["event"].notna()]
        now = (frame["pos"] >= k) & (frame["pos"] < k + step)
        if past["event"].nunique() < 2 or not now.any():
            continue
        clip = lambda p: np.clip(p, 1e-6, 1 - 1e-6)
        if method == "platt":
            odds = lambda p: np.log(clip(p) / (1 - clip(p)))
            w = logit(odds(past["prob"].to_numpy())[:, None], past["event"].to_numpy(float), c=1e6)
            got = 1 / (1 + np.exp(-(w[0] + w[1] * odds(frame.loc[now, "prob"].to_numpy()))))
        else:
            got = np.interp(frame.loc[now, "prob"], *isotonic(past["prob"].to_numpy(), past["event"].to_numpy()))
        frame.loc[now, "calibrated"] = clip(got)
    return frame


def calibrate_blocks(preds: DataFrame, method: str = "platt", warm: int = 260, step: int = 20, ahead: int = 20) -> DataFrame:
    """preds(pos, prob, event, ...) with ``calibrated``, as :func:`calibrate` has it.

    Platt's fits are Newton steps that Spark adds up; isotonic ones need their
    rows in order: runs of blocks are groups, and equal rows are counted first.
    """
    import numpy as np
    import pandas as pd

    if method == "platt":
        clipped = F.least(F.greatest(F.col("prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
        rows = preds.withColumn("_odds", F.log(clipped / (1 - clipped)))
        fitted, _ = newton.expanding(rows, ["_odds"], "event", warm, ahead, step, c=1e6, standardise=False)
        block = F.when(F.col("pos") >= warm, F.floor((F.col("pos") - warm) / step)).otherwise(-1).cast("int")
        told = preds.sparkSession.createDataFrame([(b, *w) for b, w in zip(fitted.number, fitted.weights, strict=True)], "_block int, _w0 double, _w1 double")
        rows = rows.withColumn("_block", block).join(F.broadcast(told), "_block", "left")
        prob = 1 / (1 + F.exp(-(F.col("_w0") + F.col("_w1") * F.col("_odds"))))
        return rows.withColumn("calibrated", F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))).select(*preds.columns, F.when(F.col("_w0").isNotNull(), F.col("calibrated")).alias("calibrated"))
    if method != "isotonic":
        raise ValueError(method)

    cells = preds.groupBy("pos", "prob", "event").agg(F.count(F.lit(1)).alias("times"))

    clip = lambda p: np.clip(np.asarray(p, float), 1e-6, 1 - 1e-6)

    def run(key, pdf):
        pdf = pdf.sort_values(["pos", "prob", "event"])
        out = [pdf[["pos", "prob"]].iloc[:0].assign(calibrated=0.0)]
        for k in range(int(key[0]), int(key[0]) + step * TOGETHER, step):
            past = pdf[(pdf["pos"] < k - ahead) & pdf["event"].notna()]
            now = pdf[(pdf["pos"] >= k) & (pdf["pos"] < k + step)][["pos", "prob"]].drop_duplicates()
            if past["event"].nunique() < 2 or not len(now):
                continue
            whole = past.loc[past.index.repeat(past["times"])]
            got = np.interp(now["prob"], *isotonic(whole["prob"].to_numpy(), whole["event"].to_numpy()))
            out.append(now.assign(calibrated=clip(got)))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    found = with_history(cells, warm, step).groupBy("_block").applyInPandas(run, "pos long, prob double, calibrated double")
    found = found.select(F.col("pos").alias("_pos"), F.col("prob").alias("_prob"), "calibrated")
    return preds.join(found, (preds["pos"] == F.col("_pos")) & (preds["prob"] == F.col("_prob")), "left").drop("_pos", "_prob")


def dimson_betas(returns: DataFrame, market: DataFrame, years: list[int] | None = None, window: int = 250, least: int = 60) -> DataFrame:
    """firm, year, beta: slopes on the market's lag, same and lead day summed, over the sessions before each year; 1 with too few or none.

    Every firm has a row for each year of the market's calendar, or for those of ``years``.
    """
    import pandas as pd

    m = market.select("session", "market", F.expr("lag(market) over (order by session)").alias("m_lag"), F.expr("lead(market) over (order by session)").alias("m_lead"), F.expr("row_number() over (order by session)").alias("pos"))
    joined = returns.where("abs(ret) <= 0.1").join(m, "session").where("m_lag is not null and m_lead is not null")
    first = m.groupBy(F.year("session").alias("year")).agg(F.min("pos").alias("first"))
    if years is not None:
        first = first.where(F.col("year").isin(years))
    pairs = joined.join(F.broadcast(first), (F.col("pos") < F.col("first") - 1) & (F.col("pos") >= F.col("first") - window))

    def fit(key, pdf):
        pdf = pdf.sort_values("pos")  # sums in one order, whatever the shuffle's
        beta = 1.0 if len(pdf) < least else float(ols(pdf[["m_lag", "market", "m_lead"]].to_numpy(float), pdf["ret"].to_numpy(float))[1:].sum())
        return pd.DataFrame({"firm": [key[0]], "year": [key[1]], "beta": [beta]})

    betas = pairs.groupBy("firm", "year").applyInPandas(fit, "firm long, year int, beta double")
    every = returns.select(F.col("firm").cast("long").alias("firm")).distinct().crossJoin(F.broadcast(first.select("year")))
    return every.join(betas, ["firm", "year"], "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))


def demean_two_way(panel: DataFrame, value: str, a: str, b: str, tolerance: float = 1e-12, rounds: int = 1000) -> DataFrame:
    """panel(a, b, value) with value less its means by a and b, by alternating projections.

    What changes from round to round is one effect for each a and each b.  The
    panel is dealt out by a and written once; a round is two aggregations of what
    was written, whose sums are nearly whole within a task, as an a lies in one
    file.  Effects go to tables in the shared folder, which cuts the lineage.  Ends when no effect of a moves by
    more than tolerance, or when rounding alone moves them (they move no less
    than in the round before, and by under 1e-10 of the largest value).
    """
    rows = panel.select(a, b, F.col(value).cast("double").alias("_y")).where("_y is not null")
    rows = readers.stored(rows.repartition(a), "panel-to-demean")
    size = max(1.0, rows.agg(F.max(F.abs("_y"))).first()[0] or 0.0)
    effects, by_b, last = readers.stored(rows.groupBy(a).agg(F.avg("_y").alias("_a")), "effects"), None, math.inf
    for _ in range(rounds):  # effects are small beside the panel: Spark sends them to its tasks
        by_b = readers.stored(rows.join(effects, a).groupBy(b).agg(F.avg(F.col("_y") - F.col("_a")).alias("_b")), "effects")
        new = readers.stored(rows.join(by_b, b).groupBy(a).agg(F.avg(F.col("_y") - F.col("_b")).alias("_a")), "effects")
        moved = new.select(a, F.col("_a").alias("_n")).join(effects, a).agg(F.max(F.abs(F.col("_n") - F.col("_a")))).first()[0]
        if moved is None or moved <= tolerance or last <= moved <= 1e-10 * size:
            break
        effects, last = new, moved
    return rows.join(effects, a).join(by_b, b).select(a, b, (F.col("_y") - F.col("_a") - F.col("_b")).alias(value))
