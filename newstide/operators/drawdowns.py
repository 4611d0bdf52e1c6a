"""The drawdown panel: a row for each firm and session, made firm by firm from the firm's own trades.

The panel is far larger than the trades it is made of, so it is never dealt out
or sorted: trades and news go to their firm's task once, which lays some firms'
sessions side by side and gives their rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Firms laid out at once.
FIRMS = 16
SCHEMA = "firm long, pos int, age int, close double, lag0 double, lag1 double, lag2 double, rv20 double, dd60 double, event double, firm_tone20 double, has_firm_news20 double"


def _moved(x, k: int):
    """x k columns later, or earlier where k is negative; nothing in their place."""
    import numpy as np

    out = np.full(x.shape, np.nan)
    if abs(k) < x.shape[1]:
        out[:, max(k, 0) : x.shape[1] + min(k, 0)] = x[:, max(-k, 0) : x.shape[1] - max(k, 0)]
    return out


def _extreme(x, n: int, pick, way: int):
    """The largest or least value that is there in x's column and the n - 1 before it (way 1), or after it (way -1)."""
    size = 1
    while size * 2 <= n:
        x, size = pick(x, _moved(x, way * size)), size * 2
    return pick(x, _moved(x, way * (n - size)))


def laid_out(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows of SCHEMA of some firms' rows(firm, pos, bar, close, tone_sum, n) over ``size`` sessions."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    at, firms = pd.factorize(pdf["firm"])
    pos, bar = pdf["pos"].to_numpy(np.int64), pdf["bar"].to_numpy(bool)
    shape, first = (len(firms), size), np.full(len(firms), size)
    np.minimum.at(first, at[bar], pos[bar])
    place = np.arange(size)
    age = place - first[:, None]
    close = np.full(shape, np.nan)
    close[at[bar], pos[bar]] = pdf["close"].to_numpy(float)[bar]
    close = np.take_along_axis(close, np.maximum.accumulate(np.where(np.isnan(close), 0, place), axis=1), axis=1)  # the last close

    def summed(column: str):
        x = np.zeros((len(firms), size + 19))
        x[at[~bar], pos[~bar] + 19] = pdf[column].to_numpy(float)[~bar]
        x[:, 19:][age < 0] = 0.0  # before the firm's first session
        return sliding_window_view(x, 20, axis=1).sum(axis=-1)

    ret = close / _moved(close, 1) - 1
    rv20 = np.full(shape, np.nan)
    if size >= 20:
        rv20[:, 19:] = sliding_window_view(ret, 20, axis=1).std(axis=-1, ddof=1)
    dd60 = close / _extreme(close, 60, np.fmax, 1) - 1
    fallen = _moved(_extreme(close, 20, np.fmin, -1), -1) / close - 1 < -0.7
    event = np.where(place + 20 < size, fallen.astype(float), np.nan)
    tone, news = summed("tone_sum"), summed("n")
    tone = np.where(news > 0, tone / np.maximum(news, 1), 0.0)
    told = age >= 40
    row = np.nonzero(told)[0]
    out = {"firm": np.asarray(firms)[row], "pos": np.broadcast_to(place, shape)[told].astype("int32"), "age": age[told].astype("int32")}
    cells = {"close": close, "lag0": ret, "lag1": _moved(ret, 1), "lag2": _moved(ret, 2), "rv20": rv20, "dd60": dd60, "event": event, "firm_tone20": tone, "has_firm_news20": (news > 0).astype(float)}
    return pd.DataFrame(out | {c: x[told] for c, x in cells.items()})


def panel(bars: DataFrame, news: DataFrame, sessions: DataFrame, size: int) -> DataFrame:
    """bars(firm, session, close), news(firm, session, tone_sum, n) and sessions(session, pos, ...), positions from 0 to size - 1.

    From its first bar on each firm has each session with its last close; rows
    are those of age 40 and more, with the columns of their session.
    """
    day = F.broadcast(sessions)
    none = F.lit(None).cast("double")
    rows = bars.join(day, "session").select("firm", "pos", F.lit(True).alias("bar"), F.col("close").cast("double").alias("close"), none.alias("tone_sum"), none.alias("n"))
    rows = rows.unionByName(news.join(day, "session").select("firm", "pos", F.lit(False).alias("bar"), none.alias("close"), F.col("tone_sum").cast("double"), F.col("n").cast("double")))

    def lay(batches):
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            change = (batch["firm"].diff() != 0).to_numpy().nonzero()[0]  # where firms begin; the last one may go on
            for k in range(0, len(change) - 1, FIRMS):
                yield laid_out(batch.iloc[change[k] : change[min(k + FIRMS, len(change) - 1)]], size)
            held = batch.iloc[change[-1] :] if len(change) else None
        if held is not None and len(held):
            yield laid_out(held, size)

    made = rows.where("firm is not null").repartition("firm").sortWithinPartitions("firm").mapInPandas(lay, SCHEMA)
    return made.join(day, "pos")
