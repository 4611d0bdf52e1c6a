"""Index frames: one row a session, with price, news, range and macro columns.

Windows here run over sessions (some thousand rows) or, for macro columns,
over the days of one series.  News is aggregated before it meets a session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import drop_phantoms, forward_asof

WEEKDAYS = ("mon", "tue", "wed", "thu")


def _by_session():
    return Window.orderBy("session")


def _last(n: int):
    return _by_session().rowsBetween(1 - n, 0)


def _full(value: Column, column: Column, n: int, at_least: int | None = None) -> Column:
    """value, where the last n sessions hold at_least (by default n) values of column."""
    return F.when(F.count(column).over(_last(n)) >= (at_least or n), value)


def _next_weekdays(at_end: float | None) -> dict[str, Column]:
    """dow_next_*: whether the next session is a Monday, ... ; at_end on the last session."""
    ahead = F.lead("session").over(_by_session())
    return {f"dow_next_{name}": F.when(ahead.isNull(), F.lit(at_end)).otherwise((F.weekday(ahead) == i).cast("double")) for i, name in enumerate(WEEKDAYS)}


def index_frame(bars: DataFrame, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """session, close, ret_lag0 to ret_lag2, dow_next_*, rv20, dd250 and fwd<h> of bars without phantom sessions.

    A column is null where its window is short: rv20 under 20 returns, dd250
    under 60 closes, fwd<h> with fewer than h sessions ahead.
    """
    c = F.col("close")
    r = drop_phantoms(bars).withColumn("ret_lag0", c / F.lag(c).over(_by_session()) - 1)
    out = {f"ret_lag{k}": F.lag("ret_lag0", k).over(_by_session()) for k in (1, 2)}
    out |= _next_weekdays(0.0)
    out["rv20"] = _full(F.stddev_samp("ret_lag0").over(_last(20)), F.col("ret_lag0"), 20)
    out["dd250"] = _full(c / F.max(c).over(_last(250)) - 1, c, 250, 60)
    out |= {f"fwd{h}": F.lead(c, h).over(_by_session()) / c - 1 for h in horizons}
    return r.select("session", "close", "ret_lag0", *[e.alias(name) for name, e in out.items()])


def scored_sessions(news: DataFrame, bars: DataFrame, arms: dict[str, str]) -> DataFrame:
    """session and, for each arm (suffix: a condition on rows of news(day, score, ...)), n, mean, pos and neg of its scores.

    A headline counts on the first session after its day.  Sessions without a
    headline have no row; one without a headline of an arm has n 0 and nulls.
    """
    at = forward_asof(news, drop_phantoms(bars), "day", "session").where("matched is not null")
    columns = []
    for suffix, which in arms.items():
        score = F.when(F.expr(which), F.col("score"))
        columns += [
            F.count(score).alias(f"n{suffix}"),
            F.avg(score).alias(f"mean{suffix}"),
            F.avg((score > 0).cast("double")).alias(f"pos{suffix}"),
            F.avg((score < 0).cast("double")).alias(f"neg{suffix}"),
        ]
    return at.groupBy(F.col("matched").alias("session")).agg(*columns)


def direction_frame(bars: DataFrame, news: DataFrame, arms: dict[str, str], start: str) -> DataFrame:
    """The index frame from start on, with tone, has_news and log_n of each arm; 0 where an arm has no headline."""
    price = index_frame(bars)
    frame = price.join(scored_sessions(news, bars, arms), "session", "left")
    out = []
    for s in arms:
        n = F.coalesce(F.col(f"n{s}"), F.lit(0))
        out += [F.coalesce(F.col(f"mean{s}"), F.lit(0.0)).alias(f"tone{s}"), (n > 0).cast("double").alias(f"has_news{s}"), F.log1p(n).alias(f"log_n{s}")]
    return frame.where(F.col("session") >= F.lit(start).cast("date")).select(*price.columns, *out)


def replication_frame(bars: DataFrame, news: DataFrame, arms: dict[str, str], start: str) -> DataFrame:
    """The index frame with range and absolute return of the session and sent_* columns of each arm, named by their lag from the target."""
    ranges = drop_phantoms(bars).select("session", ((F.col("high") - F.col("low")) / F.col("close")).alias("range_pct_lag0"))
    price = index_frame(bars)
    frame = price.join(ranges, "session", "left").join(scored_sessions(news, bars, arms), "session", "left")
    first = next(iter(arms))
    out = [F.abs("ret_lag0").alias("abs_ret_lag0"), F.col("range_pct_lag0"), F.log1p(F.coalesce(F.col(f"n{first}"), F.lit(0))).alias("log_headlines_lag0")]
    for s in arms:
        out += [F.coalesce(F.col(f"{short}{s}"), F.lit(0.0)).alias(f"sent_{long}{s}_lag1") for short, long in (("mean", "mean"), ("pos", "pos_share"), ("neg", "neg_share"))]
        out.append(F.coalesce(F.col(f"n{s}") > 0, F.lit(False)).cast("double").alias(f"has_sent{s}_lag1"))
    return frame.where(F.col("session") >= F.lit(start).cast("date")).select(*price.columns, *out)


#: Fixed value: the least log range, one basis point.
FLOOR = 1e-4


def range_frame(bars: DataFrame, start: str) -> DataFrame:
    """Heterogeneous autoregression of the log range on 1, 5 and 22 sessions, the gap ahead, and the next session's Parkinson variance.

    A session whose high is its low counts with the floor in the past, and has
    no variance to score: pv_next is null before it.
    """
    c, span = F.col("close"), F.log(F.col("high") / F.col("low"))
    r = drop_phantoms(bars).withColumn("har1", F.log(F.greatest(span, F.lit(FLOOR)))).withColumn("_pv", span * span / (4 * math.log(2)))
    ahead = F.lead("_pv").over(_by_session())
    out = {f"har{n}": _full(F.avg("har1").over(_last(n)), F.col("har1"), n) for n in (5, 22)}
    out["abs_ret_lag0"] = F.abs(c / F.lag(c).over(_by_session()) - 1)
    out["gap_next"] = F.datediff(F.lead("session").over(_by_session()), "session")
    out["pv_next"] = F.when(ahead > 0, ahead)
    out |= _next_weekdays(0.0)
    return r.select("session", "har1", *[e.alias(name) for name, e in out.items()]).where(F.col("session") >= F.lit(start).cast("date"))


def with_orphans(frame: DataFrame, bars: DataFrame) -> DataFrame:
    """frame with high, low, vol_chg_lag0 and dow_next_* made anew from all bars; its own columns of these names go, all others stay.

    The volume change is of logs within 3 either way; a volume of 0 has none,
    nor has the session after, and both are 0.  The last bar has no next
    weekday.
    """
    volume = F.when(F.col("volume") > 0, F.log(F.col("volume").cast("double")))
    made = bars.select("session", "high", "low", volume.alias("_v"), *[e.alias(n) for n, e in _next_weekdays(None).items()])
    change = F.col("_v") - F.lag("_v").over(_by_session())
    made = made.withColumn("vol_chg_lag0", F.when(change.isNull(), 0.0).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), change)))).drop("_v")
    return frame.drop(*[c for c in made.columns if c != "session"]).join(made, "session", "left")


def with_macro(frame: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """frame with <name>_level, <name>_ret and <name>_is_ffill of each named series of series(name, day, known, level, ret).

    ``known`` is the day a value was published: a session sees the value
    published last, on that day or before, and of several published on one day
    that of the latest ``day``; rows without a name, day of publication or level
    tell nothing.  In a series without any ``ret`` it is the change from the day
    before among sessions and days of publication, so 0 on a session without a
    value of its own, where is_ffill is 1.  A series may be daily, weekly or
    monthly, and may lack rows altogether: nulls then.
    """
    known = series.where(F.col("name").isin(names) & F.col("known").isNotNull() & F.col("level").isNotNull())
    known = known.groupBy("name", "known").agg(F.max_by(F.struct("level", "ret"), F.struct("day", "level")).alias("v")).select("name", F.col("known").alias("session"), "v.level", "v.ret")
    days = frame.select("session").distinct().crossJoin(frame.sparkSession.createDataFrame([(n,) for n in names], "name string"))
    both = known.withColumn("own", F.lit(1)).join(days.withColumn("asked", F.lit(1)), ["name", "session"], "full")
    w = Window.partitionBy("name").orderBy("session")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_level", F.last("level", ignorenulls=True).over(to_here)).withColumn("_given", F.last("ret", ignorenulls=True).over(to_here))
    change = F.when(F.max("ret").over(Window.partitionBy("name")).isNull(), F.col("_level") / F.lag("_level").over(w) - 1)
    both = both.withColumn("_ret", F.coalesce("_given", change)).where("asked = 1")
    wide = both.groupBy("session").agg(*[
        F.max(F.when(F.col("name") == n, value)).alias(f"{n}_{what}")
        for n in names
        for what, value in (("level", F.col("_level")), ("ret", F.col("_ret")), ("is_ffill", F.col("own").isNull().cast("int")))
    ])
    return frame.drop(*[c for c in wide.columns if c != "session"]).join(wide, "session", "left")
