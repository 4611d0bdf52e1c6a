"""As-of joins and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_asof(left: DataFrame, right: DataFrame, left_day: str, right_day: str, by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """left with ``matched``: the first right_day after (or, not strict, on or after) left_day, within by; null past the end.

    Distinct days of both sides are merged and a range window looks forward, so
    no row meets another side's row; the window is over days, not rows.
    """
    by = by or []
    epoch = F.datediff("_day", F.lit("1970-01-01").cast("date"))
    days = left.select(*by, F.col(left_day).alias("_day")).where("_day is not null").distinct().withColumn("_s", F.lit(None).cast("date"))
    ends = right.select(*by, F.col(right_day).alias("_day")).where("_day is not null").distinct().withColumn("_s", F.col("_day"))
    w = Window.partitionBy(*by).orderBy("_e").rangeBetween(1 if strict else 0, Window.unboundedFollowing)
    found = days.unionByName(ends).withColumn("_e", epoch).withColumn("matched", F.min("_s").over(w)).where("_s is null")
    found = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_day", "matched")
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col(left_day) == F.col("_day")]
    return left.join(found, on, "left").select(*left.columns, "matched")


def fill_forward(panel: DataFrame, calendar: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """key, day, value on every day of the calendar: the last value known.

    Whether the days are broadcast is left to Spark, which checks their size.
    """
    grid = panel.select(key).distinct().crossJoin(calendar.select(F.col(calendar.columns[0]).alias(day)).distinct())
    w = Window.partitionBy(key).orderBy(day)
    return grid.join(panel.select(key, day, value), [key, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def drop_phantoms(bars: DataFrame, day: str = "session") -> DataFrame:
    """bars without the sessions whose close, high and low all repeat the session before."""
    w = Window.orderBy(day)  # over sessions, some ten thousand at most
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) & F.col(c).isNotNull() for c in ("close", "high", "low")]
    return bars.withColumn("_p", same[0] & same[1] & same[2]).where("not _p").drop("_p")


def seal(frame: DataFrame, day: str, boundary: str, targets: dict[str, int], confirmed: bool = False) -> DataFrame:
    """frame before boundary, its forward-looking targets null where they would read past it."""
    if confirmed:
        return frame
    w = Window.orderBy(F.desc(day))
    cut = frame.where(F.col(day) < F.lit(boundary).cast("date")).withColumn("_r", F.row_number().over(w))
    for c, ahead in targets.items():
        cut = cut.withColumn(c, F.when(F.col("_r") > ahead, F.col(c)))
    return cut.drop("_r")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error if a key repeats or is null."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(" or ".join(["n > 1", *[f"`{k}` is null" for k in keys]])).limit(1).collect()
    if bad:
        raise ValueError(f"keys {keys} repeat or are null: {bad[0]}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two frames whose keys are unique."""
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, "left")
