"""Queries of the index frames, with DuckDB oracles over numbered sessions, self-joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstide.operators import frames

from . import relational  # noqa: F401  (names the common tables)
from .dialect import render, run

START = "1996-06-01"
ARMS = {"": "true", "_ex_price": "not is_price_report", "_placebo": "is_price_report"}
SENT_ARMS = {"": "true", "_ex_price": "not is_price_report", "_price_only": "is_price_report"}
NEWS = "select published_date as day, score, is_price_report from tagged where is_canonical and date_parse_ok"
#: Stand-in macro series over orders: daily with gaps, weekly and published nine days after the week's first, monthly with returns of its own.
MACRO = """select 'urgent' as name, day, day as known, cast(sum(cents) as bigint) / (100.0 * count(*)) as level, cast(null as double) as ret
from (select cast(o_orderdate as date) as day, cast(round(o_totalprice * 100) as bigint) as cents from orders where o_orderpriority = '1-URGENT') u
group by day
union all
select 'weekly', week, @plus(week, 9), cast(count(*) as double), cast(null as double)
from (select @plus(cast(o_orderdate as date), 0 - @wd(cast(o_orderdate as date))) as week from orders) w
group by week
union all
select 'monthly', month, @plus(month, 45), cast(count(*) as double), cast(count(*) as double) / 1000.0 - 0.2
from (select cast(date_trunc('month', o_orderdate) as date) as month from orders) m
group by month"""
SERIES = ["urgent", "weekly", "monthly"]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("select session, close, high, low, volume from bars")(spark, sf_dir)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 8).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def frame_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction frame, tone of all news, without price reports and of those alone."""
    return _rounded(frames.direction_frame(_bars(spark, sf_dir), run(NEWS)(spark, sf_dir), ARMS, START))


def frame_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of the next return, with score means and shares of three arms."""
    return _rounded(frames.replication_frame(_bars(spark, sf_dir), run(NEWS)(spark, sf_dir), SENT_ARMS, START))


def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of the next session's range."""
    return _rounded(frames.range_frame(_bars(spark, sf_dir), START))


def frame_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range frame with volume change and weekdays made anew from all bars."""
    bars = _bars(spark, sf_dir)
    return _rounded(frames.with_orphans(frames.range_frame(bars, START), bars))


def frame_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily, a weekly and a monthly series on the sessions, by day of publication."""
    sessions = _bars(spark, sf_dir).select("session", "close")
    return _rounded(frames.with_macro(sessions, run(MACRO)(spark, sf_dir), SERIES))


QUERIES = {f.__name__: f for f in (frame_direction, frame_replication, frame_range, frame_orphans, frame_macro)}

_Q = """q as (select *, row_number() over (order by session) as i from (select b.* from bars b left join bars p on p.pos = b.pos - 1 where not (p.pos is not null and p.close = b.close and p.high = b.high and p.low = b.low)) k),
r as (select q.session, q.i, q.close, q.high, q.low, q.close / p.close - 1 as ret, ln(q.high / q.low) as span, isodow(n.session) as ahead, n.session as next_session from q left join q p on p.i = q.i - 1 left join q n on n.i = q.i + 1)"""
_DOW = ", ".join(f"case when coalesce(ahead, 0) = {k} then 1.0 else 0.0 end as dow_next_{name}" for k, name in enumerate(frames.WEEKDAYS, 1))
_INDEX = """s as (select a.i, stddev_samp(b.ret) as sd, count(b.ret) as k from r a join r b on b.i between a.i - 19 and a.i group by a.i),
t as (select a.i, max(b.close) as top, count(*) as k from r a join r b on b.i between a.i - 249 and a.i group by a.i)"""
_PRICE = f"""r.session, round(r.close, 8) as close, round(r.ret, 8) as ret_lag0, round(r1.ret, 8) as ret_lag1, round(r2.ret, 8) as ret_lag2, {_DOW.replace('ahead', 'r.ahead')},
round(case when s.k = 20 then s.sd end, 8) as rv20, round(case when t.k >= 60 then r.close / t.top - 1 end, 8) as dd250, round(f1.close / r.close - 1, 8) as fwd1, round(f5.close / r.close - 1, 8) as fwd5"""
_FROM = f"from r join s on s.i = r.i join t on t.i = r.i left join r r1 on r1.i = r.i - 1 left join r r2 on r2.i = r.i - 2 left join r f1 on f1.i = r.i + 1 left join r f5 on f5.i = r.i + 5 left join n on n.session = r.session where r.session >= date '{START}'"


def _news(arms: dict[str, str]) -> str:
    cells = ", ".join(f"count(*) filter (where {w}) as n{s}, avg(score) filter (where {w}) as m{s}, avg(case when score > 0 then 1.0 else 0.0 end) filter (where {w}) as p{s}, avg(case when score < 0 then 1.0 else 0.0 end) filter (where {w}) as g{s}" for s, w in arms.items())
    return f"n as (select q.session, {cells} from ({NEWS}) x asof join q on x.day < q.session group by q.session)"


_RANGE = f"""h as (select r.*, ln(case when span > 0.0001 then span else 0.0001 end) as h from r),
v as (select a.i, avg(b.h) filter (where b.i > a.i - 5) as h5, avg(b.h) as h22 from h a join h b on b.i between a.i - 21 and a.i group by a.i),
o as (select h.session, round(h.h, 8) as har1, round(case when h.i >= 5 then h5 end, 8) as har5, round(case when h.i >= 22 then h22 end, 8) as har22, round(abs(h.ret), 8) as abs_ret_lag0, date_diff('day', h.session, h.next_session) as gap_next,
round(case when f.span > 0 then f.span * f.span / (4 * ln(2)) end, 8) as pv_next, {_DOW.replace('ahead', 'h.ahead')} from h join v on v.i = h.i left join h f on f.i = h.i + 1 where h.session >= date '{START}')"""


_CELLS = ", ".join(f"round(max(case when name = '{n}' then {c} end), 8) as {n}_{what}" for n in SERIES for what, c in (("level", "level"), ("ret", "ret"))) + ", " + ", ".join(f"max(case when name = '{n}' and known = day then 0 when name = '{n}' then 1 end) as {n}_is_ffill" for n in SERIES)
ORACLES = {
    "frame_direction": render(f"with {_Q}, {_INDEX}, {_news(ARMS)} select {_PRICE}, " + ", ".join(f"round(coalesce(m{s}, 0.0), 8) as tone{s}, case when coalesce(n{s}, 0) > 0 then 1.0 else 0.0 end as has_news{s}, round(ln(1 + coalesce(n{s}, 0)), 8) as log_n{s}" for s in ARMS) + f" {_FROM}", duck=True),
    "frame_replication": render(
        f"with {_Q}, {_INDEX}, {_news(SENT_ARMS)} select {_PRICE}, round(abs(r.ret), 8) as abs_ret_lag0, round((r.high - r.low) / r.close, 8) as range_pct_lag0, round(ln(1 + coalesce(n, 0)), 8) as log_headlines_lag0, ".replace("coalesce(n, 0)", "coalesce(n.n, 0)")
        + ", ".join(f"round(coalesce(m{s}, 0.0), 8) as sent_mean{s}_lag1, round(coalesce(p{s}, 0.0), 8) as sent_pos_share{s}_lag1, round(coalesce(g{s}, 0.0), 8) as sent_neg_share{s}_lag1, case when coalesce(n.n{s}, 0) > 0 then 1.0 else 0.0 end as has_sent{s}_lag1" for s in SENT_ARMS)
        + f" {_FROM}",
        duck=True,
    ),
    "frame_range": render(f"with {_Q}, {_RANGE} select * from o", duck=True),
    "frame_orphans": render(
        f"""with {_Q}, {_RANGE},
    w as (select a.session, a.high, a.low, round(case when a.volume > 0 and p.volume > 0 then greatest(-3.0, least(3.0, ln(a.volume) - ln(p.volume))) else 0.0 end, 8) as vol_chg_lag0, isodow(f.session) as d from bars a left join bars p on p.pos = a.pos - 1 left join bars f on f.pos = a.pos + 1)
    select o.* exclude (dow_next_mon, dow_next_tue, dow_next_wed, dow_next_thu), round(w.high, 8) as high, round(w.low, 8) as low, vol_chg_lag0, """
        + ", ".join(f"cast(d = {k} as double) as dow_next_{name}" for k, name in enumerate(frames.WEEKDAYS, 1))
        + " from o join w on w.session = o.session",
        duck=True,
    ),
    "frame_macro": render(
        f"""with m as (select name, known, max_by(level, day) as level, max_by(ret, day) as ret from ({MACRO}) x group by name, known),
    g as (select name, session as day from (select distinct name from m) a cross join bars union select name, known from m),
    l as (select g.name, g.day, m.known, m.level, m.ret from g asof left join m on m.name = g.name and m.known <= g.day),
    c as (select l.name, l.day, l.known, l.level, case when l.name = 'monthly' then l.ret else l.level / b.level - 1 end as ret from l asof left join l b on b.name = l.name and b.day < l.day)
    select session, round(close, 8) as close, {_CELLS} from bars join c on c.day = session group by session, close""",
        duck=True,
    ),
}
