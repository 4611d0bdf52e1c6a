"""Lags, rolling measures, events and calendars.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "monthly_spine": (
        "X8 A27 J17 A30",
        """with spine as (
          select source, m
          from (
            select distinct source
            from headlines
          ) s
          cross join (
            select @months_range(date '1996-01-01', date '2000-12-01') as m
          ) x
        ),
        c as (
          select source, cast(date_trunc('month', published_date) as date) as m, count(*) as n
          from headlines
          where date_parse_ok
          group by 1, 2
        )
        select spine.source, spine.m, coalesce(c.n, 0) as n
        from spine
        left join c on spine.source = c.source and spine.m = c.m""",
    ),
    "timing_flags": (
        "X5 A15",
        """with f as (
          select n.firm, a.trade, n.minute, n.day = a.trade as same_day, n.minute < 850 as before_close
          from news n
          join firm_asof a on n.firm = a.firm and n.day = a.day
          where a.trade is not null
        )
        select firm, trade, bool_or(same_day and before_close) as pre_close, bool_or(not (same_day and before_close)) as post_close, count(*) as n
        from f
        group by firm, trade""",
    ),
    "session_lags": (
        "W1 W2 M1 M2 M3 M5 M8",
        """select session, round(ret, 8) as ret_lag0, round(lag(ret) over w, 8) as ret_lag1, round(lag(ret, 2) over w, 8) as ret_lag2,
    round(lag(ret, 3) over w, 8) as ret_lag3, round(abs(lag(ret) over w), 8) as abs_lag1, round(lead(ret) over w, 8) as ret_next,
    round(lead(close, 5) over w / close - 1, 8) as fwd5, round(lead(close, 20) over w / close - 1, 8) as fwd20, round(range_pct, 8) as range_pct,
    round(log_volume, 8) as log_volume, sign(ret) = sign(lag(ret) over w) as same_sign,
    round(coalesce(greatest(-3.0, least(3.0, ln(nullif(volume, 0)) - ln(nullif(lag(volume) over w, 0)))), 0.0), 8) as vol_change
        from returns window w as (order by session)""",
    ),
    "rolling_risk": (
        "W3 W4 W5 M4 X2 X3",
        """select session, case when count(ret) over w20 = 20 then round(stddev_samp(ret) over w20, 8) end as vol20, case when count(close) over w250 >= 60
    then round(close / max(close) over w250 - 1, 8) end as drawdown250, case when count(log_range) over w5 = 5
    then round(avg(log_range) over w5, 8) end as har5, case when count(log_range) over w22 = 22 then round(avg(log_range) over w22, 8) end as har22,
    round(nullif(ln(high / low) * ln(high / low) / (4 * ln(2)), 0), 8) as parkinson, @wd(lead(session) over w) as next_weekday,
    @days(lead(session) over w, session) as gap_days
        from returns window w as (order by session), w20 as (order by session rows between 19 preceding and current row),
            w250 as (order by session rows between 249 preceding and current row), w5 as (order by session rows between 4 preceding and current row),
            w22 as (order by session rows between 21 preceding and current row)""",
    ),
    "crash_events": (
        "W7 W8 W9 P13 P14 F19",
        """select firm, session, age, case when count(*) over f20 = 20 then min(close) over f20 / nullif(close, 0) - 1 <= -0.9 end as crash,
    cast(sum(case when abs(ret) > 1 then 1 else 0 end) over (partition by firm order by session rows between current row and 5 following) as bigint) as jumps_ahead,
    case when count(ret) over f5 = 5 then round(nullif(sum(ret * ret) over f5, 0), 4) end as rv5
        from firm_units window f20 as (partition by firm order by session rows between 1 following and 20 following),
            f5 as (partition by firm order by session rows between 1 following and 5 following)""",
    ),
    "drawdown_panel": (
        "F19 W3 W4 W6 W7 W9 A4 J7",
        """select firm, session, pos, age, round(close, 6) as close, event, round(lag0, 6) as lag0, round(lag1, 6) as lag1, round(lag2, 6) as lag2, round(rv20, 6) as rv20,
    round(dd60, 6) as dd60, round(market_lag0, 6) as market_lag0, round(market_rv20, 6) as market_rv20, round(firm_tone20, 6) as firm_tone20, has_firm_news20, round(tone, 6) as tone
        from drawdown""",
    ),
    "trailing_news": (
        "W6",
        """with d as (
          select firm, day, count(*) as n
          from news
          group by firm, day
        )
        select firm, day, cast(sum(n) over (partition by firm order by day rows between 19 preceding and current row) as bigint) as news20
        from d""",
    ),
    "year_demeaned": (
        "W16",
        """select session, round(ret - avg(ret) over (partition by year(session)), 8) as ret
        from returns
        where ret is not null""",
    ),
    "percent_rank_average": (
        "W17",
        """select doc_id, round(avg_rank / n, 8) as pct
        from ranked
        cross join (
          select count(*) as n
          from preds
        ) c""",
    ),
    "next_session_by_firm": (
        "W18",
        """select firm, session, next_session
        from firm_units""",
    ),
    "shifted_news": (
        "W21 I15",
        """with n as (
          select pos, count(*) over () as n, ret
          from returns
        )
        select a.pos, round(b.ret, 8) as stale
        from n a
        join n b on b.pos = (a.pos + 250) % a.n""",
    ),
    "absent_weekdays": (
        "X7",
        """with c as (
          select distinct cast(o_orderdate as date) as session
          from orders
          where o_orderpriority like '1%'
        ),
        r as (
          select min(session) as a, max(session) as b
          from c
        ),
        d as (
          select @days_range(a, b) as day
          from r
        )
        select d.day
        from d
        left join c on d.day = c.session
        where @wd(d.day) < 5 and c.session is null""",
    ),
    "holiday_tags": (
        "X10",
        """with t as (
          select session, lead(session) over (order by session) as target
          from bars
        )
        select session, case when month(target) = 1 and day(target) <= 3 then 'new year' when month(target) = 5 and day(target) <= 2 then 'labour'
            else '' end as holiday, coalesce(target between date '1996-01-21' and date '1996-02-19' or target between date '1997-01-10'
            and date '1997-02-08', false) as in_period
        from t""",
    ),
    "winsorised": (
        "M6 M7",
        """with q as (
          select @q(ret, 0.01) as lo, @q(ret, 0.99) as hi
          from returns
          where ret is not null
        )
        select session, round(greatest(lo, least(hi, ret)), 8) as ret, round(case when volume > 0 then ret / volume else 0.0 end, 10) as ratio
        from returns
        cross join q
        where ret is not null""",
    ),
    "yearly_ranges": (
        "X9 S22",
        """with y as (
          select distinct year(session) as y
          from bars
        )
        select y, min(session) as first_session, max(session) as last_session, count(*) as sessions
        from bars b
        join y on year(b.session) = y.y
        group by y""",
    ),
}
