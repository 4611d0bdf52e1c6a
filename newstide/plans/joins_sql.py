"""As-of, interval, lookup and membership joins, and set operations.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "strict_asof_days": (
        "J5 U2",
        """select day, session
        from strict_asof""",
    ),
    "firm_inclusive_asof": (
        "J6",
        """select firm, day, trade
        from firm_asof""",
    ),
    "scored_headlines": (
        "J2 J3 J15 T18",
        """select h.row_id, l.quality, case l.quality when 1 then 'positive' else 'negative' end as label, case l.quality when 1 then 1 else -1 end as signed
        from headlines h
        join labels l on h.doc_id = l.doc_id""",
    ),
    "ffill_panel": (
        "J7 U5 S11",
        """with firms as (
          select distinct firm
          from trades
        ),
        cal as (
          select @days_range(date '2024-01-01', date '2024-01-30') as day
        ),
        grid as (
          select firm, day
          from firms
          cross join cal
        ),
        j as (
          select g.firm, g.day, t.close, count(t.close) over (partition by g.firm order by g.day) as grp
          from grid g
          left join trades t on g.firm = t.firm and g.day = t.session
        )
        select firm, day, max(close) over (partition by firm, grp) as close, grp = 0 as before_first
        from j""",
    ),
    "band_join_neighbours": (
        "J8",
        """with d as (
          select doc_id, source, lang, published_date, template_key
          from keyed
        ),
        e as (
          select *, @plus(published_date, o) as near
          from d
          cross join (
            select @range(-2, 2) as o
          ) x
        )
        select a.doc_id as left_id, b.doc_id as right_id, @days(b.published_date, a.published_date) as gap
        from e a
        join d b on a.near = b.published_date and a.lang = b.lang and a.template_key = b.template_key and a.doc_id < b.doc_id""",
    ),
    "firm_interval_returns": (
        "J9 J10 F18 X4",
        """with f as (
          select t.firm, t.session, t.close, i.close as level, i.pos
          from firm_bars t
          join bars i on t.session = i.session
        )
        select firm, session, round(close / lag(close) over w - 1, 6) as ret, round(level / lag(level) over w - 1, 6) as market,
            pos - lag(pos) over w as gap, (lead(pos) over w) - pos as fwd_gap, round((lead(level, 5) over w) / level - 1, 6) as market_fwd5
        from f window w as (partition by firm order by session)""",
    ),
    "membership": (
        "J11 J12 P16",
        """select h.row_id, l.doc_id is not null as in_study
        from headlines h
        left join (
          select distinct doc_id
          from labels
        ) l on h.doc_id = l.doc_id""",
    ),
    "overlap_reconciliation": (
        "J14",
        """with o as (
          select cast(o_orderdate as date) as d, o_custkey % 50 as k, max(round(o_totalprice, 2)) as v
          from orders
          group by 1, 2
        ),
        n as (
          select d, k, v
          from o
          union all
          select d, k, v + 1
          from o
          where v > 150000
        )
        select o.d, o.k, bool_or(abs(o.v - n.v) < 0.005) as matches, count(*) as copies
        from o
        join n on o.d = n.d and o.k = n.k
        group by o.d, o.k""",
    ),
    "fallback_means": (
        "J16 F8",
        """with fit as (
          select firm, avg(ret) as alpha
          from firm_units
          where session < date '2024-01-16' and ret is not null
          group by firm
        ),
        m as (
          select avg(alpha) as a
          from fit
        )
        select u.firm, count(*) as n, round(max(coalesce(fit.alpha, m.a)), 6) as alpha
        from firm_units u
        cross join m
        left join fit on u.firm = fit.firm
        where u.session >= date '2024-01-16'
        group by u.firm""",
    ),
}
