"""Scans, page fields, sinks and inventories.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "headline_flags": (
        "S1 P1 P2 P3 X1",
        """select h.row_id, h.published_date, h.date_parse_ok, coalesce(h.date_parse_ok and h.published_date between w.first_day
    and w.last_day, false) as in_window, coalesce(h.headline in ('This.', 'Le', 'Zu und. Dieüauß der.'), false) as is_boilerplate,
    coalesce(h.date_parse_ok and h.published_date between w.first_day and w.last_day
    and not h.headline in ('This.', 'Le', 'Zu und. Dieüauß der.'), false) as kept
        from headlines h
        left join windows w on h.source = w.source""",
    ),
    "calendar_without_phantoms": (
        "S9 P11 U3 J12",
        """select session, row_number() over (order by session) - 1 as pos
        from (
          select session, close = lag(close) over w and high = lag(high) over w and low = lag(low) over w as phantom
          from bars window w as (order by session)
        ) x
        where phantom is distinct
        from true""",
    ),
    "page_fields": (
        "S13",
        """select page_id, @rx(html, '<title>([^<]*)</title>', 1) as title, @rx(html, 'lang="([a-z]+)"', 1) as lang, @rx(url, '://([^/?#]+)', 1) as host,
    @rx(url, '://[^/]+(/[^#]*)', 1) as path, @num(nullif(@rx(url, '/([0-9]+)', 1), '')) as article_id,
    @date(nullif(@rx(html, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '')) as day
        from pages""",
    ),
    "first_page_wins": (
        "S17 S18 S19",
        """with h as (
          select page_id, @rx(url, '://[^/]+(/[a-z]+)/', 1) as href, @rx(url, '://([^/]+)', 1) as host
          from pages
        )
        select host, href, min(page_id) as first_page, count(*) as copies, count(distinct page_id % 3) > 1 as conflicting,
            min(page_id % 30) >= 1 as saturated
        from h
        group by host, href""",
    ),
    "json_payload": (
        "S14",
        """select event_id, try_cast(coalesce(@json(props, k), nullif(@rx(props, '"k": *([0-9]+)', 1), '')) as bigint) as k,
    event_type in ('click', 'view', 'purchase') as valid
        from events""",
    ),
    "localised_numbers": (
        "S21",
        """select o_orderkey, @num(replace(replace(t, ' ', ''), ',', '.')) as value, split_part(t2, ',', 1) as a, split_part(t2, ',', 2) as b
        from (
          select o_orderkey, concat(cast(o_custkey as @str), ' ', lpad(cast(o_orderkey % 1000 as @str), 3, '0'),
              ',', cast(o_orderkey % 100 as @str)) as t, concat(cast(o_orderkey as @str), ',', o_orderstatus, ',x,y') as t2
          from orders
        ) x""",
    ),
    "table_inventory": (
        "S29",
        """select 'documents' as name, count(*) as n
        from documents
        union all
        select 'events', count(*)
        from events
        union all
        select 'lineitem', count(*)
        from lineitem
        union all
        select 'pages', count(*)
        from pages""",
    ),
    "spliced_prices": (
        "S8",
        """with o as (
          select firm, session, close
          from firm_bars
          where session < date '1996-01-01'
        ),
        n as (
          select firm, session, close * 2 as close
          from firm_bars
          where session >= date '1995-06-01'
        ),
        f as (
          select o.firm, min(n.close / o.close) as lo, max(n.close / o.close) as hi
          from o
          join n on o.firm = n.firm and o.session = n.session
          group by o.firm
        )
        select o.firm, o.session, round(o.close, 8) as close, 'old' as part
        from o
        union all
        select n.firm, n.session, round(n.close / f.lo, 8), 'new'
        from n
        join f on n.firm = f.firm
        where n.session >= date '1996-01-01' and f.hi - f.lo < 1e-9""",
    ),
    "arabic_dates": (
        "S3",
        """with r as (
          select doc_id, case when headline like '%the%' then concat(cast(1 + length(headline) % 31 as @str), ' مارس 2021') when headline like '%la%'
              then 'منذ يومين' else headline end as raw
          from headlines
        ),
        p as (
          select doc_id, raw, @rx(raw, '^([0-9]+) [^ ]+ ([0-9]+)$', 1) as d, @rx(raw, '^([0-9]+) ([^ ]+) [0-9]+$', 2) as m,
              @rx(raw, '^[0-9]+ [^ ]+ ([0-9]+)$', 1) as y
          from r
        )
        select doc_id, @date(case when m = 'مارس' then concat(y, '-03-', lpad(d, 2, '0')) end) as day, case when m = 'مارس' then 'abs'
            when raw like 'منذ%' then 'relative' else 'other' end as category
        from p""",
    ),
    "daily_news_features": (
        "S1 T7 W11 J5 A1 A2 J1 W1 W2 F20",
        """select b.session, round(b.close, 8) as close, round(b.ret, 8) as ret_lag0, round(lag(b.ret) over w, 8) as ret_lag1,
    round(lead(b.ret) over w, 8) as ret_next, round(b.range_pct, 8) as range_pct, coalesce(n.n_headlines, 0) as n_headlines,
    coalesce(n.n_sources, 0) as n_sources, round(coalesce(n.sent_mean, 0.0), 6) as sent_mean, round(coalesce(n.neg_share, 0.0), 6) as neg_share, case
    when n.session is null then 0.0 else 1.0 end as has_sent, round(ln(1 + coalesce(n.n_headlines, 0)), 6) as log_headlines
        from returns b
        left join news_by_session n on b.session = n.session window w as (order by b.session)""",
    ),
}
