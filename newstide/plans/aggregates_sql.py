"""Counts, shares, distributions and contingency tables.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "corpus_funnel": (
        "A5",
        """select coalesce(source, 'TOTAL') as source, count(*) as raw, count(*) filter (where date_parse_ok) as cleaned, count(*) filter (where date_parse_ok
    and relevance_tag <> 'other') as relevant, count(*) filter (where date_parse_ok and relevance_tag <> 'other' and is_canonical) as canonical
        from tagged
        group by rollup(source)""",
    ),
    "completeness": (
        "A6",
        """select source, count(*) as n, round(100.0 * count(*) filter (where headline is null) / count(*), 4) as pct_null,
    round(100.0 * count(*) filter (where trim(headline) = '') / count(*), 4) as pct_empty, count(*) - count(distinct headline) as dups
        from headlines
        group by source""",
    ),
    "repeated_headlines": (
        "A7",
        """select headline, count(*) as n
        from headlines
        group by headline
        having count(*) > 3""",
    ),
    "coverage_by_month": (
        "A8 X6",
        """select source, @month(published_date) as month, count(*) as n
        from headlines
        where date_parse_ok
        group by source, @month(published_date)""",
    ),
    "coverage_summary": (
        "A11",
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
        ),
        z as (
          select spine.source, spine.m, coalesce(c.n, 0) as n
          from spine
          left join c on spine.source = c.source and spine.m = c.m
        ),
        w as (
          select *, avg(n) over (partition by source order by m rows between 3 preceding and 1 preceding) as prior3,
              row_number() over (partition by source order by m) as k, case when n = 0 then 1 else 0 end as zero,
              row_number() over (partition by source order by m) - row_number() over (partition by source, case when n = 0 then 1
              else 0 end order by m) as island
          from z
        ),
        med as (
          select source, @q(cast(n as double), 0.5) as med
          from z
          where n > 0
          group by source
        ),
        runs as (
          select source, island, max(m) as last_zero, count(*) as len
          from w
          where zero = 1
          group by source, island
        )
        select w.source, count(*) filter (where zero = 1) as zero_months, count(*) filter (where n > 3 * med.med) as spikes,
            count(*) filter (where k >= 4 and prior3 >= 5 and n < 0.3 * prior3) as cliffs, max(r.last_zero) as last_gap_end
        from w
        join med on w.source = med.source
        left join (
          select source, max(last_zero) as last_zero
          from runs
          where len >= 2
          group by source
        ) r on w.source = r.source
        group by w.source""",
    ),
    "duplicate_share": (
        "A9",
        """with g as (
          select source, headline, count(*) as n
          from headlines
          group by source, headline
        )
        select source, round(sum(n - 1) / cast(sum(n) as double), 4) as dup_share
        from g
        group by source""",
    ),
    "cross_source_duplicates": (
        "A10",
        """select template_key, count(distinct source) as n_sources, count(*) as n
        from keyed
        group by template_key
        having count(distinct source) > 1""",
    ),
    "language_mix": (
        "A12",
        """select source, lang, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by source) as double), 6) as share
        from headlines
        group by source, lang""",
    ),
    "topical_geography": (
        "A13 P18",
        """with s as (
          select source, count(*) as n, count(*) filter (where @like(lower(headline), '(the|of)')) as home_n,
              count(*) filter (where @like(lower(headline), 'les?')) as le_n, count(*) filter (where @like(lower(headline), 'und')) as und_n
          from headlines
          group by source
        )
        select source, n, round(home_n / cast(n as double), 6) as home_share, case when le_n >= und_n then 'le' else 'und' end as top_other,
            greatest(le_n, und_n) as top_other_n, greatest(le_n, und_n) > home_n and greatest(le_n, und_n) >= 0.05 * n as wrong_country
        from s""",
    ),
    "source_by_tag": (
        "A14",
        """select source, count(*) filter (where relevance_tag = 'home') as home, count(*) filter (where relevance_tag = 'linked') as linked,
    count(*) filter (where relevance_tag = 'other') as other
        from tagged
        group by source""",
    ),
    "news_session_frame": (
        "A1 A2 A3 A4 J1 J4",
        """select b.session, coalesce(n.n_headlines, 0) as n_headlines, coalesce(n.n_sources, 0) as n_sources, coalesce(n.n_home, 0) as n_home,
    coalesce(n.n_price_reports, 0) as n_price_reports, round(coalesce(n.sent_mean, 0.0), 6) as tone, case when n.session is null then 0.0
    else 1.0 end as has_news, round(ln(1 + coalesce(n.n_headlines, 0)), 6) as log_n, round(coalesce(n.sent_mean_ex_price, 0.0), 6) as tone_ex_price,
    round(coalesce(n.sent_mean_price_only, 0.0), 6) as tone_price_only, round(coalesce(n.pos_share, 0.0), 6) as pos_share
        from bars b
        left join news_by_session n on b.session = n.session""",
    ),
    "unit_accounting": (
        "A17",
        """with u as (
          select firm % 10 as bucket, year(session) as y, case when ret is null then 'no return' when age < 3 then 'young' when abs(ret) > 5
              then 'jump' else 'used' end as reason
          from firm_units
        )
        select reason, y, bucket, count(*) as n
        from u
        group by grouping sets ((reason, y, bucket), (reason, y), (reason), ())""",
    ),
    "sufficient_statistics": (
        "A18 W13 F6",
        """with d as (
          select firm, session, ret - avg(ret) over (partition by firm) as y, x - avg(x) over (partition by firm) as x
          from (
            select firm, session, ret, cast(age as double) as x
            from firm_units
            where ret is not null and abs(ret) < 5
          ) r
        )
        select session, count(*) as n, round(sum(x * x), 4) as xx, round(sum(x * y), 4) as xy, round(sum(y * y), 4) as yy
        from d
        group by session""",
    ),
    "distribution_by_year": (
        "A19",
        """with m as (
          select year(session) as y, ret, avg(ret) over (partition by year(session)) as mu, count(ret) over (partition by year(session)) as n
          from returns
          where ret is not null
        ),
        c as (
          select y, max(n) as n, max(mu) as mu, sum((ret - mu) * (ret - mu)) / max(n) as m2, sum((ret - mu) * (ret - mu) * (ret - mu)) / max(n) as m3,
              sum((ret - mu) * (ret - mu) * (ret - mu) * (ret - mu)) / max(n) as m4, avg(case when ret = 0 then 1.0 else 0.0 end) as zero
          from m
          group by y
          having max(n) > 3
        )
        select y, n, round(mu, 6) as mean, round(sqrt(m2 * n / (n - 1)), 6) as sd,
            round(sqrt(cast(n * (n - 1) as double)) / (n - 2) * m3 / power(m2, 1.5), 5) as skew,
            round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6), 5) as kurt, round(zero, 6) as share_zero
        from c""",
    ),
    "quantiles": (
        "A20 A31",
        """select round(@q(ret, 0.025), 8) as q025, round(@q(ret, 0.5), 8) as q50, round(@q(ret, 0.975), 8) as q975
        from returns
        where ret is not null""",
    ),
    "reliability_deciles": (
        "A21",
        """with e as (
          select @q(p, 0.1) as e1, @q(p, 0.2) as e2, @q(p, 0.3) as e3, @q(p, 0.4) as e4, @q(p, 0.5) as e5, @q(p, 0.6) as e6, @q(p, 0.7) as e7,
              @q(p, 0.8) as e8, @q(p, 0.9) as e9
          from preds
        ),
        b as (
          select y, p, (case when p > e1 then 1 else 0 end) + (case when p > e2 and e2 > e1 then 1 else 0 end) + (case when p > e3 and e3 > e2 then 1
              else 0 end) + (case when p > e4 and e4 > e3 then 1 else 0 end) + (case when p > e5 and e5 > e4 then 1 else 0 end) + (case when p > e6
              and e6 > e5 then 1 else 0 end) + (case when p > e7 and e7 > e6 then 1 else 0 end) + (case when p > e8 and e8 > e7 then 1
              else 0 end) + (case when p > e9 and e9 > e8 then 1 else 0 end) as bin
          from preds
          cross join e
        )
        select bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed
        from b
        group by bin""",
    ),
    "tercile_classes": (
        "A22",
        """with e as (
          select @q(ret, 0.3333333333) as lo, @q(ret, 0.6666666667) as hi
          from returns
          where pos < 1000 and ret is not null
        )
        select case when ret <= lo then 'drop' when ret > hi then 'rise' else 'flat' end as class, count(*) as n
        from returns
        cross join e
        where ret is not null
        group by 1""",
    ),
    "tag_precision_recall": (
        "A23 E9",
        """with c as (
          select a1 as truth, a2 as pred, count(*) as n
          from raters
          group by a1, a2
        )
        select l.label, coalesce(sum(n) filter (where truth = l.label and pred = l.label), 0) as tp,
            round(coalesce(sum(n) filter (where truth = l.label and pred = l.label), 0) / cast(nullif(sum(n) filter (where pred = l.label), 0) as double), 6) as prec, round(coalesce(sum(n) filter (where truth = l.label and pred = l.label), 0) / cast(nullif(sum(n) filter (where truth = l.label), 0) as double), 6) as recall
        from levels l
        cross join c
        group by l.label""",
    ),
    "correlations": (
        "A24",
        """with r as (
          select year(session) as y, ret, range_pct,
              rank() over (partition by year(session) order by ret) + (count(*) over (partition by year(session), ret) - 1) / 2.0 as r1,
              rank() over (partition by year(session) order by range_pct) + (count(*) over (partition by year(session), range_pct) - 1) / 2.0 as r2
          from returns
          where ret is not null
        )
        select y, round(corr(ret, range_pct), 6) as pearson, round(corr(r1, r2), 6) as spearman
        from r
        group by y
        having count(*) > 2""",
    ),
    "wilson_interval": (
        "A25",
        """with c as (
          select lang, count(*) as n, sum(quality) as k
          from labels l
          join documents d on l.doc_id = d.doc_id
          group by lang
        ),
        f as (
          select lang, n, k, k / cast(n as double) as p, 1.96 * 1.96 as z2
          from c
        )
        select lang, n, cast(k as bigint) as k, round((p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) as lo,
            round((p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) as hi
        from f""",
    ),
    "chi_square": (
        "A26",
        """with c as (
          select lang, quality, count(*) as o
          from labels l
          join documents d on l.doc_id = d.doc_id
          group by lang, quality
        ),
        e as (
          select o, sum(o) over (partition by lang) * sum(o) over (partition by quality) / cast(sum(o) over () as double) as x
          from c
        )
        select count(*) as cells, round(sum((o - x) * (o - x) / x), 6) as chi2
        from e""",
    ),
    "monthly_returns": (
        "A27",
        """select cast(date_trunc('month', session) as date) as month, round(sum(ret), 6) as total, round(avg(ret), 6) as mean, count(ret) as n
        from returns
        group by 1""",
    ),
    "run_lengths": (
        "A28 W12",
        """with f as (
          select firm, session, close > lag(close) over w as up
          from trades window w as (partition by firm order by session)
        ),
        g as (
          select *, case when up is distinct
          from lag(up) over (partition by firm order by session) then 1 else 0 end as start
          from f
        ),
        s as (
          select *, sum(start) over (partition by firm order by session) as run
          from g
        )
        select firm, cast(run as bigint) as run, bool_or(up) as up, min(session) as first_day, count(*) as len
        from s
        group by firm, run
        having count(*) >= 3""",
    ),
    "majority_label": (
        "A29 G3 E8",
        """with c as (
          select doc_id, label, count(*) as n
          from votes
          group by doc_id, label
        ),
        r as (
          select *, rank() over (partition by doc_id order by n desc) as k
          from c
        ),
        t as (
          select doc_id, min(label) as label, count(*) as ties, max(n) as n
          from r
          where k = 1
          group by doc_id
        )
        select doc_id, case when ties > 1 then '' else label end as label, n = 3 as unanimous
        from t""",
    ),
    "source_pivot": (
        "A14",
        """with d as (
          select a.session, avg(score) filter (where source = 'src1') as s1, avg(score) filter (where source = 'src2') as s2,
              avg(score) filter (where source not in ('src1', 'src2')) as rest, avg(score) as total
          from tagged t
          join strict_asof a on a.day = t.published_date
          where is_canonical
          group by a.session
        )
        select session, round(coalesce(s1, 0.0), 6) as s1, round(coalesce(s2, 0.0), 6) as s2, round(coalesce(rest, 0.0), 6) as without_both,
            round(total, 6) as total
        from d""",
    ),
    "regression_slopes": (
        "A18 F8 W13",
        """with d as (
          select firm, ret - avg(ret) over (partition by firm) as y, cast(age as double) - avg(cast(age as double)) over (partition by firm) as x
          from firm_units
          where ret is not null and abs(ret) < 5
        )
        select count(*) as n, round(sum(x * y) / sum(x * x), 6) as within_slope, round(regr_slope(y, x), 6) as ols_slope
        from d""",
    ),
}
