"""Evaluation and inference.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "autocorrelations": (
        "I6",
        """with d as (
          select ret - avg(ret) over () as d, row_number() over (order by session) as i, count(*) over () as n
          from returns
          where ret is not null
        ),
        v as (
          select sum(d * d) as v, max(n) as n
          from d
        ),
        a as (
          select k, sum(a.d * b.d) as c
          from d a
          cross join (
            select @range(1, 10) as k
          ) ks
          join d b on b.i = a.i - k
          group by k
        )
        select k, round(c / v, 6) as acf, round(n * (n + 2) * sum(c * c / (v * v) / (n - k)) over (order by k), 4) as ljung_box
        from a
        cross join v""",
    ),
    "cohen_kappa": (
        "E6",
        """with t as (
          select x.lv as i, y.lv as j, count(*) as n
          from raters r
          join levels x on r.a1 = x.label
          join levels y on r.a2 = y.label
          group by x.lv, y.lv
        ),
        g as (
          select a.lv as i, b.lv as j, coalesce(t.n, 0) as n
          from levels a
          cross join levels b
          left join t on t.i = a.lv and t.j = b.lv
        ),
        m as (
          select i, j, n, sum(n) over (partition by i) as ri, sum(n) over (partition by j) as cj, sum(n) over () as s
          from g
        ),
        e as (
          select i, j, n, ri * cj / cast(s as double) as x
          from m
        )
        select round(1 - sum(case when i <> j then n else 0 end) / sum(case when i <> j then x else 0.0 end), 6) as nominal,
            round(1 - sum(abs(i - j) * n) / sum(abs(i - j) * x), 6) as linear,
            round(1 - sum((i - j) * (i - j) * n) / sum((i - j) * (i - j) * x), 6) as quadratic
        from e""",
    ),
    "fleiss_kappa": (
        "E7",
        """with c as (
          select doc_id, label, count(*) as n
          from votes
          group by doc_id, label
        ),
        i as (
          select doc_id, (sum(n * n) - 3) / 6.0 as p
          from c
          group by doc_id
        ),
        q as (
          select sum(n) / (
            select 3.0 * count(*)
            from raters
          ) as share
          from c
          group by label
        ),
        b as (
          select avg(p) as pbar
          from i
        ),
        x as (
          select sum(share * share) as pe
          from q
        )
        select round((pbar - pe) / (1 - pe), 6) as kappa, case when (pbar - pe) / (1 - pe) > 0.8 then 'almost perfect'
            when (pbar - pe) / (1 - pe) > 0.6 then 'substantial' when (pbar - pe) / (1 - pe) > 0.4 then 'moderate' when (pbar - pe) / (1 - pe) > 0.2
            then 'fair' when (pbar - pe) / (1 - pe) > 0 then 'slight' else 'poor' end as word
        from b
        cross join x""",
    ),
    "binary_metrics": (
        "E1 E4 E5 E10 E11 M9",
        """with c as (
          select count(*) as n, sum(y) as pos, count(*) filter (where p > 0.5 and y = 1) as tp, count(*) filter (where p > 0.5 and y = 0) as fp,
              count(*) filter (where p <= 0.5 and y = 1) as fn, count(*) filter (where p <= 0.5 and y = 0) as tn, avg((p - y) * (p - y)) as brier,
              avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss
          from preds
        )
        select n, round((tp + tn) / cast(n as double), 6) as accuracy, round(greatest(pos, n - pos) / cast(n as double), 6) as constant_accuracy,
            round((tp / cast(tp + fn as double) + tn / cast(tn + fp as double)) / 2, 6) as balanced,
            round((cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc,
            round(brier, 6) as brier, round(log_loss, 6) as log_loss, round(tp / cast(tp + fp as double), 6) as prec,
            round(tp / cast(tp + fn as double), 6) as recall, round((tp + fp) / cast(n as double), 6) as alarm_rate
        from c""",
    ),
    "roc_auc": (
        "E2",
        """select round((sum(case when y = 1 then avg_rank else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (cast(sum(y) as double) * (count(*) - sum(y))), 8) as auc
        from ranked""",
    ),
    "average_precision": (
        "E3",
        """with g as (
          select p, sum(y) as tp, count(*) as n
          from preds
          group by p
        ),
        c as (
          select p, tp, sum(tp) over (order by p desc) as ctp, sum(n) over (order by p desc) as cn, sum(tp) over () as total
          from g
        )
        select round(sum(tp / cast(total as double) * (ctp / cast(cn as double))), 8) as ap
        from c""",
    ),
    "holm": (
        "I9",
        """with v as (
          select id, p, i, band, least(1.0, (m - i + 1) * p) as v
          from ordered_p
        ),
        g as (
          select band, coalesce(max(v) over (order by band rows between unbounded preceding and 1 preceding), 0.0) as before
          from (
            select band, max(v) as v
            from v
            group by band
          ) x
        )
        select v.id, round(greatest(g.before, max(v.v) over (partition by v.band order by v.i rows between unbounded preceding and current row)), 6) as adjusted
        from v
        join g on g.band = v.band""",
    ),
    "benjamini_hochberg": (
        "I10",
        """select o.id, o.i <= b.last as selected
        from ordered_p o
        cross join (
          select coalesce(max(i), 0) as last
          from ordered_p
          where p <= 0.1 * i / m
        ) b""",
    ),
    "diebold_mariano": (
        "I6 I17",
        """with l as (
          select i, ret * ret - 0.9 * ret * ret - 0.0001 as d, count(*) over () as n
          from losses
        ),
        m as (
          select avg(d) as mu, max(n) as n
          from l
        ),
        z as (
          select i, d - mu as e, m.n
          from l
          cross join m
        ),
        g0 as (
          select sum(e * e) / max(n) as g
          from z
        ),
        gk as (
          select k, sum(a.e * b.e) / max(a.n) as g
          from z a
          cross join (
            select @range(1, 5) as k
          ) ks
          join z b on b.i = a.i - k
          group by k
        ),
        v as (
          select (
            select g
            from g0
          ) + sum(2 * (1 - k / 6.0) * g) as v
          from gk
        )
        select m.n, round(m.mu, 8) as mean_diff, round(sqrt(v.v / m.n), 8) as se, round(m.mu / sqrt(v.v / m.n), 4) as dm
        from m
        cross join v""",
    ),
    "clark_west": (
        "I7",
        """with f as (
          select ret, 0.0 as f0, 0.1 * lag(ret) over (order by session) as f1
          from returns
          where ret is not null
        ),
        c as (
          select (ret - f0) * (ret - f0) - ((ret - f1) * (ret - f1) - (f0 - f1) * (f0 - f1)) as c
          from f
          where f1 is not null
        )
        select count(*) as n, round(avg(c), 10) as cw, round(avg(c) / (stddev_samp(c) / sqrt(cast(count(*) as double))), 5) as t
        from c""",
    ),
    "mcnemar_counts": (
        "I8",
        """select count(*) filter (where (p > 0.5) = (y = 1) and (doc_id % 3 > 0) <> (y = 1)) as only_first, count(*) filter (where (p > 0.5) <> (y = 1)
    and (doc_id % 3 > 0) = (y = 1)) as only_second, count(*) as n
        from preds""",
    ),
    "qlike_losses": (
        "I17",
        """select session, round(v / f - ln(v / f) - 1, 6) as qlike
        from (
          select session, ret * ret + 0.0001 as v, avg(ret * ret) over (order by session rows between 20 preceding and 1 preceding) + 0.0001 as f
          from returns
        ) x
        where f is not null and v is not null""",
    ),
    "verdicts": (
        "I18",
        """with e as (
          select id, p, (id % 21 - 10) / 10.0 as effect, (id % 21 - 10) / 10.0 - 0.3 as lo, (id % 21 - 10) / 10.0 + 0.3 as hi
          from pvalues
        )
        select id, case when lo > -0.5 and hi < 0.5 then 'inside' when p < 0.05 and lo > 0 then 'positive' when p < 0.05 and hi < 0 then 'negative'
            else 'inconclusive' end as verdict
        from e""",
    ),
    "detectable_effect": (
        "I19 I22 M11",
        """with c as (
          select count(*) filter (where y <> case when p > 0.5 then 1 else 0 end) as discordant, count(*) as n,
              stddev_samp(p) / sqrt(cast(count(*) as double)) as se
          from preds
        )
        select n, round(2.8 * se, 8) as mde, round(2.8 * se * sqrt(n / (2.0 * n)), 8) as mde_doubled,
            round((1.96 + 0.84) * sqrt(cast(discordant as double)) / n, 8) as sign_mde, 2.8 * se <= 0.05 as go
        from c""",
    ),
    "selection_jaccard": (
        "I21 U6",
        """with t as (
          select distinct year(published_date) as y, @each(@split(template_key, ' ')) as token
          from keyed
        ),
        p as (
          select a.y as y1, b.y as y2, count(*) as both_n
          from t a
          join t b on a.token = b.token and a.y < b.y
          group by a.y, b.y
        ),
        n as (
          select y, count(*) as n
          from t
          group by y
        )
        select p.y1, p.y2, round(both_n / cast(n1.n + n2.n - both_n as double), 6) as jaccard
        from p
        join n n1 on p.y1 = n1.y
        join n n2 on p.y2 = n2.y""",
    ),
    "episodes_and_lead_time": (
        "E12 W12",
        """with a as (
          select firm, session, age, close, close < 0.3 * max(close) over (partition by firm order by session rows between 9 preceding
              and current row) as event, close < 0.6 * max(close) over (partition by firm order by session rows between 9 preceding
              and current row) as alarm
          from firm_units
        ),
        s as (
          select *, sum(case when event and not coalesce(prev, false) then 1 else 0 end) over (partition by firm order by session) as ep
          from (
            select *, lag(event) over (partition by firm order by session) as prev
            from a
          ) x
        ),
        e as (
          select firm, ep, min(age) as start
          from s
          where event
          group by firm, ep
        )
        select e.firm, cast(e.ep as bigint) as episode, e.start, max(e.start - s.age) as lead_time
        from e
        left join s on s.firm = e.firm and s.alarm and s.age between e.start - 5 and e.start
        group by e.firm, e.ep, e.start""",
    ),
    "rater_agreement": (
        "E8",
        """select round(avg(case when a1 = a2 then 1.0 else 0.0 end), 6) as raw_agreement,
    round(avg(case when a1 = a2 and a2 = a3 then 1.0 else 0.0 end), 6) as unanimous, count(*) filter (where a1 <> a2 and a2 <> a3
    and a1 <> a3) as ties
        from raters""",
    ),
}
