"""Common tables that the queries are written over.

Stand-ins: headlines are the first lines of documents with a derived date,
bars are lineitem by ship date, a second calendar is orders, firms are
suppliers, trades and timed news are events, raters are labels with a derived
third rater.
"""

from __future__ import annotations

from .dialect import part

part(
    "headlines",
    """select doc_id, concat(source, '::', cast(doc_id as @str)) as row_id, source, lang, split_part(text, chr(10), 1) as headline,
    @plus(date '1996-01-01', (doc_id * 7) % 1800) as published_date, length(split_part(text, chr(10), 1)) >= 8 as date_parse_ok
    from documents""",
)
part(
    "windows",
    """select source, @plus(date '1996-01-01', cast(substring(source, 4) as int) * 10) as first_day,
    @plus(date '2000-06-01', cast(substring(source, 4) as int)) as last_day
    from (
      select distinct source
      from documents
      where source is not null
    ) s""",
)
part(
    "keyed",
    r"""select *, trim(@replace_all(@replace_all(@replace_all(@replace_all(@replace_all(@replace_all(lower(concat(headline, ' ', cast(doc_id % 7 as @str), ',', cast(doc_id % 10 as @str), '%')), @r'[+][0-9]+([.,][0-9]+)*%?', 'up#'), @r'[-−][0-9]+([.,][0-9]+)*%?', 'dn#'), @r'[0-9]+([.,][0-9]+)*%?', '#'), '_', ' '), @r'[^\p{L}\p{N}#@]+', ' '), ' +', ' ')) as template_key
    from headlines""",
)
part(
    "clustered",
    """select *, sha1(template_key) as dup_cluster_id, count(*) over (partition by template_key) as cluster_size,
    row_number() over (partition by template_key order by case when source = 'src0' then 0 else 1 end, published_date, row_id) = 1 as is_canonical
    from keyed""",
)
part(
    "tagged",
    """select *, case when @like(concat(' ', lower(headline), ' '), '[^a-z](tion|on the|und|les)[^a-z]') then 'home'
    when @like(lower(headline), '(ción|aux|ung)') then 'linked' else 'other' end as relevance_tag, (doc_id % 5) - 2 as score,
    @like(lower(headline), 'the') and @like(lower(headline), 'of') as is_price_report
    from clustered""",
)
part(
    "prices",
    """select cast(l_shipdate as date) as session, l_suppkey as firm, cast(floor(l_extendedprice / l_quantity * 100) as bigint) as cents,
    l_quantity as volume
    from lineitem
    where l_quantity > 0""",
)
part(
    "bars",
    """select session, cast(sum(cents) as bigint) / (100.0 * count(*)) as close, max(cents) / 100.0 as high, min(cents) / 100.0 as low,
    sum(volume) as volume, row_number() over (order by session) - 1 as pos
    from prices
    group by session""",
)
part(
    "returns",
    """select *, close / lag(close) over w - 1 as ret, ln(close) - ln(lag(close) over w) as log_ret, (high - low) / close as range_pct,
    ln(greatest(high / low, 1.0001)) as log_range, ln(1 + volume) as log_volume
    from bars window w as (order by session)""",
)
part(
    "firm_bars",
    """select firm, session, cast(sum(cents) as bigint) / (100.0 * count(*)) as close, sum(volume) as volume
    from prices
    group by firm, session""",
)
part(
    "days",
    """select distinct published_date as day
    from headlines
    where date_parse_ok""",
)
part(
    "strict_asof",
    """select day, case when kind = 0 then nxt end as session
    from (
      select day, kind, min(session) over (order by epoch range between 1 following and unbounded following) as nxt
      from (
        select day, cast(null as date) as session, 0 as kind, @days(day, date '1970-01-01') as epoch
        from days
        union all
        select session as day, session, 1 as kind, @days(session, date '1970-01-01') as epoch
        from bars
      ) u
    ) v
    where kind = 0""",
)
part(
    "news_by_session",
    """select a.session, count(*) as n_headlines, count(distinct t.source) as n_sources, count(*) filter (where relevance_tag = 'home') as n_home,
    count(*) filter (where relevance_tag = 'linked') as n_linked, count(*) filter (where is_price_report) as n_price_reports, avg(score) as sent_mean,
    avg(case when score > 0 then 1.0 else 0.0 end) as pos_share, avg(case when score < 0 then 1.0 else 0.0 end) as neg_share,
    avg(score) filter (where not is_price_report) as sent_mean_ex_price, avg(score) filter (where is_price_report) as sent_mean_price_only
    from tagged t
    join strict_asof a on a.day = t.published_date
    where is_canonical and date_parse_ok and a.session is not null
    group by a.session""",
)
part(
    "trades",
    """select user_id as firm, cast(ts as date) as session, max_by(value, event_id) as close, max(value) as high, min(value) as low, count(*) as n
    from events
    where event_type in ('purchase', 'view')
    group by user_id, cast(ts as date)""",
)
part(
    "news",
    """select user_id as firm, ts, cast(ts as date) as day, @minutes(ts) as minute, event_id
    from events
    where event_type in ('error', 'signup')""",
)
part(
    "firm_asof",
    """select firm, day, case when kind = 0 then nxt end as trade
    from (
      select firm, day, kind, min(session) over (partition by firm order by epoch range between current row and unbounded following) as nxt
      from (
        select distinct firm, day, cast(null as date) as session, 0 as kind, @days(day, date '1970-01-01') as epoch
        from news
        union all
        select firm, session, session, 1, @days(session, date '1970-01-01')
        from trades
      ) u
    ) v
    where kind = 0""",
)
part(
    "firm_units",
    """select firm, session, close, close / nullif(lag(close) over w, 0) - 1 as ret, lag(session) over w as prev_session,
    lead(session) over w as next_session, row_number() over w - 1 as age
    from trades window w as (partition by firm order by session)""",
)
part(
    "firm_news",  # each headline is one firm's, and counts on the first session after its day
    """select f.firm, a.session, cast(sum(t.score) as double) as tone_sum, count(*) as n
    from tagged t
    join strict_asof a on a.day = t.published_date
    join (
      select firm, row_number() over (order by firm) - 1 as i, count(*) over () as firms
      from (select distinct firm from firm_bars) d
    ) f on f.i = t.doc_id % f.firms
    where t.date_parse_ok and a.session is not null
    group by f.firm, a.session""",
)
part(
    "calendar_closes",  # every session from a firm's first trade on, with its last close
    """select firm, session, pos, max(close) over (partition by firm, run) as close
    from (
      select s.firm, b.session, b.pos, f.close, count(f.close) over (partition by s.firm order by b.session) as run
      from (select firm, min(session) as first_session from firm_bars group by firm) s
      cross join bars b
      left join firm_bars f on f.firm = s.firm and f.session = b.session
      where b.session >= s.first_session
    ) g""",
)
part(
    "drawdown",  # an event: one of the next 20 closes is over 70 % below this one (stand-in closes are means of a few orders); the last 20 sessions tell nothing
    """select c.firm, c.session, c.pos, age, c.close, lag0, lag1, lag2, rv20, dd60, market_lag0, market_rv20,
    case when ahead = 20 then case when lowest / c.close - 1 < -0.7 then 1.0 else 0.0 end end as event,
    case when news20 > 0 then tone_sum20 / news20 else 0.0 end as firm_tone20, case when news20 > 0 then 1.0 else 0.0 end as has_firm_news20, coalesce(tone, 0.0) as tone
    from (
      select r.*, ret as lag0, lag(ret) over w as lag1, lag(ret, 2) over w as lag2, row_number() over w - 1 as age,
      case when count(ret) over w20 = 20 then stddev_samp(ret) over w20 end as rv20, case when count(*) over w60 >= 20 then close / max(close) over w60 - 1 end as dd60,
      count(*) over f20 as ahead, min(close) over f20 as lowest, coalesce(sum(tone_sum) over w20, 0.0) as tone_sum20, coalesce(sum(n) over w20, 0) as news20
      from (
        select k.*, k.close / lag(k.close) over (partition by k.firm order by k.session) - 1 as ret, n.tone_sum, n.n
        from calendar_closes k
        left join firm_news n on n.firm = k.firm and n.session = k.session
      ) r window w as (partition by firm order by session), w20 as (partition by firm order by session rows between 19 preceding and current row),
        w60 as (partition by firm order by session rows between 59 preceding and current row), f20 as (partition by firm order by session rows between 1 following and 20 following)
    ) c
    join (
      select session, ret as market_lag0, case when count(ret) over m20 = 20 then stddev_samp(ret) over m20 end as market_rv20
      from returns window m20 as (order by session rows between 19 preceding and current row)
    ) m on m.session = c.session
    left join (select session, sum(tone_sum) / sum(n) as tone from firm_news group by session) t on t.session = c.session
    where age >= 40""",
)
part(
    "preds",
    """select doc_id, case when quality = 1 and (doc_id % 11) > 2 then 1 else 0 end as y,
    least(0.98, greatest(0.02, 0.5 * quality + 0.03 * (doc_id % 13))) as p
    from labels""",
)
part(
    "ranked",  # equal scores are counted first, so the running sum is over distinct scores
    """select d.*, r.avg_rank
    from preds d
    join (
      select p, coalesce(sum(n) over (order by p rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as avg_rank
      from (
        select p, count(*) as n
        from preds
        group by p
      ) g
    ) r on r.p = d.p""",
)
part(
    "raters",
    """select doc_id, case when quality = 1 then 'pos' else 'neg' end as a1, case when toxic = 1 then 'neg' when doc_id % 6 = 0 then 'neu'
    else 'pos' end as a2, case when doc_id % 4 = 0 then 'neg' when doc_id % 9 = 0 then 'neu' else 'pos' end as a3
    from labels""",
)
part(
    "votes",
    """select doc_id, a1 as label
    from raters
    union all
    select doc_id, a2
    from raters
    union all
    select doc_id, a3
    from raters""",
)
part(
    "levels",
    """select 'neg' as label, 0 as lv
    union all
    select 'neu', 1
    union all
    select 'pos', 2""",
)
part(
    "pvalues",
    """select doc_id as id, (doc_id * 37 % 1000 + 1) / 2000.0 * ((doc_id % 3) + 1) / 3.0 as p
    from labels""",
)
part(
    "losses",
    """select row_number() over (order by session) as i, ret * ret as d, ret
    from returns
    where ret is not null""",
)
part(
    "ordered_p",  # p-values numbered in order: within bands of p, after the counts of the bands before
    """select x.id, x.p, x.band, g.m, g.before + row_number() over (partition by x.band order by x.p, x.id) as i
    from (
      select id, p, cast(floor(p * 400) as int) as band
      from pvalues
    ) x
    join (
      select band, coalesce(sum(n) over (order by band rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as m
      from (
        select cast(floor(p * 400) as int) as band, count(*) as n
        from pvalues
        group by cast(floor(p * 400) as int)
      ) y
    ) g on g.band = x.band""",
)
