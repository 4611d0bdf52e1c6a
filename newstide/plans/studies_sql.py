"""Queries of whole studies: screens, novelty, grids, scans and checks, one text for both engines.

Stand-ins beside those of ``relational.py``: an issuer dictionary of frequent
words, bars with an open, and pages whose dates take the forms that scraped
sites use.
"""

from __future__ import annotations

from .dialect import part

#: Months as French pages write them.
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")

part(
    "headline_tokens",
    """select b.session, b.pos, k.doc_id, t.w, t.i from (
        select doc_id, published_date, @words_at(@split(template_key, ' ')) as t from keyed where template_key <> '' and date_parse_ok
    ) k join strict_asof a on a.day = k.published_date join bars b on b.session = a.session""",
)
part(
    "issuers",
    """select concat('T', cast(row_number() over (order by n desc, w) as @str)) as ticker, w as name from (
        select w, count(*) as n, row_number() over (order by count(*) desc, w) as r from (
            select distinct doc_id, w from (select doc_id, @each(@split(template_key, ' ')) as w from keyed) x
        ) y where length(w) >= 4 and w not in ('with', 'that', 'this', 'pour', 'dans', 'avec', 'para', 'nicht', 'eine') group by w
    ) z where r <= 25""",
)
part(
    "ohlc",
    """select cast(l_shipdate as date) as session, l_suppkey as firm,
        min_by(floor(l_extendedprice / l_quantity * 100), l_orderkey * 10 + l_linenumber) / 100.0 as open,
        max_by(floor(l_extendedprice / l_quantity * 100), l_orderkey * 10 + l_linenumber) / 100.0 as close,
        max(floor(l_extendedprice / l_quantity * 100)) / 100.0 as high, min(floor(l_extendedprice / l_quantity * 100)) / 100.0 as low,
        sum(l_quantity) as volume, count(*) as trades
    from lineitem where l_quantity > 0 group by cast(l_shipdate as date), l_suppkey""",
)
part(
    "dated_pages",
    """select page_id, case when page_id % 6 = 0 then concat(url, '/2019/03/07/') else url end as url,
        case page_id % 6 when 1 then '<time datetime="2020-11-30T08:00">hier</time>' when 2 then 'Publié le 2018-02-09 à Tunis' when 3 then 'le 05/12/2017'
            when 4 then concat('le ', cast(1 + page_id % 28 as @str), ' ', case when page_id % 4 = 0 then 'février' else 'août' end, ' 2016') else 'sans date' end as html
    from pages""",
)
part("judged", "select doc_id, case when quality = 1 then 'good' else 'bad' end as label from labels")
part(
    "scored_sources",
    """select t.source, a.session, avg(t.score) as score, count(*) as n, count(*) filter (where t.score <> 0) as non_neutral
    from tagged t join strict_asof a on a.day = t.published_date where t.date_parse_ok and a.session is not null and t.source is not null group by t.source, a.session""",
)

#: name: (survey ids, body)
SQL: dict[str, tuple[str, str]] = {
    # interpolated bigram over the 250 sessions before, add-one unigram, own session never in it
    "bigram_novelty": (
        "F17",
        """with seq as (select doc_id, pos, w, coalesce(lag(w) over (partition by doc_id, pos order by i), '<s>') as prev from headline_tokens),
    u as (select pos, w, count(*) as n from seq group by pos, w),
    uw as (select pos, w, coalesce(sum(n) over (partition by w order by pos range between 250 preceding and 1 preceding), 0) as c, lead(pos) over (partition by w order by pos) as nxt from u),
    bw as (select pos, prev, w, coalesce(sum(n) over (partition by prev, w order by pos range between 250 preceding and 1 preceding), 0) as c from (select pos, prev, w, count(*) as n from seq group by pos, prev, w) x),
    cw as (select pos, prev, coalesce(sum(n) over (partition by prev order by pos range between 250 preceding and 1 preceding), 0) as c from (select pos, prev, count(*) as n from seq group by pos, prev) x),
    tw as (select pos, coalesce(sum(n) over (order by pos range between 250 preceding and 1 preceding), 0) as c from (select pos, sum(n) as n from u group by pos) x),
    ev as (select pos + 1 as p, 1 as d from uw union all select least(pos + 250, coalesce(nxt, pos + 250)) + 1 as p, -1 as d from uw union all select pos as p, 0 as d from tw),
    vs as (select p, sum(d) over (order by p) as v from (select p, sum(d) as d from ev group by p) x),
    g as (select s.doc_id, s.pos, tw.c as total, case when cw.c > 0 then 0.5 * bw.c / cw.c + 0.5 * (uw.c + 1.0) / (tw.c + vs.v + 1) else (uw.c + 1.0) / (tw.c + vs.v + 1) end as p
        from seq s join uw on uw.pos = s.pos and uw.w = s.w join bw on bw.pos = s.pos and bw.prev = s.prev and bw.w = s.w join cw on cw.pos = s.pos and cw.prev = s.prev join tw on tw.pos = s.pos join vs on vs.p = s.pos)
    select doc_id, cast(pos as bigint) as pos, count(*) as n_tokens, case when max(total) > 0 then round(avg(-log2(p)), 6) end as bits from g group by doc_id, pos""",
    ),
    # words of 30 events and 6 quarters, exact binomial of their share of big events, false discoveries at 10 %
    "word_screen": (
        "F21 I10",
        """with e as (select k.doc_id, case k.doc_id % 3 when 0 then 1 when 1 then 0 end as big, year(published_date) * 4 + cast(floor((month(published_date) - 1) / 3) as int) as q, k.template_key from keyed k),
    t as (select distinct doc_id, big, q, @each(@split(template_key, ' ')) as token from e),
    b as (select avg(cast(big as double)) as base from e),
    w as (select token, count(*) as events, count(distinct q) as quarters, count(big) as n, cast(sum(big) as bigint) as k from t group by token having count(*) >= 30 and count(distinct q) >= 6 and count(big) > 0),
    nk as (select n, k, base, @lf(n) - @lf(k) - @lf((n - k)) + k * ln(base) + (n - k) * ln(1 - base) as at_k from (select distinct n, k from w) d cross join b),
    o as (select n, k, base, at_k, @range(0, n) as i from nk),
    p as (select n, k, least(1.0, sum(exp(lp))) as p from (select n, k, at_k, @lf(n) - @lf(i) - @lf((n - i)) + i * ln(base) + (n - i) * ln(1 - base) as lp from o) x where lp <= at_k + 0.0000001 group by n, k),
    r as (select w.*, p.p from w join p on p.n = w.n and p.k = w.k),
    c as (select p, sum(n) over (order by p) as up_to from (select p, count(*) as n from r where p <= 0.1 group by p) x),
    s as (select r.*, b.base, z.bar from r cross join b cross join (select max(case when c.p <= 0.1 * c.up_to / m.m then c.p end) as bar from c cross join (select count(*) as m from w) m) z)
    select token, events, quarters, n, k, round(p, 8) as p, case when p <= bar and cast(k as double) / n > base then 'big' when p <= bar and cast(k as double) / n < base then 'small' else 'no' end as chosen from s""",
    ),
    # The within-firm slope refitted without each firm, its sums taken off the totals
    "leave_one_firm_out": (
        "I20",
        """with d as (select firm, ret - avg(ret) over (partition by firm) as y, cast(age as double) - avg(cast(age as double)) over (partition by firm) as x from firm_units where ret is not null and abs(ret) < 5),
    s as (select firm, sum(x * x) as xx, sum(x * y) as xy from d group by firm),
    o as (select firm, (sum(xy) over () - xy) / nullif(sum(xx) over () - xx, 0) as slope from s)
    select firm, round(slope, 8) as slope_without, round(slope, 8) = round(min(slope) over (), 8) as is_min, round(slope, 8) = round(max(slope) over (), 8) as is_max from o""",
    ),
    # The checks of a price file
    "price_checks": (
        "P19",
        """with b as (select *, lag(close) over (partition by firm order by session) as prev from ohlc),
    cal as (select min(session) as lo, max(session) as hi, count(distinct session) as n from b),
    wd as (select count(*) as weekdays, count(*) filter (where b.session is null) as absent from (select @days_range(lo, hi) as day from cal) d left join (select distinct session from b) b on b.session = d.day where @wd(d.day) < 5),
    dup as (select coalesce(sum(n - 1), 0) as duplicates from (select session, count(*) as n from b group by session) x)
    select count(*) as n_rows, min(b.session) as first_session, max(b.session) as last_session, count(*) filter (where b.session is null) as bad_dates,
        cast(max(dup.duplicates) as bigint) as duplicate_sessions, max(wd.weekdays) as weekdays, max(wd.absent) as absent_weekdays, round(max(wd.absent) / cast(max(wd.weekdays) as double), 6) as absent_share,
        count(*) filter (where high < low) as high_below_low, count(*) filter (where close > high or close < low) as close_outside, count(*) filter (where open > high or open < low) as open_outside,
        count(*) filter (where close <= 0) as nonpositive_close, count(*) filter (where volume = 0) as zero_volume, count(*) filter (where close = prev) as stale_close,
        count(*) filter (where open is null) + count(*) filter (where high is null) + count(*) filter (where low is null) + count(*) filter (where close is null) + count(*) filter (where volume is null) as null_cells
    from b cross join wd cross join dup""",
    ),
    # Moments and first autocorrelations, of values and of ranks within the window
    "rolling_moments": (
        "W15 A24",
        """with x as (select session, ret, lag(ret) over (order by session) as prev, row_number() over (order by session) as i from returns),
    v as (select *, i - 1 as t from x where ret is not null and prev is not null),
    w as (select session, t, count(*) over f as n, avg(ret) over f as mean, stddev_samp(ret) over f as sd, corr(ret, prev) over f as pearson from v window f as (order by t rows between 249 preceding and current row)),
    pairs as (select a.t, b.ret, b.prev from (select t, t - o as u from (select t, @range(0, 249) as o from v) x) a join v b on b.t = a.u),
    r as (select t, rank() over (partition by t order by ret) + (count(*) over (partition by t, ret) - 1) / 2.0 as r1, rank() over (partition by t order by prev) + (count(*) over (partition by t, prev) - 1) / 2.0 as r2 from pairs),
    s as (select t, count(*) as n, corr(r1, r2) as spearman from r group by t)
    select w.session, case when w.n = 250 then round(mean, 8) end as mean250, case when w.n = 250 then round(sd, 8) end as sd250, case when w.n = 250 then round(pearson, 6) end as acf1, case when s.n = 250 then round(spearman, 6) end as rank_acf1
    from w left join s on s.t = w.t""",
    ),
    # A dictionary of names, and every headline that holds one between word borders
    "issuer_matches": ("S10 J13 P8", "select h.row_id, d.ticker from headlines h join issuers d on @like(concat(' ', lower(h.headline), ' '), concat('[^a-zà-ÿ0-9]', d.name, '[^a-zà-ÿ0-9]'))"),
    # All names masked by one alternation, the longest first
    "issuer_masking": (
        "T12",
        """with p as (select concat(' (', @join(@strings(name), '|'), ') ') as pattern from issuers)
    select k.doc_id, trim(@replace_all(@replace_all(replace(concat(' ', k.template_key, ' '), ' ', '  '), p.pattern, ' issuer '), ' +', ' ')) as masked from keyed k cross join p""",
    ),
    # A looped or truncated translation; T15: the digits of the source, ordinals dropped, all in the target
    "translation_checks": (
        "T14 T15",
        """with c as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply from conversations),
    w as (select conv_id, turn, concat(text, case when turn % 3 = 0 then ' | 1er 25,3' else ' 7000' end) as source, concat(reply, ' 7,000 25.3', case when turn % 4 = 0 then ' et de la et de la et de la' else '' end) as target from c where reply is not null),
    t as (select conv_id, turn, @words_at(@split(trim(@replace_all(lower(target), '[^a-zà-ÿ0-9_]+', ' ')), ' ')) as t from w),
    g as (select conv_id, turn, concat(t.w, ' ', lead(t.w) over s, ' ', lead(t.w, 2) over s) as gram, lead(t.w, 2) over s as third from t window s as (partition by conv_id, turn order by t.i)),
    most as (select conv_id, turn, max(n) as n from (select conv_id, turn, gram, count(*) as n from g where third is not null group by conv_id, turn, gram) x group by conv_id, turn),
    d as (select conv_id, turn, source, target, @replace_all(source, '[0-9]+(er|ère|e|ème|éme|eme|nd|nde)', '') as bare from w)
    select d.conv_id, d.turn, coalesce(m.n, 0) >= 3 or length(target) > 2 * length(source) or (position('|' in source) > 0 and length(target) < 0.6 * length(source)) as suspicious, """
        + " and ".join(f"@rcount(bare, '{x}') <= @rcount(target, '{x}')" for x in "0123456789")
        + """ as numbers_kept from d left join most m on m.conv_id = d.conv_id and m.turn = d.turn""",
    ),
    # URL, then time element, then the text's ISO, day/month/year and French dates; S16: path with query, trailing id
    "page_dates": (
        "S15 S16",
        """with x as (select page_id, url, html, @rx(url, '([0-9]{4}/[0-9]{2}/[0-9]{2})', 1) as u, @rx(html, 'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as t, @rx(html, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as iso,
        @rx(html, '([0-9]{2})/([0-9]{2})/([0-9]{4})', 1) as d, @rx(html, '([0-9]{2})/([0-9]{2})/([0-9]{4})', 2) as m, @rx(html, '([0-9]{2})/([0-9]{2})/([0-9]{4})', 3) as y,
        @rx(html, '([0-9]{1,2}) ([a-zûé]+) ([0-9]{4})', 1) as fd, @rx(html, '([0-9]{1,2}) ([a-zûé]+) ([0-9]{4})', 2) as fm, @rx(html, '([0-9]{1,2}) ([a-zûé]+) ([0-9]{4})', 3) as fy from dated_pages)
    select page_id, coalesce(@date(nullif(replace(u, '/', '-'), '')), @date(nullif(t, '')), @date(nullif(iso, '')), @date(nullif(concat(y, '-', m, '-', d), '--')), @date(concat(fy, '-', case fm """
        + " ".join(f"when '{m}' then '{i:02d}'" for i, m in enumerate(FRENCH_MONTHS, 1))
        + """ end, '-', lpad(fd, 2, '0')))) as day, @rx(url, '://[^/?#]+([^#]*)', 1) as href, coalesce(nullif(@rx(concat(url, '_', cast(page_id as @str)), '_([0-9]+)$', 1), ''), @rx(url, ',([0-9]+),', 1)) as article_id from x""",
    ),
    # All sources, one after the other, in one shape
    "all_sources": (
        "S2 U1",
        """select 'documents' as origin, concat('documents::', cast(doc_id as @str)) as row_id, headline as text from headlines
    union all select 'pages' as origin, concat('pages::', cast(page_id as @str)) as row_id, @rx(html, '<title>([^<]*)</title>', 1) as text from pages
    union all select 'conversations' as origin, concat('conversations::', cast(conv_id as @str), '.', cast(turn as @str)) as row_id, split_part(text, chr(10), 1) as text from conversations
    union all select 'benchmark' as origin, concat('benchmark::', cast(item_id as @str)) as row_id, split_part(text, chr(10), 1) as text from benchmark""",
    ),
    # Scans that read the columns they need
    "firm_ohlcv": ("S5 S6", "select firm, session, open, high, low, close, volume from ohlc"),
    # A label file's lines, split at their first two commas alone
    "label_lines": (
        "S12",
        """with l as (select doc_id, concat(cast(doc_id as @str), ', ', case when doc_id % 2 = 0 then 'positive' else 'negative' end, ',', headline) as line from headlines)
    select doc_id, trim(@rx(line, '^([^,]*),', 1)) as item, trim(@rx(line, '^[^,]*,([^,]*),', 1)) as label, trim(@rx(line, '^[^,]*,[^,]*,(.*)$', 1)) as reason from l""",
    ),
    # U4: sets that must not meet, and whether they do
    "empty_intersections": (
        "U4 G5",
        """with s as (select doc_id, case when doc_id % 20 < 3 then 'eval' when doc_id % 20 < 6 then 'val' else 'train' end as fold from headlines),
    e as (select 'eval and train' as pair, count(*) as common from (select doc_id from s where fold = 'eval' intersect select doc_id from s where fold = 'train') x
        union all select 'val and train', count(*) from (select doc_id from s where fold = 'val' intersect select doc_id from s where fold = 'train') x
        union all select 'labelled and eval', count(*) from (select doc_id from labels intersect select doc_id from s where fold = 'eval') x)
    select pair, common, common = 0 as disjoint from e""",
    ),
    # Sources with too few sessions, or too few that aren't neutral, are reported and not tested
    "coverage_gate": (
        "P17",
        """select source, count(*) as sessions, round(sum(non_neutral) / cast(sum(n) as double), 6) as non_neutral_share,
        case when count(*) < 100 then 'too few sessions' when sum(non_neutral) < 0.1 * sum(n) then 'too neutral' else 'tested' end as reading from scored_sources group by source""",
    ),
    # Strict JSON, else the first object in the reply, else a pattern; label and reason must be valid
    "reply_labels": (
        "T17",
        """with r as (select conv_id, turn, case turn % 4 when 0 then '{"label": "positive", "reason": "ok"}' when 1 then 'Sure: {"label": "negative", "reason": "bad day"} done' when 2 then 'label: neutral, reason: "no news"' else 'label: odd' end as reply from conversations),
    p as (select conv_id, turn, @rx(reply, '"?label"?: *"?([a-z]+)', 1) as label, @rx(reply, '"?reason"?: *"([^"]+)"', 1) as reason from r)
    select conv_id, turn, case when label in ('positive', 'negative', 'neutral') and reason <> '' then label end as label, case when label in ('positive', 'negative', 'neutral') and reason <> '' then reason end as reason from p""",
    ),
}
