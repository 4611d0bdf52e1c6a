"""Text forms, keys, tokens and rules over headlines.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "template_clusters": (
        "T6 T7 T8 W10 W11 P10",
        """select row_id, template_key, dup_cluster_id, cluster_size, is_canonical
        from clustered""",
    ),
    "stable_hash_split": (
        "T9 W19 G4 M10",
        """with g as (
          select doc_id, lang, label, row_number() over (partition by lang, label order by @hash(concat('7:', cast(doc_id as @str))), doc_id) as r,
              count(*) over (partition by lang, label) as n
          from (
            select l.doc_id, d.lang, l.quality as label
            from labels l
            join documents d on l.doc_id = d.doc_id
          ) x
        )
        select doc_id, lang, label, case when r <= greatest(1, @even(n / 3.0, 0)) then 'eval'
            when r <= greatest(1, @even(n / 3.0, 0)) + greatest(1, @even(n * 0.15, 0)) then 'val' else 'train' end as split
        from g""",
    ),
    "split_fingerprint": (
        "T10",
        """select lang, count(*) as n, @hash(@join(@strings(cast(doc_id as @str)), chr(10))) as fingerprint
        from documents
        group by lang""",
    ),
    "script_counts": (
        "T3 T4 P22",
        """select doc_id, @rcount(headline, '[a-zA-ZÀ-ÿ]') as latin, @rcount(headline, '[؀-ۿ]') as arabic,
    @rcount(headline, '[A-Za-z]+[2356789]+[A-Za-z]*') as mixed_words, @rcount(headline, '[0-9]') as digits, @like(headline, '[0-9] ?%') as has_percent
        from headlines""",
    ),
    "arabic_match_form": (
        "T2",
        """select doc_id, translate(concat(headline, 'أإآىةـ'), 'أإآىةـ', 'اااي' || 'ه') as match_form
        from headlines""",
    ),
    "keyword_first_match": (
        "P4",
        """select row_id, coalesce(case when position('tion' in lower(headline)) > 0 then 'tion' end, case when position('the' in lower(headline)) > 0
    then 'the' end, case when position('un' in lower(headline)) > 0 then 'un' end) as keyword
        from headlines""",
    ),
    "relevance_tags": (
        "P5 P6 P10 T5",
        r"""with f as (
          select *, @like(concat(' ', lower(headline), ' '), @r'[^\p{L}\p{N}](zu|les?|su)s?[^\p{L}\p{N}]') as foreign_term,
              @like(concat(' ', lower(headline), ' '), @r'[^\p{L}\p{N}](the|of)[^\p{L}\p{N}]') as home_term
          from headlines
        )
        select row_id, case when position('tion' in lower(headline)) > 0 and not (foreign_term and not home_term) then 'home_econ'
            when position('blehe' in lower(headline)) > 0 and not (foreign_term and not home_term) then 'home_econ'
            when position('on' in lower(headline)) > 0 then 'global_linked' else 'other' end as tag, foreign_term and not home_term as foreign_context
        from f""",
    ),
    "residual_audit": (
        "P21",
        """select count(*) filter (where position('on' in lower(headline)) > 0) as generic, count(*) filter (where position('on' in lower(headline)) > 0
    and not @like(lower(headline), '(the|of)')) as residual
        from headlines""",
    ),
    "article_type": (
        "P7 P9 S20",
        """select row_id, is_price_report, case when @like(lower(headline), '(ment|ción)') then 'dividend' when @like(lower(headline), '(ing|ung)')
    then 'earnings' else 'other' end as kind, source in ('src1', 'src2') or @like(lower(headline), 'econ') as economic
        from tagged""",
    ),
    "token_sets": (
        "T11 A16",
        """with t as (
          select source, @each(@split(template_key, ' ')) as token
          from keyed
        )
        select source, count(distinct token) as n_tokens, @hash(@join(@strings(token), ' ')) as fingerprint
        from t
        group by source""",
    ),
    "usable_units": (
        "P12",
        """with g as (
          select firm, session, ret, age, @days(session, prev_session) as back, @days(next_session, session) as ahead
          from firm_units
        )
        select firm, count(*) as n, round(avg(ret), 6) as mean_ret
        from g
        where back <= 5 and ahead <= 5 and ret is not null
        group by firm""",
    ),
    "price_sanity": (
        "P20",
        """select count(*) as n, count(*) filter (where high < low) as high_low, count(*) filter (where close > high or close < low) as close_outside,
    count(*) filter (where low <= 0) as nonpositive, count(*) filter (where volume = 0) as zero_volume, count(*) filter (where close = prev) as stale,
    count(*) filter (where close is null) as nulls, count(*) filter (where @wd(session) >= 5) as weekend,
    round(avg(case when low > 0 and high >= low then (high - low) / close end), 6) as mean_range
        from (
          select *, lag(close) over (order by session) as prev
          from bars
        ) x""",
    ),
    "shingle_jaccard_band": (
        "T13 U7 J8",
        """with w as (
          select doc_id, lang, published_date, @split(template_key, ' ') as w
          from keyed
        ),
        g as (
          select distinct doc_id, lang, published_date, s
          from (
            select doc_id, lang, published_date, concat_ws(' ', w, lead(w) over o, lead(w, 2) over o) as s, lead(w, 2) over o as third,
                row_number() over o as i
            from (
              select doc_id, lang, published_date, p.w as w, p.i as i
              from (
                select doc_id, lang, published_date, @words_at(w) as p
                from w
              ) e
            ) f window o as (partition by doc_id order by i)
          ) h
          where third is not null or i = 1
        ),
        n as (
          select doc_id, count(*) as n
          from g
          group by doc_id
        ),
        c as (
          select a.doc_id as x, b.doc_id as y, count(*) as c
          from g a
          join g b on a.s = b.s and a.lang = b.lang and a.doc_id < b.doc_id and abs(@days(a.published_date, b.published_date)) <= 2
          group by 1, 2
        )
        select x as left_id, y as right_id, round(c / cast(nx.n + ny.n - c as double), 6) as jaccard
        from c
        join n nx on nx.doc_id = x
        join n ny on ny.doc_id = y
        where 10 * c >= 8 * (nx.n + ny.n - c)""",
    ),
}
