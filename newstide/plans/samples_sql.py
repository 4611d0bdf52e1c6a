"""Orders, picks, samples, splits and raters.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "dedupe_keep_last": (
        "O2 O4",
        """select l_suppkey, l_linenumber, l_orderkey, l_quantity
        from (
          select *, row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey desc, l_partkey desc) as r
          from lineitem
        ) x
        where r = 1""",
    ),
    "top_moves": (
        "O1 O3 O5",
        """select session, ret
        from (
          select session, round(ret, 8) as ret, row_number() over (order by abs(ret) desc, session) as r
          from returns
          where ret is not null
        ) x
        where r <= 10""",
    ),
    "stratified_sample": (
        "O6",
        """select row_id, source
        from (
          select row_id, source, row_number() over (partition by source order by @hash(concat('11:', row_id)), row_id) as r
          from headlines
        ) x
        where r <= 5""",
    ),
    "proportional_allocation": (
        "O7 G1",
        """with s as (
          select lang, relevance_tag, count(*) as n
          from tagged
          where is_canonical
          group by lang, relevance_tag
        ),
        f as (
          select *, 60.0 * n / sum(n) over () as want
          from s
        ),
        b as (
          select *, floor(want) as base, row_number() over (order by want - floor(want) desc, lang, relevance_tag) as r,
              60 - sum(floor(want)) over () as extra
          from f
        )
        select lang, relevance_tag, n, cast(greatest(least(n, 2), base + case when r <= extra then 1 else 0 end) as bigint) as take
        from b""",
    ),
    "two_pass_sample": (
        "O8 O9",
        """with s as (
          select row_id, @hash(concat('5:', row_id)) as h, row_number() over (partition by source, lang order by @hash(concat('5:', row_id)), row_id) as r
          from headlines
        )
        select row_id, r = 1 as first_pass
        from s
        order by case when r = 1 then 0 else 1 end, h, row_id
        limit 100""",
    ),
    "quota_by_year": (
        "O10",
        """select row_id, y
        from (
          select k.row_id, year(k.published_date) as y,
              row_number() over (partition by year(k.published_date) order by @hash(concat('3:', k.row_id)), k.row_id) as r
          from clustered k
          left join (
            select distinct c.template_key
            from clustered c
            join labels l on c.doc_id = l.doc_id
          ) t on k.template_key = t.template_key
          where t.template_key is null and k.is_canonical
        ) x
        where r <= 20""",
    ),
    "chunk_ids": (
        "O11",
        """with b as (
          select row_id, substring(row_id, 1, length(source) + 5) as head
          from headlines
        ),
        g as (
          select head, coalesce(sum(n) over (order by head rows between unbounded preceding and 1 preceding), 0) as before
          from (
            select head, count(*) as n
            from b
            group by head
          ) x
        )
        select b.row_id, cast(floor((g.before + row_number() over (partition by b.head order by b.row_id) - 1) / 100) as bigint) as chunk
        from b
        join g on g.head = b.head""",
    ),
    "score_fill": (
        "G8 G5 G7",
        """select h.row_id, case when year(h.published_date) >= 1998 and l.quality is not null then l.quality * 2 - 1 else t.score end as score, case
    when year(h.published_date) >= 1998 and l.quality is not null then 'yearly' else 'static' end as provenance
        from headlines h
        join tagged t on h.row_id = t.row_id
        left join labels l on h.doc_id = l.doc_id""",
    ),
    "populated_annotators": (
        "G2 P15",
        """select count(*) filter (where trim(a1) <> '') > 0 as annotator_1, count(*) filter (where trim(a2) <> '') > 0 as annotator_2,
    count(*) - count(distinct doc_id) as duplicate_ids, count(*) filter (where a1 not in ('neg', 'neu', 'pos')) as invalid
        from raters""",
    ),
    "gold_sample": (
        "G1 O8 O9",
        """with s as (
          select *, row_number() over (partition by lang, relevance_tag order by @hash(concat('g:', row_id)), row_id) as r,
              count(*) over (partition by lang, relevance_tag) as n
          from tagged
          where is_canonical and date_parse_ok
        )
        select row_id, lang, relevance_tag, n
        from s
        where r <= greatest(1, least(n, 20))""",
    ),
}
