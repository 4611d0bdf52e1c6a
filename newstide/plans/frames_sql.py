"""Frames that models read, and the seal.  One text for both engines: (survey ids, body) by name."""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {
    "sealed_frame": (
        "V1",
        """select session, round(ret, 8) as ret, case when row_number() over (order by session desc) > 5 then round(fwd5, 8) end as fwd5
        from (
          select session, ret, lead(close, 5) over (order by session) / close - 1 as fwd5
          from returns
        ) x
        where session < date '1997-01-01'""",
    ),
    "residualised_full_sample": (
        "F7 F6",
        """with f as (
          select n.session, n.sent_mean as y, b.ret as x
          from news_by_session n
          join returns b on b.session = n.session
          where b.ret is not null
        ),
        s as (
          select regr_slope(y, x) as b, regr_intercept(y, x) as a
          from f
        )
        select f.session, round(y - (s.a + s.b * x), 6) as residual
        from f
        cross join s""",
    ),
}
