"""Index frames on small fixtures: short windows, phantom sessions, volumes of 0, days of publication."""

import datetime as dt
import math
import statistics

import pytest

from newstide.operators import frames

DAY = dt.date(2020, 1, 6)  # a Monday


def bars_of(spark, n=70, phantom=None, zero=()):
    rows = []
    for i in range(n):
        close = 100 + 7 * math.sin(i) + i % 5
        rows.append((DAY + dt.timedelta(days=i + 2 * (i // 5)), close, close + 1 + i % 3, close - 1, 0.0 if i in zero else 10.0 + i))
    if phantom is not None:
        rows[phantom] = (rows[phantom][0], *rows[phantom - 1][1:4], 0.0)
    return rows, spark.createDataFrame(rows, "session date, close double, high double, low double, volume double")


def test_index_frame_by_loops(spark):
    rows, bars = bars_of(spark, phantom=30)
    got = {r.session: r for r in frames.index_frame(bars, (1, 5)).collect()}
    kept = [r for i, r in enumerate(rows) if i != 30]
    assert sorted(got) == [r[0] for r in kept]
    close = [r[1] for r in kept]
    ret = [None] + [b / a - 1 for a, b in zip(close, close[1:], strict=False)]
    for i, r in enumerate(kept):
        g = got[r[0]]
        want = {f"ret_lag{k}": ret[i - k] if i >= k else None for k in (0, 1, 2)}
        want["rv20"] = statistics.stdev(ret[i - 19 : i + 1]) if i >= 20 else None
        want["dd250"] = close[i] / max(close[max(0, i - 249) : i + 1]) - 1 if i >= 59 else None
        want |= {f"fwd{h}": close[i + h] / close[i] - 1 if i + h < len(close) else None for h in (1, 5)}
        want |= {f"dow_next_{name}": float(i + 1 < len(kept) and kept[i + 1][0].weekday() == k) for k, name in enumerate(frames.WEEKDAYS)}
        for name, v in want.items():
            assert g[name] is None if v is None else g[name] == pytest.approx(v, abs=1e-12), (i, name)


def test_range_frame_floors_the_past_and_scores_no_flat_session(spark):
    rows, bars = bars_of(spark, 30)
    rows[25] = (rows[25][0], 100.0, 100.0, 100.0, 5.0)
    got = frames.range_frame(spark.createDataFrame(rows, bars.schema), str(DAY)).orderBy("session").collect()
    assert got[24].pv_next is None and got[25].har1 == pytest.approx(math.log(1e-4)) and got[29].pv_next is None
    logs = [math.log(max(math.log(r[2] / r[3]), 1e-4)) for r in rows]
    assert got[3].har5 is None and got[4].har5 == pytest.approx(sum(logs[:5]) / 5) and got[20].har22 is None and got[28].har22 == pytest.approx(sum(logs[7:29]) / 22)
    assert got[3].gap_next == 1 and got[4].gap_next == 3 and got[29].gap_next is None
    assert got[0].pv_next == pytest.approx(math.log(rows[1][2] / rows[1][3]) ** 2 / (4 * math.log(2)))


def test_news_counts_on_the_next_session_only(spark):
    rows, bars = bars_of(spark, 10)
    news = spark.createDataFrame([(rows[1][0], 1.0, False), (rows[1][0], -1.0, True), (rows[4][0], 2.0, False), (rows[9][0], 1.0, False), (None, 5.0, False), (rows[6][0], None, False)], "day date, score double, is_price_report boolean")
    arms = {"": "true", "_placebo": "is_price_report"}
    got = frames.direction_frame(bars, news, arms, str(DAY)).orderBy("session").collect()
    assert [(r.tone, r.has_news, r.tone_placebo, r.has_news_placebo) for r in got[:6]] == [(0.0, 0.0, 0.0, 0.0)] * 2 + [(0.0, 1.0, -1.0, 1.0)] + [(0.0, 0.0, 0.0, 0.0)] * 2 + [(2.0, 1.0, 0.0, 0.0)]
    assert got[2].log_n == pytest.approx(math.log(3)) and got[7].has_news == 0.0  # a headline without a score
    sent = frames.replication_frame(bars, news, arms, str(DAY)).orderBy("session").collect()
    assert (sent[2].sent_pos_share_lag1, sent[2].sent_neg_share_placebo_lag1, sent[5].sent_mean_lag1, sent[5].has_sent_placebo_lag1) == (0.5, 1.0, 2.0, 0.0)
    assert len(frames.direction_frame(bars, news.limit(0), arms, str(rows[3][0])).collect()) == 7


def test_orphans_replace_their_own_and_keep_the_rest(spark):
    rows, bars = bars_of(spark, 12, zero=(4,))
    frame = bars.selectExpr("session", "1.5 as x", "cast(-9 as double) as vol_chg_lag0").where(f"session >= '{rows[2][0]}'")
    got = frames.with_orphans(frame, bars).orderBy("session").collect()
    assert set(got[0].asDict()) == {"session", "x", "high", "low", "vol_chg_lag0", *[f"dow_next_{n}" for n in frames.WEEKDAYS]}
    assert got[0].vol_chg_lag0 == pytest.approx(math.log(12 / 11))  # from a bar before the frame
    assert got[2].vol_chg_lag0 == got[3].vol_chg_lag0 == 0.0 and all(r.x == 1.5 for r in got)
    assert got[-1].dow_next_mon is None and got[2].dow_next_mon == 1.0
    jump = spark.createDataFrame([(DAY, 1.0, 1.0, 1.0, 1.0), (DAY + dt.timedelta(days=1), 1.0, 1.0, 1.0, 1e6)], bars.schema)
    assert [r.vol_chg_lag0 for r in frames.with_orphans(jump.select("session"), jump).orderBy("session").collect()] == [0.0, 3.0]


def test_macro_is_known_from_its_day_of_publication(spark):
    at = lambda k: DAY + dt.timedelta(days=k)
    sessions = spark.createDataFrame([(at(k),) for k in (0, 1, 2, 3, 4, 7)], "session date")
    series = spark.createDataFrame(
        [
            ("d", at(0), at(0), 10.0, None),
            ("d", at(2), at(2), 11.0, None),
            ("d", at(5), at(5), 22.0, None),  # no session
            ("d", at(6), at(7), 99.0, None),  # published late, with the next
            ("d", at(7), at(7), 33.0, None),
            ("m", at(-30), at(1), 5.0, 0.25),
            ("m", at(0), at(40), 6.0, 0.5),
            ("m", at(0), None, 7.0, 0.5),
            (None, at(0), at(0), 8.0, None),
        ],
        "name string, day date, known date, level double, ret double",
    )
    got = frames.with_macro(sessions, series, ["d", "m", "none"]).orderBy("session").collect()
    assert [r.d_level for r in got] == [10, 10, 11, 11, 11, 33] and [r.d_is_ffill for r in got] == [0, 1, 0, 1, 1, 0]
    assert got[0].d_ret is None and [r.d_ret for r in got[1:]] == pytest.approx([0, 0.1, 0, 0, 0.5])
    assert [r.m_level for r in got] == [None, 5, 5, 5, 5, 5] and [r.m_ret for r in got] == [None] + [0.25] * 5 and [r.m_is_ffill for r in got] == [1, 0, 1, 1, 1, 1]
    assert all(r.none_level is None and r.none_ret is None and r.none_is_ffill == 1 for r in got)
