"""Text, as-of, reader, walk-forward, inference and stream functions on fresh fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newstide.functions import text as T
from newstide.operators import textmodel, asof, inference, walk
from newstide.sources import readers
from newstide.streaming import news as streams


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_clean_text(spark):
    assert one(spark, "  caf&eacute;‏  ｱ +1,2 % ", T.clean_text(F.col("x")))[0] == "café ア +1,2 %".replace("é ", "é  ")
    assert one(spark, None, T.clean_text(F.col("x")))[0] == ""


@pytest.mark.parametrize(("a", "b", "same"), [("Profit +3,5% lundi", "Profit +12% mardi", True), ("Profit +3%", "Profit -3%", False), ("Up 3 to 4!", "up 30 to 41", True), ("firm buys rival", "rival buys firm", False), ("CA 1 200,5 MD", "ca 31 MD", True), ("a_b", "a b", True)])
def test_template_key(spark, a, b, same):
    keys = [one(spark, x, T.template_key(F.col("x")))[0] for x in (a, b)]
    assert (keys[0] == keys[1]) is same, keys


def test_tokens_and_shingles(spark):
    assert sorted(one(spark, "a b a", T.tokens(F.col("x")))[0]) == ["a", "a b", "b", "b a"]
    assert one(spark, "solo", T.tokens(F.col("x")))[0] == ["solo"]
    assert one(spark, "A b  c d", T.shingles(F.col("x")))[0] == ["a b c", "b c d"] and one(spark, "A b", T.shingles(F.col("x")))[0] == ["a b"]


def test_matching_forms(spark):
    assert one(spark, "أحمـد مدرسة", T.arabic_match_form(F.col("x")))[0] == "احمد مدرسه"
    assert one(spark, "3ajbni 2ème mar7ba 2020", T.mixed_words(F.col("x")))[0] == 2
    assert tuple(one(spark, "abد", T.script_counts(F.col("x")))[0]) == (1, 2)


def test_arabic_dates(spark):
    got = [tuple(one(spark, x, T.arabic_date(F.col("x")))[0]) for x in ("5 مارس 2021", "31 فيفري 2021", "منذ يومين", "x")]
    assert got == [(dt.date(2021, 3, 5), "abs"), (None, "other"), (None, "relative"), (None, "other")]


@pytest.mark.parametrize(("content", "label"), [('{"label": "pos", "reason": "ok"}', "pos"), ('```json\n{"label": "neg", "reason": "r"}\n```', "neg"), ("label: pos, reason: 'fine'", "pos"), ('{"label": "pos", "rea', None), ('{"label": "odd", "reason": "r"}', None), (None, None)])
def test_parsed_label(spark, content, label):
    got = one(spark, content, T.parsed_label(F.col("x"), ["pos", "neg"]))[0]
    assert (got and got["label"]) == label


def test_relevance(spark):
    tag = lambda x: one(spark, x, T.relevance_tag(F.col("x"), ["inflation"], ["acme"], ["oil"], ["ruritania"], ["freedonia"]))[0]
    assert [tag(x) for x in ("Inflation rises", "Inflation in Ruritania", "Inflation in Ruritania and Freedonia", "ACME results", "Oil up", "nothing")] == ["home_econ", "other", "home_econ", "home_econ", "global_linked", "other"]


def test_translation_checks(spark):
    df = spark.createDataFrame([("1er janvier 12", "january 12"), ("7 8", "7"), ("a | b c d e f", "a"), ("w", "x y z x y z x y z")], "a string, b string")
    got = [tuple(r) for r in df.select(T.numbers_preserved(F.col("a"), F.col("b")), T.suspicious_translation(F.col("a"), F.col("b"))).collect()]
    assert got == [(True, False), (False, False), (True, True), (True, True)]


def test_canonical_is_order_free(spark):
    rows = [("a::1", "a", "Up 3%", dt.date(2020, 1, 1)), ("w::2", "wire", "up 4 %", dt.date(2020, 1, 5)), ("b::0", "b", "up 5%", None), ("c::1", "c", "else", None)]
    for order in (rows, rows[::-1]):
        got = T.cluster_templates(spark.createDataFrame(order, "row_id string, source string, headline string, published_date date"), "wire").collect()
        assert sorted(r.row_id for r in got if r.is_canonical) == ["c::1", "w::2"] and {r.cluster_size for r in got} == {1, 3}


def days(spark, *when, name="day"):
    return spark.createDataFrame([(dt.date(2024, 1, d),) for d in when], f"{name} date")


def test_strict_and_inclusive_asof(spark):
    left, right = days(spark, 1, 5, 6, 9), days(spark, 2, 5, 8, name="session")
    strict = {r.day.day: r.matched and r.matched.day for r in asof.forward_asof(left, right, "day", "session").collect()}
    assert strict == {1: 2, 5: 8, 6: 8, 9: None}
    keyed = asof.forward_asof(left.withColumn("k", F.lit("a")), right.withColumn("k", F.lit("a")), "day", "session", ["k"], strict=False)
    assert {r.day.day: r.matched and r.matched.day for r in keyed.collect()} == {1: 2, 5: 5, 6: 8, 9: None}


def test_calendar_tools(spark):
    bars = spark.createDataFrame([(dt.date(2024, 1, i), c, c + 1, c - 1) for i, c in ((1, 5.0), (2, 5.0), (3, 6.0))], "session date, close double, high double, low double")
    assert [r.session.day for r in asof.drop_phantoms(bars).orderBy("session").collect()] == [1, 3]
    panel = spark.createDataFrame([("f", dt.date(2024, 1, 2), 1.0)], "firm string, day date, v double")
    assert [r.v for r in asof.fill_forward(panel, days(spark, 1, 2, 3), "firm", "day", "v").orderBy("day").collect()] == [None, 1.0, 1.0]
    sealed = asof.seal(bars, "session", "2024-01-03", {"high": 1}).orderBy("session").collect()
    assert [r.high for r in sealed] == [6.0, None]
    with pytest.raises(ValueError):
        asof.one_to_one(bars, bars.unionByName(bars), ["session"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿headline;date\n﻿one;2020-01-02\n;bad\n", encoding="utf-8")
    got = readers.read_headlines(spark, f"file://{tmp_path}/a.csv", "a", ";").orderBy("row_id").collect()
    assert [(r.row_id, r.headline_raw, r.date_parse_ok) for r in got] == [("a::0", "one", True), ("a::1", "", False)]
    (tmp_path / "px").mkdir()
    for t in ("AA", "BB"):
        (tmp_path / "px" / f"{t}.csv").write_text("date,close\n2020-01-01,1\n")
    assert sorted(r.Ticker for r in readers.read_ticker_folder(spark, f"file://{tmp_path}/px").collect()) == ["AA", "BB"]
    (tmp_path / "l.txt").write_text("1,pos,because, well\n\n2,neg\n")
    assert [tuple(r) for r in readers.read_labels(spark, f"file://{tmp_path}/l.txt").collect()] == [("1", "pos", "because, well"), ("2", "neg", None)]
    (tmp_path / "p.csv").write_text("date,open,high,low,close,volume\n2020-01-01,9,3,1,2,10\nbad,1,1,1,1,1\n2020-01-02,9,4,2,3,0\n")
    prices = readers.read_prices(spark, f"file://{tmp_path}/p.csv").orderBy("session").collect()
    assert "open" not in prices[0].asDict() and prices[0].ret is None and prices[1].ret == 0.5
    raw = spark.createDataFrame([("02/01/2020", "1 234,5", "2", "1", "1,5", "x"), ("bad", "1", "1", "1", "1", "1")], "`Séance` string, Ouverture string, Haut string, Bas string, `Clôture` string, Volume string")
    assert [(r.open, r.close, r.volume) for r in readers.localised_prices(raw).collect()] == [(1234.5, 1.5, None)]
    old = spark.createDataFrame([("f", dt.date(2024, 1, i), float(i)) for i in (1, 2, 3)], "firm string, session date, close double")
    new = spark.createDataFrame([("f", dt.date(2024, 1, i), 2.0 * i) for i in (2, 3, 4)], "firm string, session date, close double")
    assert [r.close for r in readers.splice(old, new, "2024-01-03").orderBy("session").collect()] == [1, 2, 3, 4]
    page = spark.createDataFrame([(1, '<a href="/x">One <b>two</b></a><a class="c" href="/x">again</a><a href="/y">y</a><time datetime="2021-05-06T10:00">', "http://s/n")], "page_id long, html string, url string")
    assert [(r.href, r.headline) for r in readers.list_page(page).orderBy("pos").collect()] == [("/x", "One two"), ("/y", "y")]
    assert page.select(readers.page_date(F.col("url"), F.col("html"))).first()[0] == dt.date(2021, 5, 6)
    items = readers.json_items(spark.createDataFrame([('{"d": {"rows": [{"t": "a"}, {"t": "b"}]}}',)], "j string"), "j", "d struct<rows array<struct<t string>>>".replace("struct<rows ", "struct<rows:").replace("<t ", "<t:"), "d.rows")
    assert [r.t for r in items.collect()] == ["a", "b"]
    frame = spark.createDataFrame([(2020, "a"), (2021, "b")], "year int, id string")
    readers.write_years(frame, f"file://{tmp_path}/years")
    readers.write_years(frame.where("year = 2021").withColumn("id", F.lit("c")), f"file://{tmp_path}/years")
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/years").collect()) == ["a", "c"]
    assert readers.only_new(frame, frame.where("year = 2020"), ["id"]).count() == 1


def frame(n=700, signal=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return pd.DataFrame({"session": pd.bdate_range("2015-01-01", periods=n).date, "x": x, "c": rng.normal(size=n), "y": signal * x + rng.normal(size=n)})


@pytest.mark.parametrize("kind", ["regress", "sign", "terciles", "logvar"])
def test_the_future_changes_no_forecast(kind):
    f = frame()
    if kind == "logvar":
        f["y"] = f["y"] ** 2 + 0.01
    g = f.copy()
    g.loc[600:, ["x", "y"]] = 99.0
    a, b = (walk.walk(d, ["x"], "y", kind, residualise=("x", ["c"])) for d in (f, g))
    assert len(a) == 200 and np.allclose(a["pred"][:100], b["pred"][:100])


def test_planted_signal_is_found_and_noise_is_not():
    for signal, found in ((1.0, True), (0.0, False)):
        got = walk.walk(frame(1500, signal, 3), ["x"], "y")
        assert bool(np.corrcoef(got["y"], got["pred"])[0, 1] > 0.3) is found


def test_demeaning_equals_dummies(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"f": np.repeat([0, 1, 2], 20), "t": np.tile(np.arange(20), 3), "x": rng.normal(size=60)})
    d["y"] = 2 * d["x"] + d["f"] + rng.normal(size=60)
    dummies = np.column_stack([d["x"], *[d["f"] == i for i in (1, 2)], *[d["t"] == i for i in range(1, 20)]]).astype(float)
    x, y = (walk.demean_two_way(spark.createDataFrame(d), c, "f", "t").toPandas().sort_values(["f", "t"])[c].to_numpy() for c in "xy")
    assert np.isclose((x @ y) / (x @ x), walk.ols(dummies, d["y"].to_numpy())[1])
    gaps = d.drop(index=[3, 17, 41, 42, 50])  # an unbalanced panel takes several rounds
    got = walk.demean_two_way(spark.createDataFrame(gaps), "y", "f", "t").toPandas().sort_values(["f", "t"])["y"]
    one = np.column_stack([np.ones(len(gaps)), *[gaps["f"] == i for i in (1, 2)], *[gaps["t"] == i for i in range(1, 20)]]).astype(float)
    rest = gaps["y"].to_numpy() - one @ np.linalg.lstsq(one, gaps["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(got, rest, atol=1e-9)


def test_date_sums_give_the_regression_of_any_resample():
    rng = np.random.default_rng(2)
    date, x = np.repeat(np.arange(30), 4), rng.normal(size=(120, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=120)
    xx = np.stack([x[date == d].T @ x[date == d] for d in range(30)])
    xy = np.stack([x[date == d].T @ y[date == d] for d in range(30)])
    w = inference.date_counts(30, 5, 4, 7)
    got = inference.bootstrap_ols(xx, xy, 5, 4, 7)
    for k in range(4):
        rows = np.concatenate([np.flatnonzero(date == d) for d in range(30) for _ in range(w[k, d])])
        assert np.allclose(np.linalg.lstsq(x[rows], y[rows], rcond=None)[0], got[k])


def test_calibration_sees_known_outcomes_alone():
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"pos": np.repeat(np.arange(420), 5), "prob": rng.random(2100)})
    f["event"] = (rng.random(2100) < 0.3 * f["prob"]).astype(float)
    for method in ("platt", "isotonic"):
        a = walk.calibrate(f, method)
        assert a["calibrated"][a["pos"] < 260].isna().all()
        assert abs(a["calibrated"].mean() - f["event"][f["pos"] >= 260].mean()) < 0.04
        g = f.copy()
        g.loc[g["pos"] >= 340, "event"] = 1.0
        b = walk.calibrate(g, method)
        early = (a["pos"] >= 260) & (a["pos"] < 360)
        assert np.allclose(a["calibrated"][early], b["calibrated"][early])


def test_isotonic_and_binomial():
    assert walk.isotonic([1, 2, 3, 4], [1, 0, 0, 1])[1].tolist() == [1 / 3, 1 / 3, 1 / 3, 1]
    assert math.isclose(inference.binomial_p(1, 10), 22 / 1024)


def test_surrogate_and_permutation_keep_the_values():
    rng = np.random.default_rng(8)
    x = rng.normal(size=101)
    assert np.allclose(np.sort(inference.surrogate(x, rng)), np.sort(x))
    assert sorted(inference.permute_blocks(23, 5, rng)) == list(range(23))


def test_controls(spark):
    rng = np.random.default_rng(9)
    f = spark.createDataFrame(pd.DataFrame({"session": pd.bdate_range("2015-01-01", periods=600).date, "flag": rng.random(600) < 0.3, "y": rng.normal(size=600)}))
    assert inference.controls(f, "planted", 10, effect=1.0).where("found").count() == 10
    for kind in ("flags", "permuted", "stale"):
        assert inference.controls(f, kind, 20).where("found").count() <= 5


def test_beta_uses_the_past_alone(spark):
    rng = np.random.default_rng(4)
    day = pd.bdate_range("2014-01-01", "2016-12-31").date
    m = rng.normal(scale=0.01, size=len(day))
    firm = pd.DataFrame({"firm": 1, "session": day, "ret": 1.5 * m + rng.normal(scale=0.001, size=len(day))})
    later = firm.copy()
    later.loc[[d.year >= 2016 for d in day], "ret"] = 0.0
    market = spark.createDataFrame(pd.DataFrame({"session": day, "market": m}))
    got = [{r.year: r.beta for r in walk.dimson_betas(spark.createDataFrame(f).withColumn("firm", F.col("firm").cast("long")), market, [2015, 2016]).collect()} for f in (firm, later)]
    assert got[0] == got[1] and abs(got[0][2016] - 1.5) < 0.1


def test_betas_of_every_year_and_firm(spark, sf):
    from newstide.plans import catalogue, dialect, kernels

    firms, years = (dialect.run(f"select distinct {x} as k from {t} where ret is not null")(spark, sf).collect() for x, t in (("firm", "(select firm, close / lag(close) over (partition by firm order by session) - 1 as ret from firm_bars) x"), ("year(session)", "returns")))
    got = catalogue.QUERIES["dimson_betas"](spark, sf).collect()
    assert sorted((r.firm, r.year) for r in got) == sorted((f.k, y.k) for f in firms for y in years)
    assert {r.year for r in got} == set(range(1995, 2002)) and all(r.beta == 1.0 for r in got if r.year == 1995)


def test_panel_blocks_learn_from_all_firms_before_each_block(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame([(p, f, dt.date(2015, 1, 1) + dt.timedelta(p)) for p in range(333) for f in range(6) if rng.random() < 0.8], columns=["pos", "firm", "session"])
    d["x"] = rng.normal(size=len(d))
    d["event"] = (d["x"] + rng.normal(size=len(d)) > 1.5).astype(float)
    got = walk.panel_blocks(spark.createDataFrame(d), ["x"], "event").toPandas().sort_values(["pos", "firm"])
    test = d[d["pos"] >= 250].sort_values(["pos", "firm"])
    assert got[["pos", "firm"]].to_numpy().tolist() == test[["pos", "firm"]].to_numpy().tolist() and got["session"].tolist() == test["session"].tolist()
    for k in range(250, 333, 20):
        train = d[d["pos"] < k - 20]
        z = lambda v: ((v - train["x"].mean()) / train["x"].std(ddof=0)).to_numpy()[:, None]  # noqa: B023, E731
        w = walk.logit(z(train["x"]), train["event"].to_numpy(), balanced=True)
        p = lambda v: 1 / (1 + np.exp(-(w[0] + w[1] * z(v)[:, 0])))  # noqa: B023, E731
        now, want = got[(got["pos"] >= k) & (got["pos"] < k + 20)], p(test["x"][(test["pos"] >= k) & (test["pos"] < k + 20)])
        assert np.allclose(now["prob"], want) and (now["alarm"].to_numpy() == (want >= np.quantile(p(train["x"]), 0.95))).all()


def test_demeaning_makes_its_panel_once(spark, monkeypatch):
    """Rounds read a stored panel: the rows are made once, however many rounds there are."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)
    stored = []
    monkeypatch.setattr(walk.readers, "stored", lambda df, name, f=walk.readers.stored: stored.append(name) or f(df, name))

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x)

    rows = spark.range(400).select((F.col("id") % 20).alias("f"), (F.col("id") * 7 % 31).alias("t"), seen((F.col("id") * F.col("id") % 101).cast("double")).alias("y"))
    got = walk.demean_two_way(rows, "y", "f", "t").collect()
    assert len(got) == 400 and 400 <= made.value <= 800 and len(stored) > 5  # the UDF may stand in the filter, too


def test_issuers_are_matched_without_a_join(spark, sf):
    """Each name is a pattern of the plan, not one compiled for each pair of a headline and an issuer."""
    from newstide.plans import catalogue

    plan = catalogue.QUERIES["issuer_matches"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RLIKE" in plan.upper()


def test_gram_counts_are_handed_on_as_sums(spark):
    """A task hands on a row for each distinct gram, not one for each that stands in a text."""
    from collections import Counter

    texts = ["ab ab abc", "Abc  ABC\tx", "", None, "abc"] * 200
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    parts = textmodel.counted(rows, 2, 5)
    times, having = Counter(), Counter()
    for t in texts:
        own = textmodel.padded_grams(t or "", 2, 5)
        times.update(own)
        having.update(own.keys())
    assert {r.gram: (r.times, r.texts) for r in parts.collect()} == {g: (n, having[g]) for g, n in times.items()}
    plan = parts._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "Generate" not in plan  # grams are added up before they are dealt out


def test_panels_are_by_firm(spark, sf):
    from newstide.plans import catalogue, dialect, kernels

    rows = dialect.run("select n.firm, n.session, b.pos from firm_bars n join bars b on n.session = b.session")(spark, sf).collect()
    flat = catalogue.QUERIES["two_way_demeaned"](spark, sf).toPandas()
    assert sorted(zip(flat["firm"], flat["session"], strict=True)) == sorted((r.firm, r.session) for r in rows)
    assert all(flat.groupby(c)["y"].mean().abs().max() < 1e-9 for c in ("firm", "session"))
    told = dialect.run("select * from drawdown")(spark, sf).collect()
    got = catalogue.QUERIES["panel_warnings"](spark, sf).collect()
    assert sorted((r.firm, r.session) for r in got) == sorted((r.firm, r.session) for r in told if r.pos >= 500 and None not in [r[c] for c in kernels.WARNING_FEATURES])
    assert 0.02 < np.mean([r.event for r in got if r.event is not None]) < 0.9 and {r.alarm for r in got} == {True, False}
    report = catalogue.QUERIES["warning_report"](spark, sf).collect()
    assert sum(r.n for r in report) == sum(r.event is not None for r in got) and all(0 <= r.recall <= 1 for r in report)


def test_text_classifier_equals_a_plain_version(spark, sf):
    """Grams, vocabulary and vectors of 300 texts by loops; the fit is where the penalised loss is flat, for two classes and for three."""
    from collections import Counter

    texts = [" ".join((r.text or "").split("\n")[0].split()[:12]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("text is not null").limit(300).collect()]
    texts[:3] = ["A  b\tcd", "", "é"]

    def grams(text):
        out = Counter()
        for word in text.lower().split():
            padded = f" {word} "
            for n in (2, 3, 4, 5):
                if n <= len(padded):
                    for i in range(len(padded) - n + 1):
                        out[padded[i : i + n]] += 1
        return out

    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", textmodel.grams(F.col("text"), 2, 5).alias("g")).collect()
    assert all(Counter(r.g) == grams(r.text) == textmodel.padded_grams(r.text, 2, 5) for r in got)
    counts = [grams(t) for t in texts]
    total, df = sum(counts, Counter()), Counter(g for c in counts for g in c)
    for most in (60_000, 40):
        want = sorted((g for g in total if df[g] >= 2), key=lambda g: (-total[g], g.encode()))[:most]
        words, idf = textmodel.vocabulary(rows, most=most)
        assert words == want and np.allclose(idf, [np.log(301 / (1 + df[g])) + 1 for g in want])
    for classes in (2, 3):
        labels = [float(len(t) % classes) for t in texts]
        data = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, label double")
        model = textmodel.fit(data, most=300)
        x = np.zeros((len(texts), 300))
        for i, c in enumerate(counts):
            for j, g in enumerate(model.words):
                if g in c:
                    x[i, j] = (1 + np.log(c[g])) * model.idf[j]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        margin = x @ model.weights.T + model.intercepts
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        weight = np.array([len(labels) / (classes * labels.count(v)) for v in labels])
        slope = 2.0 * ((weight[:, None] * (share - np.eye(classes)[np.array(labels, int)])).T @ x)
        flat = slope + model.weights if classes > 2 else slope[1] + model.weights[1]
        assert np.abs(flat).max() < 1e-3
        told = model.transform(data.withColumn("prediction_", F.lit(1))).collect()
        assert [r.prediction for r in told] == margin.argmax(axis=1).tolist() and np.allclose([r.probability for r in told], share.max(axis=1))


def test_a_checked_cache_reuses_refuses_and_recovers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(7, "t7")], "id long, text string")
    folder, made = f"file://{tmp_path}/cache", []
    make = lambda r: made.append(1) or r.select("id", F.length("text").alias("n"))
    first = readers.cached_year(spark, folder, 2001, rows, ["id", "text"], make)
    again = readers.cached_year(spark, folder, 2001, rows.repartition(9).orderBy(F.desc("id")), ["id", "text"], make)
    assert len(made) == 1 and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and first.count() == 51
    for other in (rows.where("id <> 3"), rows.dropDuplicates(), rows.withColumn("text", F.when(F.col("id") == 5, "x").otherwise(F.col("text"))), rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError, match="other rows"):
            readers.cached_year(spark, folder, 2001, other, ["id", "text"], make)
    (tmp_path / "cache" / "2001.json").unlink()  # a run that was cut off before its manifest
    assert readers.cached_year(spark, folder, 2001, rows, ["id", "text"], make).count() == 51 and len(made) == 2
    assert readers.cached_year(spark, folder, 2002, rows.where("false"), ["id", "text"], make).count() == 0


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 9)), ("a", dt.datetime(2024, 1, 1, 10)), ("b", dt.datetime(2024, 1, 2, 9))], "href string, ts timestamp")
    src.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in")
    query = streams.deduplicated(stream, ["href"], "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2
    query = streams.counts(stream, "ts", "href").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2]
    got = {r.href: r.matched.day for r in streams.to_sessions(src, days(spark, 2, 3, name="session"), "ts").collect()}
    assert got == {"a": 2, "b": 3}


def test_table_is_replaced_under_its_name_and_dropped(spark):
    first = readers.create_table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), "kept_articles")
    second = readers.create_table(spark.createDataFrame([(3, 1.5)], "id long, y double"), "kept_articles")
    assert [tuple(r) for r in second.collect()] == [(3, 1.5)] and sorted(r.id for r in first.collect()) == [1, 2]
    assert spark.table("kept_articles").columns == ["id", "y"] and [t.name for t in spark.catalog.listTables("default") if t.name == "kept_articles"] == ["kept_articles"]
    readers.create_table(spark.table("kept_articles").where("false"), "kept_articles")  # made of itself
    assert spark.table("kept_articles").collect() == []
    readers.drop_table(spark, "kept_articles")
    assert not spark.catalog.tableExists("kept_articles")
    readers.drop_table(spark, "kept_articles")


def test_inventory_equals_the_file_system(spark, sf, tmp_path):
    import os

    made = f"{tmp_path}/parts.parquet"
    spark.range(1000).repartition(3).write.parquet(made)
    spark.range(0).write.parquet(f"{tmp_path}/none.parquet")
    got = {r.table: r for r in readers.inventory(spark, str(tmp_path), ["parts", "none"]).collect()} | {r.table: r for r in readers.inventory(spark, sf, ["documents"]).collect()}
    for name, folder, rows in (("parts", str(tmp_path), 1000), ("none", str(tmp_path), 0), ("documents", sf, spark.read.parquet(f"{sf}/documents.parquet").count())):
        path = f"{folder}/{name}.parquet"
        files = [path] if os.path.isfile(path) else [f"{path}/{x}" for x in os.listdir(path) if x.endswith(".parquet")]
        r = got[name]
        assert (r.rows, r.files, r.bytes) == (rows, len(files), sum(os.path.getsize(x) for x in files))
        assert r.modified is None and not files or abs(r.modified.replace(tzinfo=dt.timezone.utc).timestamp() - max(map(os.path.getmtime, files))) < 1


def test_files_are_named_by_their_partition(spark, tmp_path):
    rows = spark.createDataFrame([(f"F{i}", float(i)) for i in range(40)], "ticker string, close double")
    rows.repartition("ticker").write.partitionBy("ticker").csv(f"{tmp_path}/parts", header=True)
    readers.name_by_partition(spark, f"file://{tmp_path}/parts", "ticker", f"file://{tmp_path}/files")
    assert sorted(p.stem for p in (tmp_path / "files").glob("*.csv")) == sorted(f"F{i}" for i in range(40))
    got = readers.read_ticker_folder(spark, f"file://{tmp_path}/files").collect()
    assert {r.Ticker: float(r.Close) for r in got} == {f"F{i}": float(i) for i in range(40)}


def test_tickers_are_written_and_listed_in_tasks(spark, tmp_path, monkeypatch):
    """A file for each ticker in bounded folders, values as they were, a firm that goes on from batch to batch; the driver reads no file."""
    monkeypatch.setattr(readers, "FILES", 10)
    want = [(f"F/{i}", str(j), None if j == 2 else i + j / 3) for i in range(40) for j in range(5)] + [('a "b", c', "x,\"y\"", 1e-30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        folders = readers.write_tickers(spark.createDataFrame([*want, (None, "0", 0.0)], "ticker string, date string, close double"), "ticker", f"file://{tmp_path}/t")
        frame = readers.read_tickers(spark, f"file://{tmp_path}/t", folders, ["date", "close"])
        got = sorted((r.Ticker, r.Date, r.Close and float(r.Close)) for r in frame.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 3 <= folders <= 6 and len(list((tmp_path / "t").glob("*/*.csv"))) == 41 and not list((tmp_path / "t").glob("*/.[0-9a-f]*[0-9a-f]"))
    assert got == sorted(want, key=lambda r: r[:2]) and frame.inputFiles() == []
    with pytest.raises(Exception, match="columns"):
        readers.read_tickers(spark, f"file://{tmp_path}/t", folders, ["date"]).count()


def test_grams_are_counted_from_small_batches(spark, monkeypatch):
    """A worker holds the words of 2,048 texts at most, and hands on sums when it has many words, too."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    rows = spark.createDataFrame([(f"aa bb w{i % 50}",) for i in range(300)], "text string").coalesce(1)
    want = {r.gram: (r.times, r.texts) for r in textmodel.counted(rows, 2, 3).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048 and want["aa"] == (300, 300)
    monkeypatch.setattr(textmodel, "COUNTED", 7)
    assert {r.gram: (r.times, r.texts) for r in textmodel.counted(rows, 2, 3).collect()} == want
