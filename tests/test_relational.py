"""Every registered query of the catalogue against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from newstide.operators import inference, walk
from newstide.plans import catalogue, kernels
from newstide.plans.dialect import TABLES, run


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, con, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([norm(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_kernel_query_has_whole_rows(spark, sf, name):
    """What SQL can't tell is held against plain versions in test_studies.py; here: rows, distinct, and numbers that are numbers."""
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    assert len(set(map(repr, rows))) == len(rows)
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float)), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_survey_ids_that_are_claimed():
    claimed = {i for ids in catalogue.COVERS.values() for i in ids.split()}
    assert not claimed & {"S23", "F13", "G6", "V2", "T16", "A32"}  # out of scope
    assert all(i[0].isupper() and i[1:].isdigit() for i in claimed)
    assert {"F1", "F3", "F4", "F5", "F9", "F11", "F12", "F14", "F15", "F16", "F21", "I11", "I14", "I15", "E13", "T7", "S4", "S7", "S28", "V3", "V4", "W20"} <= claimed


def captured(monkeypatch, query, spark, sf):
    """The rows that a query's body gives, as pandas, and the query's own result."""
    bodies = []
    monkeypatch.setattr(kernels, "run", lambda body: bodies.append(body) or run(body))
    got = catalogue.QUERIES[query](spark, sf).collect()
    return run(bodies[0])(spark, sf).toPandas().sort_values("session"), got


def test_bootstraps_draw_2000_times(spark, sf, monkeypatch):
    rows, got = captured(monkeypatch, "bootstrap_means", spark, sf)
    for r in got:
        d = rows[rows["arm"] == r.arm]
        w, s, n = inference.date_counts(len(d), 20, 2000, 20261003), d["s"].to_numpy(float), d["n"].to_numpy(float)
        want = inference.interval((w @ s) / (w @ n), s.sum() / n.sum())
        assert all(math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())
    rows, (r,) = captured(monkeypatch, "bootstrap_slopes", spark, sf)
    xx, xy = rows["xx"].to_numpy(float).reshape(-1, 1, 1), rows["xy"].to_numpy(float).reshape(-1, 1)
    want = inference.interval(inference.bootstrap_ols(xx, xy, 20, 2000)[:, 0], float(inference.ols_of_dates(xx, xy)[0]), ddof=1)
    assert all(math.isclose(r[k], v, rel_tol=1e-6) for k, v in want.items())


def test_controls_have_100_seeds(spark, sf):
    got = catalogue.QUERIES["control_runs"](spark, sf).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == dict.fromkeys(("flags", "permuted", "stale", "planted"), 100)


def test_label_classifier_has_the_published_parameters(spark, sf, monkeypatch):
    models = []
    monkeypatch.setattr(kernels.textmodel, "fit", lambda *a, f=kernels.textmodel.fit, **k: models.append((k, f(*a, **k))) or models[-1][1])
    catalogue.QUERIES["label_classifier"](spark, sf)
    (how, model), *_ = models
    assert how == {} and {len(w) for w in model.words} == {2, 3, 4, 5} and len(model.words) <= 60_000


def test_outlets_are_the_sources(spark, sf):
    rows = catalogue.QUERIES["source_ablation"](spark, sf).collect()
    known = {r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()}
    assert len(rows) > 2 and {r.source for r in rows} <= known
    ranked = sorted((r for r in rows if r.status == "ranked"), key=lambda r: r.place)
    assert all(r.drop is None and r.place is None for r in rows if r.status != "ranked") and [r.place for r in ranked] == list(range(1, len(ranked) + 1))
    assert all(a["drop"] >= b["drop"] for a, b in zip(ranked, ranked[1:], strict=False))
    arms = {r.arm for r in catalogue.QUERIES["outlet_ranking"](spark, sf).collect()}
    assert len(arms) > 3 and {a.split(":")[1] for a in arms if ":" in a} <= known
