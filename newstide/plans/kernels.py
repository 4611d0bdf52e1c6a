"""Queries over walk-forward and inference kernels; SQL can't express them, tests plant their truth."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newstide.functions import text
from newstide.operators import asof, drawdowns, inference, textmodel, walk
from newstide.sources import readers
from newstide.streaming import news as streams

from .dialect import run


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("select session, ret as x0, lag(ret) over w as x1, log_range as x2, lead(ret) over w as ret_next, greatest(log_range * log_range, 0.0001) as rv from returns window w as (order by session)")(spark, sf_dir)


def walk_forward_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression arms."""
    return walk.walk_forward(_frame(spark, sf_dir), {"price": ["x0"], "lags": ["x0", "x1"], "range": ["x0", "x1", "x2"]}, "ret_next", "regress")


def walk_forward_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """direction probabilities and the walk-forward constant."""
    return walk.walk_forward(_frame(spark, sf_dir), {"lags": ["x0", "x1"]}, "ret_next", "sign")


def walk_forward_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes with edges of the training slice, one column residualised in the fold."""
    return walk.walk_forward(_frame(spark, sf_dir), {"lags": ["x0", "x1"]}, "ret_next", "terciles", residualise=("x1", ["x0"]))


def walk_forward_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log variance with the smearing factor."""
    return walk.walk_forward(_frame(spark, sf_dir), {"range": ["x2"]}, "rv", "logvar")


#: Features of the warnings: the firm's prices and the market's, then the news about the firm and on all.
WARNING_FEATURES = ["lag0", "lag1", "lag2", "rv20", "dd60", "market_lag0", "market_rv20", "firm_tone20", "has_firm_news20", "tone"]
#: Sessions before the first refit, and the rows of warnings before the first calibration.
WARM, CALIBRATION_WARM = 500, 760


#: A row for each session: its place, the market's features and the tone of all news.
SESSIONS = """select m.session, m.pos, market_lag0, market_rv20, coalesce(t.tone, 0.0) as tone from (
        select session, pos, ret as market_lag0, case when count(ret) over m20 = 20 then stddev_samp(ret) over m20 end as market_rv20
        from returns window m20 as (order by session rows between 19 preceding and current row)
    ) m left join (select session, sum(tone_sum) / sum(n) as tone from {news} group by session) t on t.session = m.session where m.session is not null"""


def drawdown_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the common table ``drawdown``, firm by firm."""
    news = readers.stored(run("select firm, session, tone_sum, n from firm_news")(spark, sf_dir), "firm-news")
    view = f"news_{uuid.uuid4().hex}"  # a name of this call's own
    news.createOrReplaceTempView(view)
    sessions = readers.stored(run(SESSIONS.format(news=view))(spark, sf_dir), "sessions")
    spark.catalog.dropTempView(view)
    return drawdowns.panel(run("select firm, session, close from firm_bars")(spark, sf_dir), news, sessions, sessions.count())


def round6(name: str) -> Column:
    """round(x, 6), which goes through decimals only where x is large or near a tie."""
    x = F.col(name)
    scaled = x * 1e6
    clear = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / 1e6).otherwise(F.round(x, 6)).alias(name)


def drawdown_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each firm's sessions and whether its closes fall."""
    rounded = ("close", "lag0", "lag1", "lag2", "rv20", "dd60", "market_lag0", "market_rv20", "firm_tone20", "tone")
    columns = ("firm", "session", "pos", "age", "close", "event", "lag0", "lag1", "lag2", "rv20", "dd60", "market_lag0", "market_rv20", "firm_tone20", "has_firm_news20", "tone")
    return drawdown_frame(spark, sf_dir).select(*[round6(c) if c in rounded else c for c in columns])


def panel_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled warnings of a fall in the next 20 closes, refitted each 20 sessions on outcomes that were known."""
    panel = drawdown_frame(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), F.col("firm").cast("long").alias("firm"), "session", "event", *WARNING_FEATURES)
    return walk.panel_blocks(readers.stored(panel, "drawdown"), WARNING_FEATURES, "event", warm=WARM)


def calibrated_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt calibration of the warnings in blocks whose outcomes were known."""
    preds = readers.stored(panel_warnings(spark, sf_dir).select("firm", "session", "pos", "prob", "event"), "warnings")
    return walk.calibrate_blocks(preds, warm=CALIBRATION_WARM)


def warning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year, events, alarms, their precision and recall, and the Brier scores of the raw and calibrated warnings."""
    warned = readers.stored(panel_warnings(spark, sf_dir), "warnings")
    told = walk.calibrate_blocks(warned, warm=CALIBRATION_WARM).where("event is not null").groupBy(F.year("session").alias("year"))
    hit = F.col("alarm") & (F.col("event") == 1)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return told.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("event").cast("long").alias("events"),
        F.count_if("alarm").alias("alarms"),
        ratio(F.count_if(hit), F.count_if("alarm")).alias("precision"),
        ratio(F.count_if(hit), F.sum("event")).alias("recall"),
        F.avg((F.col("prob") - F.col("event")) ** 2).alias("brier"),
        F.avg((F.col("calibrated") - F.col("event")) ** 2).alias("brier_calibrated"),
    )


def dimson_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm betas from the sessions before each year of the calendar."""
    firms = run("select firm, session, ret from (select firm, session, close / lag(close) over (partition by firm order by session) - 1 as ret from firm_bars) x where ret is not null")(spark, sf_dir)
    market = run("select session, ret as market from returns where ret is not null")(spark, sf_dir)
    return walk.dimson_betas(firms, market)


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-date block bootstrap of means by arm."""
    sums = run("select case when is_price_report then 'price' else 'other' end as arm, published_date as session, cast(sum(score) as double) as s, count(*) as n from tagged group by 1, 2")(spark, sf_dir)
    return inference.bootstrap_mean(sums)


def control_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random flags, permuted and stale news, and a fixed planted effect."""
    frame = run("select session, pos % 7 = 0 as flag, ret as y from returns where ret is not null")(spark, sf_dir)
    kinds = {"flags": 0.0, "permuted": 0.0, "stale": 0.0, "planted": 0.2}
    out = None
    for kind, effect in kinds.items():
        one = inference.controls(frame, kind, effect=effect).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def cleaned_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, NFKC and marks by an Arrow UDF."""
    return run("select row_id, headline from headlines")(spark, sf_dir).select("row_id", text.clean_text(F.col("headline")).alias("headline"))


def library_template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 T8 W10 W11 by the library's own expressions."""
    return text.cluster_templates(run("select row_id, source, headline, published_date from headlines")(spark, sf_dir), "src0").select("row_id", "template_key", "dup_cluster_id", "cluster_size", "is_canonical")


def library_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 by the library's as-of join."""
    days = run("select row_id, published_date from headlines where date_parse_ok")(spark, sf_dir)
    return asof.forward_asof(days, run("select session from bars")(spark, sf_dir), "published_date", "session").withColumnRenamed("matched", "session")


def bootstrap_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of whole-date resamples from per-date cross products."""
    sums = run("with d as (select firm, session, ret - avg(ret) over (partition by firm) as y, cast(age as double) - avg(cast(age as double)) over (partition by firm) as x from firm_units where ret is not null and abs(ret) < 5) select session, sum(x * x) as xx, sum(x * y) as xy from d group by session")(spark, sf_dir)

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("session")
        xx, xy = pdf["xx"].to_numpy(float).reshape(-1, 1, 1), pdf["xy"].to_numpy(float).reshape(-1, 1)
        draws = inference.bootstrap_ols(xx, xy)[:, 0]
        return pd.DataFrame([{"n_dates": len(pdf)} | inference.interval(draws, float(inference.ols_of_dates(xx, xy)[0]), ddof=1)]) if np.isfinite(draws).all() else pd.DataFrame()

    return sums.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(one, "n_dates long, effect double, lo double, hi double, p double, se double, mde double")


def surrogate_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-randomised series with the exact values, one for each seed."""
    frame = run("select session, ret from returns where ret is not null")(spark, sf_dir)

    def one(key, pdf):
        import numpy as np

        pdf = pdf.sort_values("session")
        return pdf[["seed", "session"]].assign(ret=inference.surrogate(pdf["ret"], np.random.default_rng(int(key[0]))))

    return spark.range(100).withColumnRenamed("id", "seed").crossJoin(frame).groupBy("seed").applyInPandas(one, "seed long, session date, ret double")


def two_way_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm and session means taken out by alternating projections."""
    panel = run("select firm, session, close as y from firm_bars")(spark, sf_dir)
    return walk.demean_two_way(panel, "y", "firm", "session")


def label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """character n-gram classifier of headlines, fitted on all labels at once; its class for every headline."""
    rows = run("select h.doc_id, h.headline as text, cast(l.quality as double) as label from headlines h left join labels l on h.doc_id = l.doc_id")(spark, sf_dir)
    model = textmodel.fit(readers.stored(rows.where("label is not null").select("text", "label"), "labelled-headlines"))
    return model.transform(rows.where("text is not null")).select("doc_id", "label", "prediction")


def issuer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines that hold an issuer's name between word borders, each name's pattern compiled once."""
    issuers = run("select ticker, name from issuers")(spark, sf_dir).collect()  # a row for each of the dictionary's 25 names
    rows = run("select row_id, concat(' ', lower(headline), ' ') as low from headlines")(spark, sf_dir)
    low = F.col("low")  # names are letters, digits, # and @: a pattern that matches holds the name as it is
    held = [F.when(F.contains(low, F.lit(r.name)) & low.rlike(f"[^a-zà-ÿ0-9]{r.name}[^a-zà-ÿ0-9]"), F.lit(r.ticker)) for r in issuers]
    return rows.select("row_id", F.explode(F.array_compact(F.array(*held))).alias("ticker"))


def stored_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by year, read again, with a cache of what is done taken off."""
    rows = run("select row_id, year(published_date) as year, headline from headlines")(spark, sf_dir)
    path = readers.shared_path(spark, "years")
    readers.write_years(rows, path)
    stored = spark.read.parquet(path)
    done = run("select row_id from headlines where date_parse_ok")(spark, sf_dir)
    return readers.only_new(stored, done, ["row_id"]).select("row_id", F.col("year").cast("int").alias("year"), "headline")


def cached_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines by year through a checked cache: made once, and then read where the year's rows are the same."""
    from functools import reduce

    rows = readers.stored(run("select row_id, doc_id, year(published_date) as year, headline from headlines where date_parse_ok")(spark, sf_dir), "cache-rows")
    folder = readers.shared_path(spark, "year-cache")
    years = sorted(r.year for r in rows.select("year").distinct().collect())  # a row a year
    done: list[DataFrame] = []
    for _ in range(2):  # the second reading finds every year in the cache
        done = [readers.cached_year(spark, folder, y, rows.where(F.col("year") == y), ["row_id", "headline"], lambda r: r.select("row_id", "doc_id", F.length("headline").cast("long").alias("n_chars"))).withColumn("year", F.lit(y).cast("long")) for y in years]
    return reduce(DataFrame.unionByName, done)


def news_to_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch of timed news mapped to its next session, as the stream's foreachBatch does."""
    return streams.to_sessions(run("select event_id, ts from news")(spark, sf_dir), run("select distinct session from trades")(spark, sf_dir), "ts")


QUERIES = {
    f.__name__: f
    for f in (
        walk_forward_arms,
        walk_forward_signs,
        walk_forward_terciles,
        walk_forward_variance,
        drawdown_panel,
        panel_warnings,
        calibrated_warnings,
        warning_report,
        dimson_betas,
        bootstrap_means,
        control_runs,
        cleaned_headlines,
        bootstrap_slopes,
        surrogate_returns,
        two_way_demeaned,
        label_classifier,
        issuer_matches,
        stored_years,
        cached_years,
        library_template_clusters,
        library_asof,
        news_to_sessions,
    )
}
ORACLE_BODIES = {
    "stored_years": "select row_id, year(published_date) as year, headline from headlines where not date_parse_ok",
    "cached_years": "select row_id, doc_id, length(headline) as n_chars, year(published_date) as year from headlines where date_parse_ok",
    "library_asof": "select h.row_id, h.published_date, a.session from headlines h join strict_asof a on a.day = h.published_date where h.date_parse_ok",
    "news_to_sessions": "with c as (select distinct session from trades) select n.event_id, n.ts, (select min(session) from c where c.session > n.day) as matched from news n",
    "cleaned_headlines": "select row_id, trim(nfc_normalize(coalesce(headline, ''))) as headline from headlines",
}
