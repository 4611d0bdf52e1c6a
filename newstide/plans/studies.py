"""Queries of whole studies over kernels and library functions, with DuckDB oracles written apart where SQL can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newstide.functions import text
from newstide.operators import asof, controls, inference, minhash, series, setjoin, studies, textmodel, walk
from newstide.sources import readers

from . import relational  # noqa: F401  (names the common tables)
from .dialect import TABLES, render, run, windowed
from .kernels import _frame

#: The grid of the sensitivity study.
MIN_TRAIN, REFIT = [300, 500, 750, 1000], [1, 5, 20, 60]


def walk_forward_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price arm alone, which has a closed form."""
    p = walk.walk_forward(_frame(spark, sf_dir), {"price": ["x0"]}, "ret_next", "regress")
    return p.select("session", F.round("y", 8).alias("y"), F.round("pred", 8).alias("pred"), "constant")


def walk_forward_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the 250 rows before each refit's embargo."""
    p = walk.walk_forward(_frame(spark, sf_dir), {"price": ["x0"]}, "ret_next", "regress", window=250)
    return p.select("session", F.round("y", 8).alias("y"), F.round("pred", 8).alias("pred"), "constant")


def walk_forward_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the boosted-trees kind, refits side by side."""
    return walk.walk_forward(_frame(spark, sf_dir), {"lags": ["x0", "x1"]}, "ret_next", "boost", parts=8)


def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward in every cell of min_train and refit."""
    grid = studies.sensitivity_grid(_frame(spark, sf_dir), ["x0"], "ret_next", MIN_TRAIN, REFIT)
    return grid.select("min_train", "refit", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "constant", "lift", "mcnemar_p", "oos_r2")])


def sensitivity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the reading holds in all cells."""
    found = studies.stability(studies.sensitivity_grid(_frame(spark, sf_dir), ["x0"], "ret_next", MIN_TRAIN, REFIT))
    return found.select("beats_everywhere", "significant", "cells", F.round("accuracy_low", 6).alias("accuracy_low"), F.round("accuracy_high", 6).alias("accuracy_high"), "stable")


#: Sessions over which an outlet's tone is taken (stand-in outlets have a headline in some weeks only), and those it must cover to be ranked.
TONE_SESSIONS, LEAST_SESSIONS = 250, 100


def _outlets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """session, ret_next, x0 and, for each source, its mean score over the last TONE_SESSIONS sessions; the sources with LEAST_SESSIONS sessions of tone."""
    news = "select a.session, t.source, t.score from tagged t join strict_asof a on a.day = t.published_date where t.date_parse_ok and a.session is not null and t.source is not null"
    sources = sorted(r.source for r in run(f"select distinct source from ({news}) x")(spark, sf_dir).collect())  # a row a source
    name = lambda s: "`sent_" + s.replace("`", "``") + "`"
    frame = run("select session, ret as x0, lead(ret) over (order by session) as ret_next from returns")(spark, sf_dir).where("x0 is not null")
    daily = run(news)(spark, sf_dir).groupBy("session").pivot("source", sources).agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    recent = Window.orderBy("session").rowsBetween(1 - TONE_SESSIONS, 0)  # over sessions
    col = lambda s, what: F.sum(F.col("`" + s.replace("`", "``") + f"_{what}`")).over(recent)
    frame = frame.join(daily, "session", "left").select("session", "x0", "ret_next", *[(col(s, "s") / col(s, "n")).alias(f"sent_{s}") for s in sources])
    frame = readers.stored(frame, "outlet-tone")
    covered = frame.agg(*[F.count(name(s)).alias(s) for s in sources]).first() if sources else {}
    return frame, [s for s in sources if covered[s] >= LEAST_SESSIONS]


def source_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accuracy lost without each source, on the window that the best covered share."""
    frame, sources = _outlets(spark, sf_dir)
    return studies.source_ablation(frame, ["x0"], [f"sent_{s}" for s in sources], "ret_next", parts=4).withColumn("source", F.regexp_replace("source", "^sent_", ""))


def _with_presence(frame: DataFrame, sources: list[str]) -> DataFrame:
    return frame.withColumns({f"has_{s}": F.col(f"sent_{s}").isNotNull().cast("double") for s in sources}).fillna(0.0, subset=[f"sent_{s}" for s in sources])


def outlet_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: each source added to the prices, and left out of all."""
    frame, sources = _outlets(spark, sf_dir)
    return studies.outlet_ranking(_with_presence(frame, sources), ["x0"], sources, "ret_next", parts=4)


def outlet_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: standardised in-sample least squares over all sources with Newey-West errors."""
    frame, sources = _outlets(spark, sf_dir)
    rows = _with_presence(frame, sources).withColumn("_all", F.lit(1))
    return rows.groupBy("_all").applyInPandas(lambda pdf: studies.outlet_weights(pdf, ["x0"], sources, "ret_next"), "source string, beta double, t double, p double")


UNITS = """select firm, session, next_session, abs_r, avg(abs_r) over (partition by firm order by session rows between 4 preceding and current row) as har5,
    avg(abs_r) over (partition by firm order by session rows between 21 preceding and current row) as har22, y from (
        select firm, session, lead(session) over w as next_session, abs(close / lag(close) over w - 1) as abs_r, abs(lead(close) over w / close - 1) as y from firm_bars window w as (partition by firm order by session)
    ) x where abs_r is not null and y is not null"""
EVENTS = """select u.*, cast(year(u.session) * 4 + floor((month(u.session) - 1) / 3) as bigint) as quarter, n.tokens from units u join (
        select firm, session, flatten(collect_list(split(template_key, ' '))) as tokens from (
            select k.template_key, a.session, f.firm from keyed k join strict_asof a on a.day = k.published_date
            join (select firm, row_number() over (order by firm) - 1 as i, count(*) over () as n from (select distinct firm from prices) p) f on f.i = k.doc_id % f.n
        ) h group by firm, session
    ) n on n.firm = u.firm and n.session = u.session"""
ARMS = {"prices": ["f0"], "words": ["f0", "score"], "last": ["f0", "abs_r"], "both": ["f0", "score", "abs_r"]}
HAR = ["abs_r", "har5", "har22"]


def yearly_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    units = readers.stored(run(UNITS)(spark, sf_dir), "units")
    view = f"units_{uuid.uuid4().hex}"  # a name of this call's own
    units.createOrReplaceTempView(view)
    events = readers.stored(run(EVENTS.replace("from units u", f"from {view} u"))(spark, sf_dir), "events")
    spark.catalog.dropTempView(view)
    years = sorted(r.y for r in units.select(F.year("session").alias("y")).distinct().collect())  # a row for each year
    return units, events, years[1:]


def yearly_panel_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly walk over firms' units and news events."""
    units, events, years = yearly_frames(spark, sf_dir)
    return studies.yearly_walk(units, events, years, HAR, ARMS, "1996-01-01")


def yearly_walk_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with events scored by a logistic fit on the screened words."""
    units, events, years = yearly_frames(spark, sf_dir)
    return studies.yearly_walk(units, events, years, HAR, ARMS, "1996-01-01", method="logit")


def yearly_walk_dmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with events scored by Poisson regressions of all eligible words."""
    units, events, years = yearly_frames(spark, sf_dir)
    return studies.yearly_walk(units, events, years, HAR, ARMS, "1996-01-01", method="dmr")


def yearly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every headline by the classifier of the labels before its year, or blank."""
    rows = run("select h.doc_id, h.published_date as day, h.headline as text, cast(l.quality as double) as label from headlines h left join labels l on h.doc_id = l.doc_id where h.date_parse_ok")(spark, sf_dir)
    years = sorted(r.y for r in rows.select(F.year("day").alias("y")).distinct().collect())
    return studies.yearly_scores(rows.select("doc_id", "day", "text"), rows.where("label is not null and text is not null"), years, textmodel.fit, at_once=4).drop("text")


#: Columns of the controls: prices, and what is known of a session's news.
CONTROL_NEWS = ["tone", "has_news"]


def _control_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """select b.session, b.ret as x0, lag(b.ret) over (order by b.session) as x1, coalesce(n.sent_mean, 0.0) as tone, case when n.n_headlines > 0 then 1.0 else 0.0 end as has_news,
    lead(b.ret) over (order by b.session) as ret_next from returns b left join news_by_session n on n.session = b.session"""
    return readers.stored(run(body)(spark, sf_dir), "controls")


def positive_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect planted so that the median statistic of paired walk-forwards is 2.8, and how many of 100 fresh runs find it."""
    return controls.positive(_control_frame(spark, sf_dir), ["x0", "x1"], CONTROL_NEWS, "ret_next")


def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of 100 walk-forwards each over permuted targets, stale news and phase-randomised columns; at most 9 may be."""
    return controls.negative(_control_frame(spark, sf_dir), ["x0", "x1"], CONTROL_NEWS, "ret_next")


def noise_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news columns' loss against that of 100 phase-randomised ones through the same walk-forwards."""
    return controls.matched_noise(_control_frame(spark, sf_dir), ["x0", "x1"], CONTROL_NEWS, "ret_next")


def series_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADF, KPSS, autocorrelations, Ljung-Box, ARCH-LM and CUSUM of three series."""
    rows = run("select 'ret' as series, session, ret as x from returns where ret is not null union all select 'abs_ret', session, abs(ret) from returns where ret is not null union all select 'log_close', session, ln(close) from bars")(spark, sf_dir)

    def one(key, pdf):
        import pandas as pd

        return pd.DataFrame(series.battery(pdf.sort_values("session")["x"]), columns=["test", "lag", "statistic", "p_or_critical"]).assign(series=key[0])

    return rows.groupBy("series").applyInPandas(one, "series string, test string, lag int, statistic double, p_or_critical double")


def series_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The battery's closed forms: autocorrelations, Ljung-Box and the CUSUM's supremum."""
    b = series_battery(spark, sf_dir).where("series = 'ret' and (test = 'acf' or test = 'ljung_box' or test = 'cusum')")
    return b.select("test", F.col("lag").cast("long").alias("lag"), F.round("statistic", 6).alias("statistic"))


def surrogate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns phase-randomised with shared phases, one block for each seed."""
    frame = run("select session, ret, log_range from returns where ret is not null")(spark, sf_dir)

    def one(key, pdf):
        import numpy as np

        pdf = pdf.sort_values("session")
        block = inference.surrogate(pdf[["ret", "log_range"]].to_numpy(float), np.random.default_rng(int(key[0])))
        return pdf[["seed", "session"]].assign(ret=block[:, 0], log_range=block[:, 1])

    return spark.range(100).withColumnRenamed("id", "seed").crossJoin(frame).groupBy("seed").applyInPandas(one, "seed long, session date, ret double, log_range double")


def library_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 by the library's splice."""
    old = run("select firm, session, close from firm_bars where session < date '1996-01-01'")(spark, sf_dir)
    new = run("select firm, session, close * 2 as close from firm_bars where session >= date '1995-06-01'")(spark, sf_dir)
    return readers.splice(old, new, "1995-12-31").select("firm", "session", F.round("close", 8).alias("close"))


def library_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 by the library's seal."""
    frame = run("select session, round(close, 8) as close, lead(close, 5) over (order by session) / close - 1 as fwd5 from bars")(spark, sf_dir)
    return asof.seal(frame, "session", "1997-01-01", {"fwd5": 5}).select("session", "close", F.round("fwd5", 8).alias("fwd5"))


def library_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 U5 by the library's fill."""
    panel = run("select firm, session as day, close from trades")(spark, sf_dir)
    return asof.fill_forward(panel, run("select distinct session as day from trades")(spark, sf_dir), "firm", "day", "close")


def library_arabic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 by the library's parser."""
    months = "array(" + ", ".join(f"'{m}'" for m in text.ARABIC_MONTHS) + ")"
    rows = run(f"select doc_id, case when doc_id % 5 = 0 then 'منذ يومين' when doc_id % 7 = 0 then headline else concat(cast(1 + doc_id % 31 as string), ' ', element_at({months}, cast(1 + doc_id % 12 as int)), ' ', cast(2010 + doc_id % 9 as string)) end as raw from headlines")(spark, sf_dir)
    found = text.arabic_date(F.col("raw"))
    return rows.select("doc_id", found["date"].alias("day"), found["category"].alias("category"))


def library_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 by the library's label parser."""
    rows = run("""select conv_id, turn, case turn % 4 when 0 then '{"label": "positive", "reason": "ok"}' when 1 then 'Sure: {"label": "negative", "reason": "bad day"} done' when 2 then 'label: neutral, reason: "no news"' else 'label: odd' end as reply from conversations""")(spark, sf_dir)
    found = text.parsed_label(F.col("reply"), ["positive", "negative", "neutral"])
    return rows.select("conv_id", "turn", found["label"].alias("label"), found["reason"].alias("reason"))


def library_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 P5 P6 by the library's cascade."""
    rows = run("select row_id, headline from headlines")(spark, sf_dir)
    return rows.select("row_id", text.relevance_tag(F.col("headline"), ["tion", "ung"], ["ment"], ["the", "de "], ["and", "les"], ["that", "une"]).alias("tag"), text.first_keyword(F.lower("headline"), ["tion", "ung"]).alias("keyword"))


def library_page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 S16 by the library's page functions."""
    rows = run("select page_id, url, html from dated_pages")(spark, sf_dir)
    href = F.regexp_extract("url", r"://[^/?#]+([^#]*)", 1)
    return rows.select("page_id", readers.page_date(F.col("url"), F.col("html")).alias("day"), href.alias("href"), readers.article_id(F.concat("url", F.lit("_"), F.col("page_id").cast("string"))).alias("article_id"))


#: Articles of the reprint query: first lines over 60 days; src0 is the wire.
DATED = "select doc_id as id, source, lang, headline, @plus(date '1996-01-01', doc_id * 7 % 60) as day from headlines"


def wire_reprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reprints of the wire by MinHash bands, verified."""
    found = minhash.reprints(run(DATED)(spark, sf_dir), F.col("source") == "src0", text.shingles(F.col("headline")))
    return found.withColumn("similarity", F.round("similarity", 8))


def _shingled(keyed: DataFrame) -> DataFrame:
    """id, day, n, held: each document's distinct word 3-grams with their language; those without one count in n and are held by no other.

    Rows that repeat an id are one document, their words in the order of their
    places, as the oracle's window has them.
    """
    rows = keyed.groupBy("doc_id").agg(F.any_value("published_date").alias("day"), F.collect_list(F.struct("lang", "words")).alias("rows"))
    rows = rows.withColumn("rows", F.filter("rows", lambda r: r["words"].isNotNull())).where("doc_id is not null and size(rows) > 0")  # here, where the words are made, not made twice
    placed = F.flatten(F.transform("rows", lambda r: F.transform(r["words"], lambda w, i: F.struct(i.alias("i"), w.alias("w"), r["lang"].alias("lang")))))
    tag = lambda lang: F.coalesce(F.concat(F.length(lang).cast("string"), F.lit(":"), lang), F.lit("-"))

    def grams(p):
        short = F.array(F.concat(tag(p[0]["lang"]), F.lit(" "), F.array_join(p["w"], " ")))
        long = F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: F.concat(tag(p[i]["lang"]), F.lit(" "), F.concat_ws(" ", p[i]["w"], p[i + 1]["w"], p[i + 2]["w"])))
        return F.array_distinct(F.when(F.size(p) < 3, short).otherwise(long))

    # in an array of one, so that the words are put in order once, not once for each gram
    rows = rows.select("doc_id", "day", F.explode(F.transform(F.array(F.sort_array(placed)), grams)).alias("s"))
    return rows.select(F.col("doc_id").alias("id"), "day", F.size("s").cast("long").alias("n"), F.filter("s", lambda x: ~x.startswith("-")).alias("held"))


def shingle_jaccard_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of headlines within two days with a Jaccard similarity of 0.8 or more; the SQL of that name is the oracle."""
    found = setjoin.alike(_shingled(run("select doc_id, lang, published_date, @split(template_key, ' ') as words from keyed")(spark, sf_dir)))
    return found.select("left_id", "right_id", F.round(F.col("c") / (F.col("left_n") + F.col("right_n") - F.col("c")).cast("double"), 6).alias("jaccard"))


def price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as a delimited file and read by the price reader, a bad date among them."""
    path = readers.shared_path(spark, "prices")
    bars = run("select cast(session as string) as date, low as open, high, low, close, volume from bars union all select 'n/a', 1, 1, 1, 1, 1")(spark, sf_dir)
    bars.coalesce(1).write.csv(path, header=True)
    return readers.read_prices(spark, path).select("session", "close", F.round("ret", 6).alias("ret"), F.round("range_pct", 6).alias("range_pct"), F.round("log_volume", 6).alias("log_volume"))


def ticker_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each firm, the ticker from the file's name."""
    path = readers.shared_path(spark, "tickers")
    rows = run("select concat('F', cast(firm as string)) as ticker, cast(session as string) as date, close from firm_bars")(spark, sf_dir)
    folders = readers.write_tickers(rows, "ticker", path)
    return readers.read_tickers(spark, path, folders, ["date", "close"]).select("Ticker", F.col("Date").cast("date").alias("Date"), F.col("Close").cast("double").alias("Close"))


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as a table of the catalogue, created or replaced."""
    rows = run("select row_id, source, headline, published_date from headlines where date_parse_ok")(spark, sf_dir)
    return readers.create_table(rows, "articles")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, files, bytes and time of the last change of each table."""
    return readers.inventory(spark, sf_dir, list(TABLES))


#: The window of the frozen rerun.
WINDOW = ("1997-01-01", "1998-06-30")
FROZEN = "select year(session) as y, count(*) as n, round(avg(ret), 8) as mean_ret, round(stddev_samp(ret), 8) as sd from returns where ret is not null group by year(session)"


def frozen_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: a frozen query on the rows of a window, its folder and window being parameters."""
    return run(FROZEN, WINDOW)(spark, sf_dir)


def reproduction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: a stored result against its rerun, to 1e-9."""
    path = readers.shared_path(spark, "sealed")
    result = run("select session, close, ret, range_pct from returns")
    result(spark, sf_dir).write.parquet(path)
    told = readers.reproduces(result(spark, sf_dir), spark.read.parquet(path), ["session"])
    return told.select("column", "n", "missing", "same")


QUERIES = {
    f.__name__: f
    for f in (
        walk_forward_price,
        walk_forward_sliding,
        walk_forward_boosted,
        sensitivity_grid,
        sensitivity_verdict,
        source_ablation,
        outlet_ranking,
        outlet_weights,
        yearly_panel_walk,
        yearly_walk_logit,
        yearly_walk_dmr,
        yearly_scores,
        positive_control,
        negative_controls,
        noise_reading,
        series_battery,
        series_dependence,
        surrogate_blocks,
        library_splice,
        library_seal,
        library_fill_forward,
        library_arabic_dates,
        library_replies,
        library_relevance,
        library_page_dates,
        wire_reprints,
        shingle_jaccard_band,
        price_file,
        ticker_folder,
        stored_table,
        file_inventory,
        frozen_rerun,
        reproduction_check,
    )
}

_CUMULATED = """u as (select session, x0, ret_next as y, row_number() over (order by session) - 1 as i from (select session, ret as x0, lead(ret) over (order by session) as ret_next from returns) f where x0 is not null and ret_next is not null),
c as (select i, sum(x0) over w as sx, sum(y) over w as sy, sum(x0 * x0) over w as sxx, sum(x0 * y) over w as sxy, count(*) over w as n, sum(case when y > 0 then 1 else 0 end) over w as up from u window w as (order by i))"""
#: Least squares of one feature from sums up to each refit's cut.
_FITTED = "(n * sxy - sx * sy) / (n * sxx - sx * sx)"
_LF = "lf as (select i, sum(case when i = 0 then 0.0 else ln(i) end) over (order by i) as lf from (select unnest(generate_series(0, 20000)) as i) r)"


def _price_oracle(window: int | None) -> str:
    low = "c0.i = -1" if window is None else f"c0.i = greatest(c1.i - {window}, -1)"
    return render(
        f"""with {_CUMULATED}, z as (select * from c union all select -1, 0, 0, 0, 0, 0, 0),
    t as (select u.*, greatest(1, 500 + cast(floor((u.i - 500) / 20.0) as bigint) * 20 - 5) - 1 as cut from u where u.i >= 500),
    s as (select t.session, t.x0, t.y, c1.n - c0.n as n, c1.sx - c0.sx as sx, c1.sy - c0.sy as sy, c1.sxx - c0.sxx as sxx, c1.sxy - c0.sxy as sxy, c1.up - c0.up as up from t join z c1 on c1.i = t.cut join z c0 on {low})
    select session, round(y, 8) as y, round((sy - {_FITTED} * sx) / n + {_FITTED} * x0, 8) as pred, case when up / cast(n as double) >= 0.5 then 1.0 else 0.0 end as constant from s""",
        duck=True,
    )


_GRID = f"""{_CUMULATED}, {_LF},
cells as (select m, r from (select unnest([{', '.join(map(str, MIN_TRAIN))}]) as m) a cross join (select unnest([{', '.join(map(str, REFIT))}]) as r) b),
t as (select cells.m, cells.r, u.x0, u.y, greatest(1, m + cast(floor((u.i - m) / cast(r as double)) as bigint) * r - 5) - 1 as cut from u join cells on u.i >= cells.m),
p as (select t.m, t.r, t.y, (sy - {_FITTED} * sx) / n + {_FITTED} * t.x0 as pred, up / cast(n as double) >= 0.5 as constant from t join c on c.i = t.cut),
h as (select m, r, y, pred, (pred > 0) = (y > 0) as hit, constant = (y > 0) as base from p),
k as (select m, r, count(*) as n, avg(case when hit then 1.0 else 0.0 end) as accuracy, avg(case when base then 1.0 else 0.0 end) as constant, count(*) filter (where hit and not base) as b, count(*) filter (where base and not hit) as c, 1 - sum((y - pred) * (y - pred)) / sum(y * y) as oos_r2 from h group by m, r),
q as (select k.m, k.r, least(1.0, sum(exp(fn.lf - fi.lf - fr.lf - fn.i * ln(2.0)))) as p from k join lf fn on fn.i = k.b + k.c join lf fi on fi.i <= fn.i join lf fr on fr.i = fn.i - fi.i join lf ka on ka.i = least(k.b, k.c) join lf kb on kb.i = greatest(k.b, k.c) where fi.lf + fr.lf >= ka.lf + kb.lf - 0.000000001 group by k.m, k.r),
grid as (select k.m as min_train, k.r as refit, k.n, accuracy, constant, accuracy - constant as lift, q.p as mcnemar_p, oos_r2 from k join q on q.m = k.m and q.r = k.r)"""
_ARABIC = "[" + ", ".join(f"'{m}'" for m in text.ARABIC_MONTHS) + "]"
ORACLES = {
    "walk_forward_price": _price_oracle(None),
    "walk_forward_sliding": _price_oracle(250),
    "sensitivity_grid": render(f"with {_GRID} select min_train, refit, n, round(accuracy, 6) as accuracy, round(constant, 6) as constant, round(lift, 6) as lift, round(mcnemar_p, 6) as mcnemar_p, round(oos_r2, 6) as oos_r2 from grid", duck=True),
    "sensitivity_verdict": render(f"with {_GRID} select bool_and(lift > 0) as beats_everywhere, count(*) filter (where mcnemar_p < 0.05) as significant, count(*) as cells, round(min(accuracy), 6) as accuracy_low, round(max(accuracy), 6) as accuracy_high, bool_and(lift > 0) and avg(case when mcnemar_p < 0.05 then 1.0 else 0.0 end) >= 0.75 as stable from grid", duck=True),
    "series_dependence": render(
        """with d as (select ret - avg(ret) over () as d, row_number() over (order by session) as i, count(*) over () as n from returns where ret is not null),
    v as (select sum(d * d) as v, max(n) as n from d),
    a as (select k, sum(a.d * b.d) as c from d a cross join (select unnest(generate_series(1, 20)) as k) ks join d b on b.i = a.i - k group by k),
    r as (select k, c / v as r, n from a cross join v)
    select 'acf' as test, k as lag, round(r, 6) as statistic from r
    union all select 'ljung_box', m, round(sum(n * (n + 2) * r * r / (n - k)), 6) from r join (select unnest([5, 10, 20]) as m) ms on k <= m group by m
    union all select 'cusum', 0, round(max(abs(s)) / sqrt(max(v) / (max(n) - 1) * max(n)), 6) from (select sum(d) over (order by i) as s from d) x cross join v""",
        duck=True,
    ),
    "library_splice": render("with o as (select firm, min(session) as s from firm_bars where session >= date '1995-06-01' and session < date '1996-01-01' group by firm) select b.firm, b.session, round(b.close, 8) as close from firm_bars b left join o on o.firm = b.firm where b.session < date '1996-01-01' or o.firm is not null", duck=True),
    "library_seal": render("with f as (select session, close, pos, lead(close, 5) over (order by session) as later from bars), m as (select max(pos) as last from bars where session < date '1997-01-01') select session, round(close, 8) as close, case when pos + 5 <= last then round(later / close - 1, 8) end as fwd5 from f cross join m where session < date '1997-01-01'", duck=True),
    "library_fill_forward": render("select g.firm, g.day, (select max_by(t.close, t.session) from trades t where t.firm = g.firm and t.session <= g.day and t.close is not null) as close from (select f.firm, d.session as day from (select distinct firm from trades) f cross join (select distinct session from trades) d) g", duck=True),
    "library_arabic_dates": render(f"select doc_id, case when doc_id % 5 <> 0 and doc_id % 7 <> 0 then cast(try_strptime(cast(2010 + doc_id % 9 as varchar) || '-' || cast(1 + doc_id % 12 as varchar) || '-' || cast(1 + doc_id % 31 as varchar), '%Y-%m-%d') as date) end as day, case when doc_id % 5 = 0 then 'relative' when doc_id % 7 = 0 or try_strptime(cast(2010 + doc_id % 9 as varchar) || '-' || cast(1 + doc_id % 12 as varchar) || '-' || cast(1 + doc_id % 31 as varchar), '%Y-%m-%d') is null then 'other' else 'abs' end as category from headlines", duck=True),
    "library_replies": "select conv_id, turn, case turn % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'neutral' end as label, case turn % 4 when 0 then 'ok' when 1 then 'bad day' when 2 then 'no news' end as reason from conversations",
    "library_relevance": render("with h as (select row_id, lower(headline) as t, position('tion' in lower(headline)) > 0 as a, position('ung' in lower(headline)) > 0 as b, list_filter(string_split_regex(lower(headline), '[^\\p{L}\\p{N}_]+'), lambda x: x in ('and', 'ands', 'les', 'less')) as f, list_filter(string_split_regex(lower(headline), '[^\\p{L}\\p{N}_]+'), lambda x: x in ('that', 'thats', 'une', 'unes')) as g from headlines) select row_id, case when (a or b or position('ment' in t) > 0) and not (len(f) > 0 and len(g) = 0) then 'home_econ' when position('the' in t) > 0 or position('de ' in t) > 0 then 'global_linked' when t is not null then 'other' else 'other' end as tag, case when a then 'tion' when b then 'ung' end as keyword from h", duck=True),
    "library_page_dates": render(
        "select page_id, case page_id % 6 when 0 then date '2019-03-07' when 1 then date '2020-11-30' when 2 then date '2018-02-09' when 3 then date '2017-12-05' when 4 then cast(try_strptime('2016-' || case when page_id % 4 = 0 then '02' else '08' end || '-' || cast(1 + page_id % 28 as varchar), '%Y-%m-%d') as date) end as day, regexp_extract(case when page_id % 6 = 0 then url || '/2019/03/07/' else url end, '://[^/?#]+([^#]*)', 1) as href, cast(page_id as varchar) as article_id from pages",
        duck=True,
    ),
    "wire_reprints": render(
        f"""with x as (select *, case when source is not null then source = 'src0' else false end as wire, string_split(lower(trim(regexp_replace(headline, '\\s+', ' ', 'g'))), ' ') as w from ({DATED}) d),
    s as (select id, lang, day, wire, list_filter(case when len(w) >= 3 then list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) else [array_to_string(w, ' ')] end, lambda y: y <> '') as s from x),
    e as (select id, lang, day, wire, len(s) as n, unnest(s) as g from s),
    p as (select a.id, b.id as wire_id, count(*) / cast(any_value(a.n) + any_value(b.n) - count(*) as double) as j from e a join e b on a.g = b.g and not a.wire and b.wire and a.lang is not distinct from b.lang and abs(date_diff('day', a.day, b.day)) <= 2 group by 1, 2),
    k as (select *, row_number() over (partition by id order by j desc, wire_id) as r from p where j >= 0.8)
    select s.id, k.id is not null as reprint, round(j, 8) as similarity, wire_id from s left join k on k.id = s.id and r = 1 where not wire""",
        duck=True,
    ),
    "price_file": render("select session, close, round(ret, 6) as ret, round(range_pct, 6) as range_pct, round(log_volume, 6) as log_volume from returns", duck=True),
    "ticker_folder": render("select concat('F', cast(firm as varchar)) as \"Ticker\", session as \"Date\", close as \"Close\" from firm_bars", duck=True),
    "stored_table": render("select row_id, source, headline, published_date from headlines where date_parse_ok", duck=True),
    "frozen_rerun": windowed(render(FROZEN, duck=True), WINDOW),
    "reproduction_check": render("select c as \"column\", (select count(*) from bars) as n, cast(0 as bigint) as missing, true as same from (select unnest(['close', 'ret', 'range_pct']) as c) x", duck=True),
}
