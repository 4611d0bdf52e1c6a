"""Exact pairs of alike sets against all pairs, and the headlines' query against its oracle on odd rows."""

import datetime as dt
import random
from itertools import combinations

import duckdb
import pytest

from newstide.operators import setjoin
from newstide.plans import catalogue

DAY = dt.date(2020, 1, 6)


def brute(rows, percent, days):
    out = []
    for (x, d, n, s), (y, e, m, t) in combinations(sorted(rows, key=lambda r: r[0]), 2):
        c = len(set(s) & set(t))
        if c and d and e and abs((d - e).days) <= days and 100 * c >= percent * (n + m - c):
            out.append((x, y, c, n, m))
    return sorted(out)


@pytest.mark.parametrize(("percent", "days"), [(80, 2), (55, 0), (90, 5)])
def test_alike_against_all_pairs(spark, percent, days):
    r = random.Random(percent)
    rows, sets = [], []
    for i in range(600):
        if sets and r.random() < 0.7:
            s = set(r.choice(sets))
            for _ in range(r.choice((0, 0, 1, 2))):
                s.add(f"e{r.randrange(60)}")
        else:
            s = {f"e{int(60 * r.random() ** 3)}" for _ in range(r.choice((1, 2, 5, 9, 20)))}
        sets.append(s)
        rows.append((1000 - i, r.choice([DAY + dt.timedelta(days=r.randrange(12))] * 30 + [None]), len(s) + r.choice((0, 0, 0, 1)), sorted(s | {"of all"})[: len(s)]))
    want = brute(rows, percent, days)
    got = sorted(tuple(x) for x in setjoin.alike(spark.createDataFrame(rows, "id long, day date, n long, held array<string>"), percent, days).collect())
    assert len(want) > 100 and any(x[2] < x[3] for x in want) and got == want


def answers(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["shingle_jaccard_band"](spark, str(tmp_path))
    return got, sorted(con.sql(catalogue.ORACLES["shingle_jaccard_band"]).fetchall())


def test_pairs_of_odd_headlines_are_the_oracles(spark, tmp_path):
    """Ids that repeat with one text, languages that are null or alike, texts of a word, none, and copies on near days."""
    near = 1543  # 7 * 1543 % 1800 = 1: the next day's id
    texts = ["", "one", "one two", "a b c d e f g h i j k l m n o p q r s t u v", "a b c d e f g h i j k l m n o p q r s t u x", "a b c a b c a b c", "x" * 400 + " y"]
    rows = []
    for i in range(300):
        text = texts[i % len(texts)]
        rows.append((i // 5 * 1800 + near * (i % 5) % 1800, text, ("en", "en", "fr", None, "1:en")[i // 60], f"src{i % 3}", len(text)))
    rows += [rows[3], rows[4], rows[10], (rows[17][0], rows[17][1], "de", "src0", 1)]
    got, want = answers(spark, tmp_path, rows)
    assert got.dtypes == [("left_id", "bigint"), ("right_id", "bigint"), ("jaccard", "double")]
    assert len(want) > 200 and any(w[2] < 1 for w in want) and sorted(tuple(r) for r in got.collect()) == want


def test_a_shingle_of_all_headlines_costs_its_own_rows(spark, tmp_path):
    """Words of headlines aren't sorted through a window, nor do the rows of a common shingle meet each other."""
    rows = [(i, f"from our own correspondent {' '.join(f'w{i * k % 7919}' for k in range(1, 9))}", "en", "src0", 1) for i in range(6000)]
    rows += [(6000 + i * 1800, "from our own correspondent again", "en", "src0", 1) for i in range(30)]
    got, want = answers(spark, tmp_path, rows)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert len(want) >= 435 and sorted(tuple(r) for r in got.collect()) == want
