"""One query text for two engines: Spark runs it, DuckDB is its oracle.

A query is a body over named common tables (``PARTS``).  ``render`` puts the
tables it needs in front and fills the few places where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: token: (Spark, DuckDB)
TOKENS = {"@str": ("string", "varchar"), "@r'": ("r'", "'")}

PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text


def _needs(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def render(body: str, duck: bool) -> str:
    wanted: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text, PARTS):
            if n not in wanted:
                add(PARTS[n])
                wanted.append(n)

    add(body)
    text = ("with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in wanted) + "\n" if wanted else "") + body
    if wanted and body.lstrip().lower().startswith("with "):
        text = "with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in wanted) + ",\n" + body.lstrip()[5:]
    return fill(text, duck)


#: ln(x!) by Stirling's series at x + 16, less the logarithm of the factors in between: right to some 1e-12.
LOG_FACTORIAL = "(({0} + 16.5) * ln({0} + 16.0) - ({0} + 16.0) + 0.9189385332046727 + 1.0 / (12 * ({0} + 16.0)) - 1.0 / (360 * pow({0} + 16.0, 3)) + 1.0 / (1260 * pow({0} + 16.0, 5)) - ln(" + " * ".join(f"({{0}} + {k}.0)" for k in range(1, 17)) + "))"


def fill(text: str, duck: bool) -> str:
    """Dialect tokens; @days(a, b) is a - b in days, @plus(d, n) a date n days on, @wd(d) Monday = 0, @rx(x, p, k) a regex group, @lf(x) ln(x!)."""
    side = 1 if duck else 0
    forms = {
        "days": ("datediff({0}, {1})", "date_diff('day', {1}, {0})"),
        "plus": ("date_add({0}, cast({1} as int))", "({0} + cast({1} as int))"),
        "wd": ("weekday({0})", "(isodow({0}) - 1)"),
        "rx": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
        "like": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
        "hash": ("sha2({0}, 256)", "sha256({0})"),
        "mod": ("pmod({0}, {1})", "({0} % {1})"),
        "q": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
        "minutes": ("(hour({0}) * 60 + minute({0}))", "(hour({0}) * 60 + minute({0}))"),
        "ceil": ("cast(ceil({0}) as bigint)", "cast(ceil({0}) as bigint)"),
        "strings": ("array_sort(collect_set({0}))", "list_sort(list_distinct(list({0})))"),
        "join": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
        "even": ("bround({0}, {1})", "round_even({0}, {1})"),
        "month": ("date_format({0}, 'yyyy-MM')", "strftime({0}, '%Y-%m')"),
        "json": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
        "range": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
        "days_range": ("explode(sequence({0}, {1}, interval 1 day))", "cast(unnest(generate_series({0}, {1}, interval 1 day)) as date)"),
        "months_range": ("explode(sequence({0}, {1}, interval 1 month))", "cast(unnest(generate_series({0}, {1}, interval 1 month)) as date)"),
        "each": ("explode({0})", "unnest({0})"),
        "words_at": ("explode(transform({0}, (x, i) -> named_struct('w', x, 'i', i + 1)))", "unnest(list_transform({0}, lambda x, i: {{'w': x, 'i': i}}))"),
        "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
        "replace_all": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
        "rcount": ("regexp_count({0}, {1})", "len(regexp_extract_all({0}, {1}))"),
        "split": ("split({0}, {1})", "string_split_regex({0}, {1})"),
        "date": ("try_to_date({0}, 'yyyy-MM-dd')", "cast(try_strptime({0}, '%Y-%m-%d') as date)"),
        "lf": (LOG_FACTORIAL, LOG_FACTORIAL),
        "num": ("try_cast({0} as double)", "try_cast({0} as double)"),
    }
    while m := re.search(r"@(" + "|".join(sorted(forms, key=len, reverse=True)) + r")\(", text):
        depth, at, args, start = 1, m.end(), [], m.end()
        quoted = False
        while depth:
            c = text[at]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c in "([") - (c in ")]")
                if (c == "," and depth == 1) or not depth:
                    args.append(text[start:at].strip())
                    start = at + 1
            at += 1
        text = text[: m.start()] + forms[m[1]][side].format(*args) + text[at:]
    for token, both in TOKENS.items():
        text = text.replace(token, both[side])
    # decimal literals are doubles in both engines
    return "".join(x if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x) for i, x in enumerate(re.split(r"('[^']*')", text)))


#: The day of a row of each dated table, for runs over a window.
DAYS = {"lineitem": "cast(l_shipdate as date)", "orders": "cast(o_orderdate as date)", "events": "cast(ts as date)"}


def run(body: str, window: tuple[str, str] | None = None):
    """A query function (spark, sf_dir) for a body; with window (first and last day), over the dated tables' rows in it alone.

    So code that is frozen runs again on new data: the folder and the window are
    its parameters, nothing in it is patched.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = render(body, duck=False)
        for name in _needs(text, TABLES):
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if window and name in DAYS:
                rows = rows.where(f"{DAYS[name]} between date '{window[0]}' and date '{window[1]}'")
            rows.createOrReplaceTempView(name)
        return spark.sql(text)

    return query


def windowed(text: str, window: tuple[str, str]) -> str:
    """A rendered text over the rows of the window alone."""
    for name, day in DAYS.items():
        text = re.sub(rf"\bfrom {name}\b", f"from (select * from {name} where {day} between date '{window[0]}' and date '{window[1]}') {name}", text)
    return text
