"""Exact pairs of alike sets on near days: rare-first prefixes, verified.

Rows with equal sets are one class.  A set that has the threshold's similarity
to another shares so many elements with it that one of them is among its rarest
few; classes meet by these alone, on days near each other.  So an element that
many sets hold costs its own rows, and no task holds the rows of a common one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.sources import readers


def alike(rows: DataFrame, percent: int = 80, days: int = 2) -> DataFrame:
    """left_id, right_id, c, left_n, right_n: the pairs (left_id < right_id) with 100 * c >= percent * (left_n + right_n - c).

    rows(id, day, n, held) has each id once; ``held`` is an array without
    repeats, n its size and that of what no other row can hold, c the size of
    two rows' intersection.  The days of a pair are within ``days`` of each
    other; a row without a day or an element has no pair.  Copies are met as one
    class and come back as the pairs that they are.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("day").isNotNull() & (100 * F.size("held") >= percent * F.col("n"))).withColumn("held", F.sort_array("held"))
    rows = readers.stored(rows.select("id", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"), "n", "held", F.unhex(F.sha2(F.to_json(F.struct("n", "held")), 256)).alias("set")), "alike-rows")
    classes = rows.groupBy("set").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("held").alias("held"))
    classes = readers.stored(classes, "alike-classes")
    placed = readers.stored(rows.select("id", "d", "set").join(classes.select("set", "class"), "set").select("class", "d", "id"), "alike-placed")

    # elements of one class alone link nothing; of the others the rarest first, all but one less than must be shared
    elements = readers.stored(classes.select("class", F.explode(F.transform("held", lambda x: F.xxhash64(x))).alias("key")), "alike-elements")
    counts = elements.groupBy("key").agg(F.count(F.lit(1)).alias("in")).where(F.col("in") > 1)
    shared = elements.join(counts, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("in", "key"))).alias("shared"))
    least = F.floor((percent * F.col("n") + 99) / 100).cast("int")
    first = shared.join(classes.select("class", "n"), "class").select("class", "n", F.col("shared")["key"].alias("shared"), (F.size("shared") - least + 1).alias("many")).where("many > 0")
    first = first.select("class", "n", F.explode(F.array_distinct(F.slice("shared", F.lit(1), F.col("many")))).alias("key"))
    posted = readers.stored(first.join(placed.select("class", "d").distinct(), "class"), "alike-posted")

    earlier = posted.select(F.col("class").alias("a"), F.col("n").alias("a_n"), "key", F.posexplode(F.sequence(F.col("d"), F.col("d") + days)).alias("later", "d"))
    met = earlier.join(posted.select(F.col("class").alias("b"), F.col("n").alias("b_n"), "key", "d"), ["key", "d"])
    met = met.where((F.col("a") < F.col("b")) | (F.col("later") > 0) & (F.col("a") != F.col("b"))).where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    before = F.col("d") - F.col("later")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), before).otherwise(F.col("d")).alias("a_d"), F.when(F.col("a") < F.col("b"), F.col("d")).otherwise(before).alias("b_d")]
    met = readers.stored(met.select(*ordered).distinct(), "alike-met")
    one, other = (classes.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), F.col("held").alias(f"{x}_held")) for x in "ab")
    enough = 100 * F.col("c") >= percent * (F.col("a_n") + F.col("b_n") - F.col("c"))
    links = met.select("a", "b").distinct().join(one, "a").join(other, "b").select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_held", "b_held")).cast("long").alias("c")).where(enough)

    # back to rows on the days on which two classes met, and copies on theirs
    at = lambda side, row: placed.select(F.col("class").alias(side), F.col("d").alias(f"{side}_d"), F.col("id").alias(row))
    found = met.join(links, ["a", "b"]).join(at("a", "x"), ["a", "a_d"]).join(at("b", "y"), ["b", "b_d"]).select("x", "y", "c", "a_n", "b_n")
    copies = classes.where("copies > 1").select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("n").alias("b_n"), F.size("held").cast("long").alias("c")).where(enough)
    later = at("a", "x").join(copies, "a").select("a", "x", "c", "a_n", "b_n", F.posexplode(F.sequence(F.col("a_d"), F.col("a_d") + days)).alias("later", "a_d"))
    same = later.join(at("a", "y"), ["a", "a_d"]).where((F.col("later") > 0) | (F.col("x") < F.col("y"))).select("x", "y", "c", "a_n", "b_n")
    swapped = F.col("x") > F.col("y")
    return found.unionByName(same).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "c", F.when(swapped, F.col("b_n")).otherwise(F.col("a_n")).alias("left_n"), F.when(swapped, F.col("a_n")).otherwise(F.col("b_n")).alias("right_n"))
