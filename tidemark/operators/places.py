"""Places of rows in an order over the whole table, without one window over all of it.

Rows are cut into ranges of the order, written once, and numbered inside their range; the driver adds up one
count a range. So no task holds more than a range, whatever the number of rows or the values they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

WITHIN = (1 << 33) - 1


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ranges of the order, each with its __part and its __at inside it; written once, as sampled bounds may differ."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    held = cut_lineage(ranged.withColumn("__id", F.monotonically_increasing_id()))
    return held.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit(WITHIN))}).drop("__id")


def before_ranges(ranged: DataFrame, sums: dict[str, Column]) -> dict[int, dict[str, float]]:
    """For each range the totals of all ranges before it; one row a range comes to the driver."""
    per = ranged.groupBy("__part").agg(*[c.alias(n) for n, c in sums.items()]).orderBy("__part").collect()
    out, so_far = {}, dict.fromkeys(sums, 0)
    for r in per:
        out[r["__part"]] = dict(so_far)
        so_far = {n: so_far[n] + (r[n] or 0) for n in sums}
    out[-1] = so_far  # of the whole table
    return out


def _lookup(before: dict[int, dict[str, float]], name: str) -> Column:
    last = max(before)
    return F.get(F.array(*[F.lit(before.get(k, {}).get(name, 0)) for k in range(last + 1)] or [F.lit(0)]), F.col("__part"))


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds the 0-based place of each row in the order; rows that tie in all of it are numbered as they lie."""
    ranged = in_ranges(rows, order)
    before = before_ranges(ranged, {"n": F.count("*")})
    return ranged.withColumn(name, (_lookup(before, "n") + F.col("__at")).cast("bigint")).drop("__part", "__at")


def running_total(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds the sum of the weights of all rows up to and including each row in the order."""
    ranged = in_ranges(rows, order)
    before = before_ranges(ranged, {"n": F.sum(weight)})
    inside = F.sum(weight).over(Window.partitionBy("__part").orderBy("__at"))
    return ranged.withColumn(name, _lookup(before, "n") + inside).drop("__part", "__at")


def medians(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The exact median of each group's values, from counted values numbered range by range: no task holds a group.

    Nulls do not count, NaN counts as the largest; a group without values and rows without a group give no row.
    """
    counted = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(
        F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")
    ).agg(F.count("*").alias("__k"))
    upto = running_total(counted, ["__g", "__v"], "__k", "__upto")
    sizes = upto.groupBy("__g").agg(F.sum("__k").alias("__n"), F.min(F.col("__upto") - F.col("__k")).alias("__base"))
    placed = upto.join(sizes, "__g").withColumn("__last", F.col("__upto") - F.col("__base"))
    at = lambda place: (F.col("__last") - F.col("__k") <= place) & (place < F.col("__last"))
    lower, upper = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    middle = placed.filter(at(lower) | at(upper)).groupBy("__g").agg(F.avg("__v").alias(name))
    return middle.withColumnRenamed("__g", group)
