"""Totals and averages over trailing periods for every calendar day of every entity.

Each daily value is exploded onto every output date it influences, together with the calendar rows that
the day opens (itself and the empty days up to the entity's next row), and one grouping by entity and
date adds them up; calendar rows bring the zeros. The rows of an entity are brought together once, after
repeats are gone, so an entity has at most one row per calendar day and the explosion, the grouping and
the calendar all happen behind that one shuffle.

Values are summed as whole numbers of ``unit`` so that sums are exact and do not depend on their order.

Defined results
---------------
* null, NaN and infinite values count as absent; repeated rows of an entity and day count once (the
  largest value); rows without entity or day are dropped; an empty table gives no rows;
* output runs from an entity's first to its last row, whether or not those rows hold a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def whole_units(value: str, unit: float) -> Column:
    """The value in whole units, null where it is null, NaN or infinite."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.round(F.col(value) * (1.0 / unit)).cast("bigint"))


def trailing_totals(rows: DataFrame, entity: str, day: str, measures: dict[str, tuple[str, float]], periods: list[int]) -> DataFrame:
    """entity, day, has_<m>, and n_<m>_<p>, total_<m>_<p>, avg_<m>_<p> per measure m and period p.

    measures: name -> (column, unit). Totals are whole units of type bigint, averages doubles in units.
    """
    daily = rows.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(
        F.col(entity).alias("e"), F.unix_date(day).alias("d")
    ).agg(*[F.max(whole_units(c, u)).alias(m) for m, (c, u) in measures.items()])
    opened = daily.withColumn("next", F.coalesce(F.lead("d").over(Window.partitionBy("e").orderBy("d")), F.col("d") + 1))
    longest, none = max(periods), F.lit(None).cast("bigint")
    present = reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in measures])
    onto = F.when(
        present,
        F.transform(
            F.sequence(F.lit(0), F.lit(longest - 1)),
            lambda lag: F.struct((F.col("d") + lag).alias("at"), lag.alias("lag"), *[F.col(m).alias(m) for m in measures]),
        ),
    ).otherwise(F.array())
    calendar = F.transform(
        F.sequence(F.col("d"), F.col("next") - 1),
        lambda at: F.struct(at.alias("at"), F.lit(-1).alias("lag"), *[none.alias(m) for m in measures]),
    )
    parts = opened.select("e", F.inline(F.concat(onto, calendar)))
    out = [F.max(F.col("lag") == -1).alias("listed")]
    for m in measures:
        out.append(F.coalesce(F.max((F.col("lag") == 0) & F.col(m).isNotNull()), F.lit(False)).alias(f"has_{m}"))
        for p in periods:
            inside = F.when(F.col("lag").between(0, p - 1), F.col(m))
            out += [F.count(inside).alias(f"n_{m}_{p}"), F.coalesce(F.sum(inside), F.lit(0)).alias(f"total_{m}_{p}")]
    sums = parts.groupBy("e", "at").agg(*out).filter("listed")
    averages = [
        F.try_divide(F.col(f"total_{m}_{p}"), F.col(f"n_{m}_{p}")).alias(f"avg_{m}_{p}") for m in measures for p in periods
    ]
    named = [c for c in sums.columns if c not in ("e", "at", "listed")]
    return sums.select(F.col("e").alias(entity), F.date_from_unix_date("at").alias(day), *named, *averages)
