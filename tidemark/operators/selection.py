"""Station-to-polygon matching results, eligibility and a diverse choice of catchments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.places import medians
from tidemark.session import cut_lineage


def match_flags(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with whether the right side has their key; the right side is reduced to its keys first."""
    keys = right.select(F.col(key).alias("__k")).filter("__k is not null").distinct()
    return left.join(keys, F.col(key) == F.col("__k"), "left").withColumn("matched", F.col("__k").isNotNull()).drop("__k")


def only_in_either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side that the other lacks, with the side that has them."""
    a = left.select(key).distinct().join(right, key, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(key).distinct().join(left, key, "left_anti").withColumn("side", F.lit("right")))


def meets_thresholds(rows: DataFrame, days: float = 5 * 365, pct: float = 70, gap: float = 60) -> DataFrame:
    """Span, completeness and longest gap within bounds; a null anywhere fails."""
    ok = (F.col("span_days") >= days) & (F.col("completeness_pct") >= pct) & (F.col("max_gap_days") <= gap)
    return rows.withColumn("meets", F.coalesce(ok, F.lit(False)))


def eligibility(rows: DataFrame, rules: dict[str, object], forced: Column | None = None) -> DataFrame:
    """Reasons (array) for which a row fails; a rule that is null fails, an empty array is eligible, and so is a forced row."""
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    ok = F.size("reasons") == 0
    return rows.withColumn("reasons", F.array_compact(F.array(*failed))).withColumn("eligible", ok if forced is None else ok | F.coalesce(forced, F.lit(False)))


def best_per_group(rows: DataFrame, group: str, order: list) -> DataFrame:
    """The row of each group that comes first by ascending keys, with the number of candidates, by partial aggregation."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(F.col(group).alias("__g")).agg(first, F.count("*").alias("candidates")).select("row.*", "candidates")


def standard_scores(rows: DataFrame, columns: list[str], filled: tuple[str, ...] = ()) -> DataFrame:
    """z scores with population deviation; deviation 0 counts as 1, nulls score 0, or the median's score where ``filled``.

    A few numbers a column come to the driver.
    """
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double")) for c in columns}
    if filled:
        middle = {c: medians(rows.select(F.lit(0).alias("all"), finite[c].alias("v")), "all", "v", "m").first() for c in filled}
        finite |= {c: F.coalesce(finite[c], F.lit(m["m"] if m else None).cast("double")) for c, m in middle.items()}
    facts = rows.agg(*[f(finite[c]).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return rows.withColumns({
        f"z_{c}": F.coalesce((finite[c] - F.lit(facts[f"m_{c}"])) / F.lit(facts[f"s_{c}"] or 1.0), F.lit(0.0)) for c in columns
    })


def farthest_points(
    rows: DataFrame, key: str, coords: list[str], region: str, quality: str, n: int, reserve: int = 0, include: tuple[str, ...] = ()
) -> DataFrame:
    """key, rank and role (selected, or reserve after the first n) of rows chosen greedily, each the furthest from those chosen.

    Another region adds 1 to a distance. Starts with the included keys that there are, in their order, else with
    the best quality; ties go to quality, then key. Every round is one pass over the narrow rows, written once,
    that measures each row against all chosen so far; only the chosen row reaches the driver.
    """
    held = cut_lineage(rows.select(key, region, quality, *coords))
    wanted = {r[key]: r for r in held.filter(F.col(key).isin(list(include))).orderBy(key).collect()} if include else {}
    chosen = [wanted[k] for k in dict.fromkeys(include) if k in wanted]

    def far(c) -> Column:
        apart = F.sqrt(sum(((F.col(x) - F.lit(float(c[x]))) ** 2 for x in coords), F.lit(0.0)))
        return apart + F.when(F.col(region).eqNullSafe(F.lit(c[region])), 0.0).otherwise(1.0)

    while len(chosen) < n + reserve:
        d = F.least(*[far(c) for c in chosen], F.lit(float("inf"))) if chosen else F.lit(float("inf"))
        best = F.struct(F.round(d, 6).alias("d"), F.col(quality).alias("q"), F.struct(key, region, *coords).alias("row"))
        left = held.filter(~F.col(key).isin([c[key] for c in chosen])) if chosen else held
        top = left.agg(F.max(best).alias("b")).first()["b"]
        if top is None:
            break
        chosen.append(top["row"])
    ranked = [(c[key], i, "selected" if i <= n else "reserve") for i, c in enumerate(chosen, 1)]
    return rows.sparkSession.createDataFrame(ranked, f"{key} string, rank int, role string")
