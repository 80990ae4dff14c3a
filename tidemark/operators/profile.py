"""Data quality profile of every column of a table of Parquet files, and of the loads that stand out.

Decisions fall chunk by chunk (one column of one row group), in tasks that Spark spreads over row groups:

* the footer settles rows and nulls, and the extrema of all but floats, whose NaN it leaves out; a chunk
  whose extrema are equal, or that is all null, is settled by it wholly;
* if all pages of a chunk point into a dictionary, the dictionary page gives its distinct values, and
  with them the extrema of floats; only a float dictionary that holds NaN leaves their number open;
* the other chunks are scanned, and no other. ``chunk_sources`` counts which way each chunk went.

The loads' tests need the number of rows a value, which no footer holds. There footers give the rows of each
load, if every row group holds but one, and let Spark's reader pass over row groups that hold no value of an
audited column; the values of the others are scanned, one audited column at a time, and counted by load at
once, by partial aggregation. The largest difference of two distribution functions is found by ranges of values: running totals of at most
``RANGES`` ranges, then windows inside a range.

Defined results
---------------
* NaN counts as null for the loads, on its own in the profile; infinite values are values, never possible ones;
* a null load is profiled as its own load but never a finding; an empty table gives no rows;
* repeated rows all count, for they are what is stored;
* a column that some files lack is null there; nested and binary columns have no profile;
* a writer that keeps entries in a dictionary that no row uses would add them to the distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import chunks
from tidemark.session import cut_lineage, small_side

RANGES = 256
#: Tasks that read files' footers or row groups at most.
MOST_TASKS = 10_000
NULL_EXCESS, DISTINCT_SHARE, SHIFT = 0.2, 0.5, 0.4


@dataclass(frozen=True)
class Audit:
    """What a column may hold: low..high (a number or the name of a column), with so many decimals."""

    column: str
    low: float
    high: float | str
    decimals: int


FOOTER = "path string, row_group int, column string, kind string, rows long, nulls long, least string, most string, dictionary boolean, load_lo string, load_hi string"


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """path of every Parquet file of a table, as Spark's own listing has them; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")


def read_footers(spark: SparkSession, path: str, load: str | None) -> DataFrame:
    """One row per column chunk, from the footers alone. Files are spread over tasks by path."""

    def footers(batches):
        for pdf in batches:
            out = []
            for uri in pdf["path"]:
                meta = chunks.opened(uri)[0].metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    mine = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
                    of_load = mine[load].statistics if load in mine else None
                    span = (str(of_load.min), str(of_load.max)) if of_load is not None and of_load.has_min_max and not of_load.null_count else (None, None)
                    for column, chunk in mine.items():
                        s = chunk.statistics
                        known = s is not None and s.has_min_max
                        out.append((
                            uri, g, column, chunk.physical_type, group.num_rows, s.null_count if s is not None and s.has_null_count else None,
                            str(s.min) if known else None, str(s.max) if known else None, bool(chunk.has_dictionary_page), *span,
                        ))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOOTER.split(", ")])

    files = parquet_files(spark, path)
    return files.repartition(_tasks(files), "path").mapInPandas(footers, FOOTER)


def sufficient(column: Column | str = "column") -> Column:
    """Whether a chunk's footer alone settles nulls and extrema of its one load."""
    one_load = F.col("load_lo").isNotNull() & (F.col("load_lo") == F.col("load_hi"))
    exact = F.col("nulls").isNotNull() & ((F.col("nulls") == F.col("rows")) | ~F.col("kind").isin("FLOAT", "DOUBLE"))
    return one_load & exact


def load_rows(table: DataFrame, load: str, foot: DataFrame) -> DataFrame:
    """load and n, its rows: from the footers if every row group holds one load, else from a scan of that column alone."""
    own = foot.filter(F.col("column") == load)
    one = F.coalesce(F.col("load_lo") == F.col("load_hi"), F.lit(False))
    if own.filter(~one).isEmpty() and not own.isEmpty():
        return own.groupBy(F.col("load_lo").cast(dict(table.dtypes)[load]).alias("load")).agg(F.sum("rows").alias("n"))
    return table.groupBy(F.col(load).alias("load")).agg(F.count("*").alias("n"))


def value_counts(spark: SparkSession, path: str, load: str, audits: list[Audit]) -> DataFrame:
    """column, load, value (null for nulls and NaN), n, possible_n, rough (more decimals than allowed).

    Each audited column is scanned for its values alone, a filter that the reader holds against the footers, so
    that row groups which are all null there are not read. Nulls and NaN are what a load's rows leave over.
    """
    table = spark.read.parquet(path)
    rows = load_rows(table, load, cut_lineage(read_footers(spark, path, load)))
    counted = []
    for a in audits:
        v = F.col(a.column).cast("double") + 0.0
        top = F.col(a.high) if isinstance(a.high, str) else F.lit(a.high)
        fine = F.coalesce((v >= a.low) & ((v <= top) | top.isNull()) & (F.abs(v) != float("inf")), F.lit(False))
        held = table.filter(F.col(a.column).isNotNull() & ~F.isnan(a.column)).select(F.col(load).alias("load"), v.alias("value"), fine.alias("fine"))
        held = held.groupBy("load", "value").agg(F.count("*").alias("n"), F.count_if("fine").alias("possible_n"))
        counted.append(held.select(F.lit(a.column).alias("column"), "*"))
    none, zero = F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("possible_n")
    both = F.array(F.struct("value", "n", "possible_n"), F.struct(none, (-F.col("n")).alias("n"), zero))
    parts = reduce(DataFrame.unionByName, counted).select("column", "load", F.inline(both))
    whole = rows.select(F.explode(F.array(*[F.lit(a.column) for a in audits])).alias("column"), "load", none, "n", zero)
    merged = parts.unionByName(whole).groupBy("column", "load", "value").agg(F.sum("n").alias("n"), F.sum("possible_n").alias("possible_n")).filter("n > 0")
    scale = F.try_element_at(F.create_map(*[F.lit(x) for a in audits for x in (a.column, 10.0**a.decimals)]), "column")
    w = F.col("value")
    rough = F.coalesce(F.when(F.abs(w) != float("inf"), F.rint(w * scale) / scale != w), F.lit(False))
    return merged.withColumn("rough", rough)


def _tasks(units: DataFrame) -> int:
    """Tasks for files or row groups; their rows are tiny, so that their bytes would gather them in one."""
    return max(1, min(units.count(), MOST_TASKS))


def load_profile(counts: DataFrame) -> DataFrame:
    """One row per column and load: rows, nulls, distinct values, finite extrema, values out of range or too fine, and shift.

    The counts are written once, as they are read several times and are a fraction of the table.
    """
    counts = cut_lineage(counts)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    facts = counts.groupBy("column", "load").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"), F.min(finite).alias("least"), F.max(finite).alias("most"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n") - F.col("possible_n"))), F.lit(0)).alias("impossible"),
        F.coalesce(F.sum(F.when(F.col("rough"), F.col("possible_n"))), F.lit(0)).alias("rough"),
    )
    return facts.join(distribution_shift(counts), (facts["column"] == F.col("s_column")) & facts["load"].eqNullSafe(F.col("s_load")), "left").drop("s_column", "s_load")


def distribution_shift(counts: DataFrame) -> DataFrame:
    """s_column, s_load and the largest difference between a load's distribution function and that of all other loads.

    Between two values of a load its own function rests while the others' only grow, so the largest
    difference is found at the load's values or just before them.
    """
    v = counts.filter("possible_n > 0").select("column", "load", "value", F.col("possible_n").alias("n"))
    cuts = v.groupBy("column").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
    v = v.join(small_side(cuts), "column").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    totals = v.groupBy("column", "load").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("all_total", F.sum("total").over(Window.partitionBy("column")))
    per_range = v.groupBy("column", "range", "load").agg(F.sum("n").alias("n"))
    # running totals before each range, of the column and of each of its loads: loads x RANGES rows at most
    ranges = per_range.groupBy("column", "range").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    all_before = ranges.select("column", "range", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("all_before"))
    own = Window.partitionBy("column", "load").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    own_before = per_range.select("column", "range", F.col("load"), F.coalesce(F.sum("n").over(own), F.lit(0)).alias("own_before"))
    before = own_before.join(all_before, ["column", "range"]).withColumnRenamed("load", "b_load")
    before = before.join(totals.withColumnRenamed("load", "t_load"), ["column"]).filter(F.col("t_load").eqNullSafe(F.col("b_load"))).drop("t_load")
    inside = Window.partitionBy("column", "range").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = Window.partitionBy("column", "range", "load").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("column", "range", "value")
    steps = v.withColumns({"all_upto": F.sum("n").over(inside), "own_upto": F.sum("n").over(mine), "tied": F.sum("n").over(ties)})
    steps = steps.join(before.withColumnsRenamed({"column": "b_column", "range": "b_range"}), (
        F.col("column") == F.col("b_column")) & (F.col("range") == F.col("b_range")) & F.col("load").eqNullSafe(F.col("b_load")))
    own_x, all_x = F.col("own_before") + F.col("own_upto"), F.col("all_before") + F.col("all_upto")
    others = F.col("all_total") - F.col("total")
    gap = lambda o, a: F.abs(o / F.col("total") - F.try_divide(a - o, others))
    worst = F.greatest(gap(own_x, all_x), gap(own_x - F.col("n"), all_x - F.col("tied")))
    return steps.groupBy(F.col("column").alias("s_column"), F.col("load").alias("s_load")).agg(F.max(worst).alias("shift"))


def odd_loads(profile: DataFrame) -> DataFrame:
    """column, load and finding of the loads that stand out among the loads of the column."""
    over = Window.partitionBy("column")
    p = profile.filter("load is not null").withColumn("null_share", F.col("nulls") / F.col("rows"))
    p = p.withColumns({"usual_share": F.median("null_share").over(over), "usual_distinct": F.median("distinct").over(over)})
    many_nulls = F.col("null_share") - F.col("usual_share") > NULL_EXCESS
    found = F.array_compact(F.array(
        F.when(many_nulls, "nulls"), F.when(F.col("impossible") > 0, "range"), F.when(F.col("rough") > 0, "pattern"),
        F.when(~many_nulls & (F.col("distinct") < DISTINCT_SHARE * F.col("usual_distinct")), "distinct"),
        F.when(~many_nulls & (F.coalesce("shift", F.lit(0.0)) > SHIFT), "shift"),
    ))
    return p.select("column", "load", F.explode(found).alias("finding"))


FACTS = "column string, source string, rows long, nulls long, nans long, whole long, real double, text string"


def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per chunk a row with its source (footer, dictionary or scan) and counts, and rows with its distinct values."""
    flat = [c for c, t in spark.read.parquet(path).dtypes if not t.startswith(("array", "struct", "map", "binary"))]
    units = cut_lineage(read_footers(spark, path, None).select("path", "row_group").distinct())

    def facts(batches):
        for batch in batches:
            for uri, group in zip(batch["path"].to_pylist(), batch["row_group"].to_pylist()):
                yield from _group_facts(uri, group, flat)

    return units.repartition(_tasks(units), "path", "row_group").mapInArrow(facts, FACTS)


FACTS_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in FACTS.split(", ")])


def _facts(n: int, **columns) -> pa.RecordBatch:
    """n rows of facts; a single value stands for all of them, what is not given is null."""
    full = {c: columns.get(c) for c in FACTS_SCHEMA.names}
    arrays = [v if isinstance(v, pa.Array) else pa.array([v] * n, FACTS_SCHEMA.field(c).type) for c, v in full.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=FACTS_SCHEMA)


def _group_facts(uri: str, group: int, flat: list[str]):
    file, _ = chunks.opened(uri)
    meta = file.metadata.row_group(group)
    here = {meta.column(c).path_in_schema: meta.column(c) for c in range(meta.num_columns)}

    def values(column: str, found: pa.Array) -> pa.RecordBatch:
        sort, found = chunks.typed(found)
        if sort == "real":
            found = found.filter(pc.invert(pc.is_nan(found)))
        return _facts(len(found), column=column, **{sort: found})

    rest = []
    for column in flat:
        if column not in here:
            yield _facts(1, column=column, source="footer", rows=meta.num_rows, nulls=meta.num_rows, nans=0)
            continue
        s, kind = here[column].statistics, file.schema_arrow.field(column).type
        nulls = s.null_count if s is not None and s.has_null_count else None
        exact = nulls is not None and s.has_min_max and not pa.types.is_floating(kind) and not pa.types.is_decimal(kind)
        if nulls == meta.num_rows or (exact and (s.min == s.max or pa.types.is_boolean(kind))):
            yield _facts(1, column=column, source="footer", rows=meta.num_rows, nulls=nulls, nans=0)
            if nulls < meta.num_rows:
                yield values(column, pa.array(list({s.min, s.max}), kind))
            continue
        entries = chunks.dictionary_of(uri, group, column) if nulls is not None else None
        if entries is None or (pa.types.is_floating(kind) and pc.any(pc.is_nan(entries)).as_py()):
            rest.append(column)
            continue
        yield _facts(1, column=column, source="dictionary", rows=meta.num_rows, nulls=nulls, nans=0)
        yield values(column, entries)
    for batch in chunks.scanned(uri, group, rest) if rest else ():
        for column in rest:
            found = batch[column].combine_chunks()
            nans = pc.sum(pc.is_nan(found)).as_py() or 0 if pa.types.is_floating(found.type) else 0
            yield _facts(1, column=column, source="scan", rows=len(found), nulls=found.null_count, nans=nans)
            yield values(column, pc.unique(found.drop_null()))


def column_profile(spark: SparkSession, path: str) -> DataFrame:
    """Every flat column: rows, nulls, NaN, distinct values (NaN is none), extrema as text and, where they are finite numbers, as numbers."""
    facts = chunk_facts(spark, path)
    per_value = facts.groupBy("column", "whole", "real", "text").agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", "nans")])
    number = F.coalesce(F.col("whole").cast("double"), "real")
    finite = F.when(F.abs(number) < float("inf"), number)
    shown = lambda f: F.coalesce(f("whole").cast("string"), f("real").cast("string"), f("text"))
    return per_value.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("nans").alias("nans"),
        F.count_if(F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))).alias("distinct"),
        shown(F.min).alias("least"), shown(F.max).alias("most"), F.min(finite).alias("least_number"), F.max(finite).alias("most_number"),
        F.min("text").alias("least_text"), F.max("text").alias("most_text"),
    ).filter("rows is not null")


def chunk_sources(spark: SparkSession, path: str) -> DataFrame:
    """Per column how many rows were settled by the footer, by a dictionary and by a scan of their chunk."""
    facts = chunk_facts(spark, path).filter("source is not null")
    return facts.groupBy("column").pivot("source", ["footer", "dictionary", "scan"]).agg(F.sum("rows")).na.fill(0)
