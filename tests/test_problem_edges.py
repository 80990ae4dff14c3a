"""The problems' queries over empty tables, over tables with a null row in every column, and over doubled tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import problems

TABLES = ["gauge_readings", "gauge_files", "raw_gauge_lines", "catchment_level_shortlist", "subcatchments", "antecedent_labels"]
#: Queries whose rows do not change if every stored row is there twice.
STABLE = ["p1_found", "p1_regions", "p3_found", "p4_found", "p5_found", "p6_found", "p6_table"]


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls", "twice"):
        root = tmp_path_factory.mktemp(kind)
        for name in TABLES:
            df = spark.read.parquet(f"{sf}/{name}.parquet")
            if kind == "empty":
                df = df.limit(0)
            elif kind == "nulls":
                none = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
                # names that operators use inside clash with these on purpose
                df = df.unionByName(none).withColumns({c: F.lit("clash") for c in ("lat", "lon", "leaf", "source", "day", "slot", "level", "line_key", "head")})
            else:
                df = df.unionByName(df)
            df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
        out[kind] = str(root)
    return out


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty_tables_give_no_rows(spark, folders, name):
    got = problems.QUERIES[name](spark, folders["empty"])
    assert got.columns and got.count() == 0


@pytest.mark.parametrize("name", [q for q in sorted(problems.QUERIES) if q.endswith("_found")])
def test_null_rows_and_clashing_columns_change_nothing(spark, sf, folders, name):
    query = problems.QUERIES[name]
    assert rows(query(spark, folders["nulls"])) == rows(query(spark, sf))


@pytest.mark.parametrize("name", STABLE)
def test_repeated_rows_change_nothing(spark, sf, folders, name):
    query = problems.QUERIES[name]
    assert rows(query(spark, folders["twice"])) == rows(query(spark, sf))
