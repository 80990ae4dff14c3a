import numpy as np
import pandas as pd
import pytest

from tidemark.operators import profile as P

AUDITS = [P.Audit("a", 0.0, 1.0, 2), P.Audit("b", 0.0, "top", 2)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    out = []
    for load in range(6):
        n = 400
        a, b = np.round(rng.random(n), 2), np.round(rng.random(n) * 5, 2)
        if load == 1:
            a[:200] = np.nan
        if load == 2:
            a[0], b[0] = 1.5, np.inf
        if load == 3:
            a[5], b[:] = 0.123, 2.5
        if load == 4:
            a = np.round(a * 0.4 + 0.6, 2)
        out.append(pd.DataFrame({"load": load, "a": a, "b": b, "top": 5.0, "name": [f"n{i % 7}" for i in range(n)]}))
    df = pd.concat(out)
    where = str(tmp_path_factory.mktemp("profile") / "t.parquet")
    sdf = spark.createDataFrame(df)
    sdf.coalesce(1).write.parquet(where)
    spark.createDataFrame([(6, None, None, 5.0, None)] * 50, sdf.schema).coalesce(1).write.mode("append").parquet(where)
    return where


def test_loads_that_stand_out(spark, path):
    got = {tuple(r) for r in P.odd_loads(P.load_profile(P.value_counts(spark, path, "load", AUDITS))).collect()}
    assert got == {("a", 1, "nulls"), ("a", 6, "nulls"), ("b", 6, "nulls"), ("a", 2, "range"), ("b", 2, "range"), ("a", 3, "pattern"), ("b", 3, "distinct"), ("b", 3, "shift"), ("a", 4, "shift"), ("a", 4, "distinct")}


def test_shift_is_the_largest_difference(spark, path):
    rows = spark.read.parquet(path).toPandas()
    got = {(r.s_column, r.s_load): r.shift for r in P.distribution_shift(P.value_counts(spark, path, "load", AUDITS)).collect()}
    for load in range(6):
        ok = rows[rows["a"].between(0, 1)]
        mine, rest = np.sort(ok.loc[ok["load"] == load, "a"]), np.sort(ok.loc[ok["load"] != load, "a"])
        at = np.unique(ok["a"])
        want = np.abs(np.searchsorted(mine, at, side="right") / len(mine) - np.searchsorted(rest, at, side="right") / len(rest)).max()
        assert np.isclose(got["a", load], want)


def test_profile_of_every_column(spark, path):
    got = {r.column: r for r in P.column_profile(spark, path).collect()}
    assert (got["a"].rows, got["a"].nulls, got["a"].nans) == (2450, 50, 200)
    assert (got["name"].distinct, got["name"].least, got["name"].most, got["name"].nulls) == (7, "n0", "n6", 50)
    assert (got["load"].distinct, got["b"].most) == (7, "Infinity")


def test_all_null_chunks_are_settled_by_their_footer(spark, path):
    foot = P.read_footers(spark, path, "load").filter("column = 'a'")
    assert foot.filter(P.sufficient()).count() == 1


def test_empty_table(spark, tmp_path):
    where = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "load int, a double, b double, top double").write.parquet(where)
    assert P.odd_loads(P.load_profile(P.value_counts(spark, where, "load", AUDITS))).count() == 0
