"""Medians of groups from ranges of counted values, against numpy."""

import numpy as np
import pytest

from tidemark.operators.features import mad_outliers
from tidemark.operators.places import medians


@pytest.mark.parametrize("distinct", [3, 1000])
def test_medians_of_uneven_groups(spark, distinct):
    rng = np.random.default_rng(distinct)
    groups = np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 40, 3000).astype(str))
    values = rng.integers(-distinct, distinct, 3000) / 7
    rows = list(zip(groups.tolist(), values.tolist())) + [("empty", None), ("hot", None), (None, 1.0), ("one", 2.5), ("two", 1.0), ("two", 2.0)]
    got = {r["g"]: r["m"] for r in medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", "m").collect()}
    held = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows if g is not None}}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in held.items() if v})


def test_medians_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert medians(empty, "g", "v", "m").count() == 0
    assert mad_outliers(empty, "g", "v").count() == 0


def test_outliers_keep_rows_without_value(spark):
    rows = [("a", float(v)) for v in [1, 2, 2, 3, 3, 3, 4, 4, 90]] + [("a", None), ("b", None), (None, 5.0)]
    got = mad_outliers(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert sorted((r["g"], r["v"] or 0.0) for r in got) == sorted((g, v or 0.0) for g, v in rows if g)
    assert [r["v"] for r in got if r["outlier"]] == [90.0]
    assert all(r["score"] is None and r["outlier"] is None for r in got if r["v"] is None)
