"""Every registered core query against its SQL, and those without SQL for rows and a stable schema."""

import compare
import pytest

from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    assert compare.difference(registry.QUERIES[name](spark, sf), registry.ORACLE[name], sf) == ""


@pytest.mark.parametrize("name", ["diverse_selection", "model_comparison", "ridge_cv", "sampled_pixels", "p2_instants", "p4_grid", "p6_table", "p7_profile"])
def test_rows_come_back(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["station_ref", "gap_start_ms", "n_slots"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
