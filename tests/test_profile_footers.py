"""Footers that do not count nulls."""

import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.operators import profile as P


def test_nulls_of_chunks_without_statistics(spark, tmp_path):
    t = pa.table({"a": pa.array([1.0, None, float("nan"), None]), "name": pa.array(["x", None, "y", "z"]), "gone": pa.array([None] * 4, pa.int64())})
    pq.write_table(t, tmp_path / "1.parquet")
    pq.write_table(t, tmp_path / "2.parquet", write_statistics=False)
    got = {r.column: r for r in P.column_profile(spark, str(tmp_path)).collect()}
    assert {c: (r.rows, r.nulls, r.nans, r.distinct) for c, r in got.items()} == {"a": (8, 4, 2, 1), "name": (8, 2, 0, 3), "gone": (8, 8, 0, 0)}
