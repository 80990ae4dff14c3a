"""Which chunks the profile reads, and that the way it takes does not show in its result."""

from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.operators import chunks
from tidemark.operators import profile as P

N = 4000


def table(rng):
    return pa.table({
        "few": pa.array(rng.integers(0, 9, N)), "many": pa.array(rng.permutation(N) * 7919), "one": pa.array([5] * N), "gone": pa.nulls(N, pa.int32()),
        "level": pa.array(np.round(rng.random(N), 1) - 0.0), "hole": pa.array([float("nan") if k % 9 == 0 else k % 5 for k in range(N)]),
        "word": pa.array([None if k % 7 == 0 else f"w{k % 13}é" for k in range(N)]), "yes": pa.array([k % 2 == 0 for k in range(N)]),
        "day": pa.array([date(2020, 1, 1 + k % 28) for k in range(N)]), "at": pa.array([datetime(2020, 1, 1, k % 24) for k in range(N)], pa.timestamp("us", "UTC")),
    })


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    out = {}
    for name, options in {"rich": {}, "plain": {"use_dictionary": False}, "blind": {"write_statistics": False}, "small": {"dictionary_pagesize_limit": 512}, "v2": {"data_page_version": "2.0", "compression": "zstd", "data_page_size": 512}}.items():
        out[name] = tmp_path_factory.mktemp(name)
        for k in range(3):
            pq.write_table(table(np.random.default_rng(k)), out[name] / f"{k}.parquet", row_group_size=1500, **options)
    return out


def sources(spark, folder):
    return {r.column: (r.footer, r.dictionary, r.scan) for r in P.chunk_sources(spark, str(folder)).collect()}


def test_only_chunks_without_sufficient_statistics_are_scanned(spark, folders):
    rich, plain, blind, small = (sources(spark, folders[f]) for f in ("rich", "plain", "blind", "small"))
    assert {c for c, n in rich.items() if n[2]} == {"hole"}
    assert {c for c, n in rich.items() if n[0] == 3 * N} == {"one", "gone", "yes"}
    assert {c for c, n in plain.items() if n[2] == 3 * N} == set(plain) - {"one", "gone", "yes"}
    assert all(n == (0, 0, 3 * N) for n in blind.values())
    assert small["many"][2] >= 9000 and small["few"][1] == 3 * N  # pages beyond a full dictionary are plain


def test_every_way_gives_the_same_profile(spark, folders):
    got = {f: {r.column: r for r in P.column_profile(spark, str(folder)).collect()} for f, folder in folders.items()}
    for f in folders:
        assert got[f] == got["plain"], f
    t = pa.concat_tables([table(np.random.default_rng(k)) for k in range(3)]).to_pandas()
    for c, r in got["rich"].items():
        real = t[c].dropna()
        assert (r.rows, r.distinct) == (3 * N, real.nunique())
        if c in ("few", "many", "level", "hole"):
            assert (r.least_number, r.most_number) == (real.min(), real.max())
    assert got["rich"]["hole"].nans == 3 * sum(k % 9 == 0 for k in range(N)) and got["rich"]["hole"].nulls == 0
    assert (got["rich"]["word"].least_text, got["rich"]["at"].most_text) == ("w0é", "2020-01-01 23:00:00.000000Z")


def test_dictionaries_hold_the_values_of_their_chunk(folders):
    for f in ("rich", "v2"):
        file = pq.ParquetFile(folders[f] / "1.parquet")
        for g in range(file.metadata.num_row_groups):
            for c in ("few", "level", "word", "day", "at"):
                want = set(file.read_row_group(g, columns=[c])[c].drop_null().to_pylist())
                assert set(chunks.dictionary_of(str(folders[f] / "1.parquet"), g, c).to_pylist()) == want


def test_a_column_that_a_file_lacks_is_null_there(spark, tmp_path):
    pq.write_table(pa.table({"load": [1, 1], "a": [0.5, 2.0]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"load": [1, 2]}), tmp_path / "2.parquet")
    assert {r.column: (r.rows, r.nulls) for r in P.column_profile(spark, str(tmp_path)).collect()}["load"] == (4, 0)


def test_row_groups_without_a_value_are_passed_over(spark, tmp_path):
    pq.write_table(pa.table({"load": [1] * 4, "a": pa.nulls(4, pa.float64())}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"load": [2] * 3, "a": [0.5, 0.5, float("nan")]}), tmp_path / "2.parquet")
    counts = P.value_counts(spark, str(tmp_path), "load", [P.Audit("a", 0.0, 1.0, 2)])
    assert {(r.load, r.value, r.n) for r in counts.collect()} == {(1, None, 4), (2, 0.5, 2), (2, None, 1)}
    plan = counts._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a)]" in plan and plan.split("== Physical Plan ==")[1].split("== Initial Plan ==")[0].count("FileScan") == 1  # no scan for the rows of the loads


def test_rows_of_mixed_row_groups_are_scanned(spark, tmp_path):
    pq.write_table(pa.table({"load": pa.array([1, 1, 2, None], pa.int64()), "a": [0.5, None, 3.0, None]}), tmp_path / "1.parquet")
    counts = P.value_counts(spark, str(tmp_path), "load", [P.Audit("a", 0.0, 1.0, 2)])
    assert {(r.load, r.value, r.n, r.possible_n) for r in counts.collect()} == {(1, 0.5, 1, 1), (1, None, 1, 0), (2, 3.0, 1, 0), (None, None, 1, 0)}
