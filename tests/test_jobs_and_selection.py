"""Work units, selection, encoders, sinks and what the entry point does without the text operators."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import encoders
from tidemark.operators import drift
from tidemark.operators import features as X
from tidemark.operators import jobs as J
from tidemark.operators import raster as P
from tidemark.operators import selection as C
from tidemark.sources import archives, readings, sinks


def test_readiness_by_manifest_or_by_images(spark):
    units = spark.createDataFrame([(k,) for k in "abcde"], "u string")
    manifest = spark.createDataFrame([("a", "DOWNLOADED"), ("b", "DOWNLOADED"), ("b", "queued"), ("c", None)], "u string, status string")
    images = spark.createDataFrame([("b", "s1")] * 9 + [("d", "s1")] * 4 + [("d", "s2")] * 5 + [("e", "s1")] * 4 + [("e", "s2")] * 4, "u string, sensor string")
    got = {r.u: r.ready for r in J.ready_units(units, manifest, images, ["u"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_a_breaker_stops_at_the_first_run_of_failures(spark):
    log = spark.createDataFrame([("a", k, bad) for k, bad in enumerate([True, True, False, True, None, True, True, True, True])] + [("b", 0, True)], "g string, k int, bad boolean")
    assert [(r.g, r.k) for r in J.breaker_stops(log, "g", ["k"], F.col("bad"), 3).collect()] == [("a", 7)]
    assert [r.k for r in J.submissions(log.filter("g = 'a'"), ["k"], 4).collect()] == [0, 1, 2, 3]


def test_selection_with_includes_and_reserve(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i:02d}", f"r{i % 3}", float(rng.random()), float(rng.normal()), float(rng.normal())) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, region string, q double, x double, y double")
    far = lambda a, b: round(np.hypot(a[3] - b[3], a[4] - b[4]) + (a[1] != b[1]), 6)
    for include in ((), ("k07", "gone", "k03")):
        chosen = [r for k in include for r in rows if r[0] == k] or [max(rows, key=lambda r: (r[2], r[0]))]
        while len(chosen) < 8:
            chosen.append(max((r for r in rows if r not in chosen), key=lambda r: (min(far(r, c) for c in chosen), r[2], r[0])))
        got = C.farthest_points(df, "k", ["x", "y"], "region", "q", 6, 2, include).orderBy("rank").collect()
        assert [r.k for r in got] == [c[0] for c in chosen] and [r.role for r in got] == ["selected"] * 6 + ["reserve"] * 2
    assert C.farthest_points(df.limit(0), "k", ["x", "y"], "region", "q", 3).count() == 0
    assert C.farthest_points(df.limit(2), "k", ["x", "y"], "region", "q", 3).count() == 2


def test_missing_features_score_nothing_or_the_median(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 9.0), (3, None), (4, float("nan"))], "k int, v double")
    plain = {r.k: r.z_v for r in C.standard_scores(df, ["v"]).collect()}
    full = {r.k: r.z_v for r in C.standard_scores(df, ["v"], ("v",)).collect()}
    v = np.array([1.0, 3, 9, 3, 3])
    assert plain[3] == plain[4] == 0 and np.allclose([full[k] for k in range(5)], (v - v.mean()) / v.std())


def test_encoders_take_batches_and_plug_in(spark, monkeypatch):
    rows = [(0, [1.0, 3.0, float("nan"), float("nan")]), (1, None), (2, [1.0, 2.0, 3.0]), (3, []), (4, [1.0, None, 4.0, 8.0])]
    got = {r.k: r.e for r in spark.createDataFrame(rows, "k int, p array<double>").select("k", encoders.encode("p", 2).alias("e")).collect()}
    assert got == {0: [2.0, None, 1.0, None], 1: None, 2: None, 3: None, 4: [1.0, 6.0, 0.0, 2.0]}


def test_gram_and_health_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (200, 5))
    x[:, 4] = 2.0
    rows = [("a" if k % 3 else "b", x[k].tolist()) for k in range(200)] + [("a", [1.0, None, 1.0, 1.0, 1.0]), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(6)
    got = {(r.g, r.i, r.j): (r.mean_product, r.n) for r in X.gram(df, ["g"], "v").collect()}
    mine = x[[bool(k % 3) for k in range(200)]]
    assert got["a", 1, 3] == (pytest.approx((mine[:, 1] * mine[:, 3]).mean()), len(mine)) and len(got) == 30
    health = X.vector_health(df, "v").first()
    lam = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert (health.n, health.dead_share) == (200, 0.2) and health.pc1 == pytest.approx(lam[0] / lam.sum())
    assert health.components == np.searchsorted(np.cumsum(lam / lam.sum()), 0.9) + 1
    assert health.relative_spread == pytest.approx(np.sqrt(x.var(0).sum()) / np.linalg.norm(x, axis=1).mean())
    assert X.vector_health(df.limit(0), "v").count() == 0


def test_phases_that_do_not_repeat_take_the_plain_mean(spark):
    cells = spark.createDataFrame([("a", k % 2, 0, float(k * k)) for k in range(6)], "s string, ph int, pos int, x double")
    z = [r.z for r in X.normalise(cells.withColumn("ph", X.phase(F.lit("2020-01-01").cast("date"), repeats=False)), "s", "ph").orderBy("x").collect()]
    v = np.arange(6) ** 2.0
    assert np.allclose(z, (v - v.mean()) / v.std())


def test_causal_bins_agree_with_all_pairs(spark):
    from datetime import date, timedelta

    rng = np.random.default_rng(2)
    start = date(2019, 1, 1)
    seen = [("a", start + timedelta(days=int(k)), 0, float(k)) for k in rng.choice(900, 120, replace=False)]
    targets = [("a", start + timedelta(days=int(k))) for k in (100, 361, 620, 899)]
    got = {(r.target_day, r.step): (r.value, r.n) for r in P.temporal_bins(spark.createDataFrame(targets, "site string, target_day date"), spark.createDataFrame(seen, "site string, day date, series int, v double")).collect()}
    want = {}
    for _, t in targets:
        for _, day, _, v in seen:
            if 0 <= (age := (t - day).days) < 360:
                want.setdefault((t, 11 - age // 30), []).append(v)
    assert got == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in want.items()}


def test_replacing_keeps_a_table_at_every_step(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.verified_replace(spark.range(3), folder, lambda df: None) is None
    assert sinks.verified_replace(spark.range(4), folder, lambda df: None) is None
    assert spark.read.parquet(folder).count() == 4
    assert sinks.verified_replace(spark.range(9), folder, lambda df: "no") == "no"
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # nothing is left beside it
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if a run had ended between its two renames
    assert sinks.verified_replace(spark.range(9), folder, lambda df: "no") == "no"
    assert spark.read.parquet(folder).count() == 4


def test_a_fault_in_the_text_operators_is_no_missing_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(sum(q.startswith('p8') for q in e.queries()))"]
    run = lambda: subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    if (root / "tidemark" / "llm").exists():
        assert run().stdout.strip() != "0"
        (tmp_path / "tidemark" / "llm" / "registry.py").write_text("import nothing_of_this_name\n")
        assert "nothing_of_this_name" in run().stderr
        shutil.rmtree(tmp_path / "tidemark" / "llm")
    assert run().stdout.strip() == "0"


def test_members_of_archives_by_suffix(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/DATA.TSValues.CSV", "\ufeff#k;v\ndatetime;value\n2020;1.5\n")
        z.writestr("readme.txt", "no")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "no")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    (tmp_path / "d.csv").write_text("no archive either")
    lines = archives.archive_lines(spark, str(tmp_path), ".tsvalues.csv")
    got = lines.collect()
    assert sorted((r.line_no, r.line) for r in got if r.error is None) == [(1, "\ufeff#k;v"), (2, "datetime;value"), (3, "2020;1.5")]
    assert sorted(r.path[-5:] for r in got if r.error) == ["b.zip", "c.zip"]
    table = drift.consistent_table(archives.with_file_ids(lines), spark.createDataFrame([], "file_id long, station_ref string, seq_no int"))
    assert [(r.datetime, r.value) for r in table.collect()] == [("2020", 1.5)]


def test_preferred_files_and_files_without_data(spark):
    files = spark.createDataFrame([("a", "wl_a_1.csv"), ("a", "best_a.csv"), ("b", "wl_b_2.csv"), ("b", "wl_b_1.csv"), ("c", "other.csv"), (None, "wl_1.csv")], "st string, f string")
    got = {r.st: (r.f, r.priority) for r in readings.preferred_file(files, "st", "f", ["^best_{station}", r"^wl_{station}_\d"]).collect()}
    assert got == {"a": ("best_a.csv", 0), "b": ("wl_b_1.csv", 1)}
    lines = spark.createDataFrame([(1, 1, "#k;v"), (1, 2, "datetime;value"), (2, 1, "datetime;value"), (2, 2, "d;1"), (3, 1, None)], "file_id int, line_no int, line string")
    assert {r.file_id: (r.form, r.n_data, r.status) for r in drift.file_status(lines).collect()} == {1: ("headed", 0, "no_data"), 2: ("plain", 1, "ok")}


def test_sensors_that_units_lack(spark):
    units = spark.createDataFrame([(k,) for k in "abc"], "u string")
    have = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s9"), ("b", None)], "u string, s string")
    assert {r.u: (r.missing, r.complete) for r in J.complete_over(units, have, ["u"], "s", ["s1", "s2"]).collect()} == {"a": ("", True), "b": ("s1", False), "c": ("s1,s2", False)}
