from datetime import datetime, timedelta

from tidemark import streaming as S
from tidemark.sources import sinks

SCHEMA = "station_id string, ts timestamp, value double, reading_id long"


def landed(spark, folder, n=200):
    rows = [(f"s{k % 3}", datetime(2024, 1, 1) + timedelta(minutes=7 * k), None if k % 11 == 0 else float(k), k) for k in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.mode("overwrite").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_equals_batch(spark, tmp_path):
    batch = landed(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert run(spark, S.windowed_means(stream, "1 hour", "10 days"), "means", tmp_path) == {tuple(r) for r in S.windowed_means(batch, "1 hour", "10 days").collect()}


def test_sessions_end_at_gaps(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h), 1.0, h) for h in (0, 1, 2, 12, 13)]
    got = S.reading_sessions(spark.createDataFrame(rows, SCHEMA), "6 hours", "1 day").orderBy("first_ts").collect()
    assert [(r.first_ts.hour, r.n) for r in got] == [(0, 3), (12, 2)]


def test_a_rerun_appends_nothing(spark, tmp_path):
    landed(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for k in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        S.append_available(stream, out, str(tmp_path / f"ck{k}"), ["reading_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 200


def test_verified_replace_keeps_the_old_table_on_objection(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.verified_replace(spark.range(5), folder, lambda df: None) is None
    assert sinks.verified_replace(spark.range(9), folder, lambda df: "too many" if df.count() > 5 else None) == "too many"
    assert spark.read.parquet(folder).count() == 5


def test_wide_panel_and_json(spark, tmp_path):
    df = landed(spark, str(tmp_path / "in"), 6)
    assert sinks.wide_panel(df, "ts", "station_id", "value", ["s0", "s1"]).columns == ["ts", "s0", "s1"]
    assert all("value" in r.json for r in sinks.json_report(df).collect())
    sinks.write_partitioned(df, str(tmp_path / "p"), ["station_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
