from tidemark.operators import drift

BOM = "﻿"


def tables(spark, files):
    lines = [(fid, i, text, "z") for fid, texts in files.items() for i, text in enumerate(texts, 1)]
    order = [(fid, "g", fid, 1) for fid in files]
    return (
        spark.createDataFrame(lines, "file_id long, line_no int, line string, head string"),
        spark.createDataFrame(order, "file_id long, station_ref string, seq_no int, head int"),
    )


FILES = {
    1: [BOM + "#station_no;g", "", "datetime;value;quality_code;quality_ok;remark", "2020-01-01;1.5;254;True;ice", "2020-01-01;1.5;254;True;ice", "2020-01-02;x;31;False;", "2020-01-03;;;;"],
    2: ["datetime,value,Quality Code,valid", "2020-01-04,1.0,31.0,False", "2020-01-05,1.0,254.0"],
    3: ["datetime;value;QC", "2020-01-06;1.0;good", None, "  "],
    4: ["datetime;value;qc;is_good"],
    5: ["datetime;value;qc;ok;door_open", "2020-01-07;2;31;0;True"],
    6: ["datetime;value;battery_v;door_open", "2020-01-08;2;12.5;True"],
}


def test_changes(spark):
    got = {tuple(r) for r in drift.layout_changes(*tables(spark, FILES)).collect()}
    assert got == {
        (2, "quality_code", "retyped"), (2, "quality_ok", "renamed"), (3, "quality_code", "renamed"), (3, "quality_code", "retyped"), (3, "quality_ok", "removed"),
        (4, "quality_ok", "added"), (5, "quality_ok", "renamed"), (6, "quality_code", "removed"), (6, "quality_ok", "removed"),
    }


def test_one_table_with_rescued_fields_and_replay(spark):
    rows = drift.consistent_table(*tables(spark, FILES))
    got = {(r.file_id, r.line_no): r for r in rows.collect()}
    assert len(got) == 8  # the repeated line counts once
    assert (got[1, 4].value, got[1, 4].quality_code, got[1, 4].quality_ok, got[1, 4]._rescued) == (1.5, 254, True, '{"remark":"ice"}')
    assert (got[1, 6].value, got[1, 6]._rescued) == (None, '{"value":"x"}')
    assert (got[2, 3].quality_code, got[2, 3].quality_ok) == (254, None)
    assert got[3, 2].quality_code == 254
    again = {r.file_id: r.battery for r in drift.replay(rows, "battery", "battery_v", "double").collect() if r.battery is not None}
    assert again == {6: 12.5}


def test_unknown_headers_are_taken_by_their_content(spark):
    files = {1: ["datetime;value;qual_word", "d;1;254", "d;2;31"], 2: ["datetime;value;accepted_quality", "d;1;True", "d;2;False"]}
    assert {tuple(r) for r in drift.layout_changes(*tables(spark, files)).collect()} == {(2, "quality_code", "removed"), (2, "quality_ok", "added")}


def test_empty(spark):
    lines, order = tables(spark, FILES)
    assert drift.layout_changes(lines.limit(0), order).count() == 0
    assert drift.consistent_table(lines.limit(0), order.limit(0)).count() == 0


def test_fields_in_any_column_and_behind_any_delimiter(spark):
    files = {1: ["qual_word|datetime|value", "254|d|1", "31|d|2"], 2: ["check_ok\tvalue\tdatetime", "True\t1\td", "False\t2\td"]}
    assert {tuple(r) for r in drift.layout_changes(*tables(spark, files)).collect()} == {(2, "quality_code", "removed"), (2, "quality_ok", "added")}
    rows = {(r.file_id, r.line_no): r for r in drift.consistent_table(*tables(spark, files)).collect()}
    assert (rows[1, 2].quality_code, rows[1, 2].value, rows[2, 3].quality_ok, rows[2, 3]._rescued) == (254, 1.0, False, None)


def test_what_is_rescued_and_what_is_replayed(spark):
    files = {1: ["datetime;value;qc;a;A;quality_ok", "d;1;good;x;y;maybe", "d;2;??;;z;1"]}
    heads, data = drift.split_files(tables(spark, files)[0])
    raw = {r.line_no: r for r in drift.ingest(data).collect()}
    assert [(c.header, c.cell) for c in raw[2]._rescued] == [("qc", "good"), ("a", "x"), ("A", "y"), ("quality_ok", "maybe")] and raw[2].quality_code is None
    rows = {r.line_no: r for r in drift.consistent_table(*tables(spark, files)).collect()}
    assert (rows[2].quality_code, rows[2].quality_ok, rows[2]._rescued) == (254, None, '{"a":"x","quality_ok":"maybe"}')
    assert (rows[3].quality_code, rows[3].quality_ok, rows[3]._rescued) == (None, True, '{"quality_code":"??","a":"z"}')


def test_the_first_of_repeated_lines_and_repeated_rows(spark):
    lines, order = tables(spark, {1: ["datetime;value", "d;1", "d;2", "d;1"]})
    got = drift.consistent_table(lines.unionByName(lines).repartition(5), order).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == [(2, 1.0), (3, 2.0)]
