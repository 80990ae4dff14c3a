"""Queries of the numbered problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, implausible, profile, regular_grid, rolling, spatial, timestamps
from tidemark.plans.instants_sql import INSTANTS
from tidemark.plans.tidy import near, tidy
from tidemark.session import cut_lineage, table

QUARTER_S = 900
LEVEL_LOW, LEVEL_HIGH = 0.0, 125.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.restated_instants(table(spark, d, "gauge_readings"), table(spark, d, "gauge_files"))


def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with its instant, or null."""
    readings = table(spark, d, "gauge_readings").select("reading_id", "file_id", "line_no", "station_ref", "datetime", "ingested_at")
    all_ = timestamps.to_instants(readings, table(spark, d, "gauge_files"))
    return all_.select("reading_id", F.floor(F.col("utc_us") / 1000).cast("bigint").alias("utc_ms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "antecedent_labels").select("station_id", "label_date", "mean_level", "standardized_anomaly", "quality_code")
    cases = implausible.flag_implausible(
        rows, "station_id", "label_date", "mean_level", "standardized_anomaly", "quality_code", LEVEL_LOW, LEVEL_HIGH
    )
    return cases.select("station_id", F.date_format("label_date", "yyyy-MM-dd").alias("label_date"), "field_name")


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "gauge_readings").select(
        "reading_id", "file_id", "line_no", "station_ref", "datetime", "value", "ingested_at"
    )
    placed = timestamps.to_instants(readings, table(spark, d, "gauge_files"), only=F.col("value").between(LEVEL_LOW, LEVEL_HIGH))
    return regular_grid.fill_slots(placed, "station_ref", "utc_us", "value", QUARTER_S, LEVEL_LOW, LEVEL_HIGH)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    holes = regular_grid.smoothed_runs(_quarters(spark, d), QUARTER_S, holes_only=True).filter("missing")
    return holes.select(
        F.col("source").alias("station_ref"), (F.col("slot") * (QUARTER_S * 1000)).alias("gap_start_ms"), "n_slots"
    )


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid.to_grid(regular_grid.smoothed_runs(_quarters(spark, d), QUARTER_S), QUARTER_S)
    return grid.withColumnRenamed("source", "station_ref")


def p4_seams(spark: SparkSession, d: str) -> DataFrame:
    """Filled quarters of each gauge, and how many the windows of the smoother level otherwise than the unbroken one."""
    return regular_grid.seams(cut_lineage(_quarters(spark, d)), QUARTER_S).withColumnRenamed("source", "station_ref")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per gauge the grid's rows, those marked missing, and those without a value or its deviation."""
    without = F.col("value").isNull() | F.isnan("value") | F.col("sd").isNull() | F.isnan("sd")
    return p4_grid(spark, d).groupBy("station_ref").agg(F.count("*").alias("n_rows"), F.count_if("missing").alias("n_missing"), F.count_if(without).alias("n_without"))


NEAR_M = 25.0


def _located(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, spatial.Quadtree]:
    """Gauges at usable locations, the locations as classes (written once), and one quadtree for both halves."""
    rows = table(spark, d, "catchment_level_shortlist").select("station_id", "latitude", "longitude")
    members = spatial.members_of(rows, "station_id", "latitude", "longitude")
    classes = cut_lineage(members.groupBy("lat", "lon").agg(F.min("k").alias("class_key"), F.count("*").alias("n")))
    return members, classes, spatial.fit_quadtree(classes, NEAR_M)


def _held(spark: SparkSession, d: str, classes: DataFrame, tree: spatial.Quadtree) -> DataFrame:
    return spatial.holding_regions(classes, table(spark, d, "subcatchments"), tree, "subcatchment_id", "rings")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, classes, tree = _located(spark, d)
    near = spatial.expand_pairs(members, classes, spatial.near_classes(classes, tree, NEAR_M))
    recorded = table(spark, d, "catchment_level_shortlist").filter("station_id is not null").select(
        "station_id", (F.col("latitude") + 0.0).alias("lat"), (F.col("longitude") + 0.0).alias("lon"), "subcatchment_id"
    )
    wrong = recorded.distinct().join(_held(spark, d, classes, tree), ["lat", "lon"]).filter(~F.col("subcatchment_id").eqNullSafe(F.col("region")))
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(
        wrong.select(F.lit("region").alias("kind"), F.col("station_id").alias("key_a"), F.col("region").alias("key_b")).distinct()
    )


def p1_regions(spark: SparkSession, d: str) -> DataFrame:
    """Every gauge with the polygon that holds it, the first by id where several do (ambiguous), null where none does."""
    members, classes, tree = _located(spark, d)
    held = _held(spark, d, classes, tree).groupBy("lat", "lon").agg(F.min("region").alias("region"), F.count_distinct("region").alias("regions"))
    placed = members.join(held, ["lat", "lon"], "left").select(F.col("k").alias("station_id"), "region", "regions")
    gauges = table(spark, d, "catchment_level_shortlist").filter("station_id is not null").select("station_id").distinct()
    ambiguous = F.coalesce(F.col("regions") > 1, F.lit(False))
    return gauges.join(placed, "station_id", "left").select("station_id", F.col("region").alias("subcatchment_id"), ambiguous.alias("ambiguous_match")).distinct()


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every location as a class: its smallest key, its keys, and the locations and keys near it; no pair is written out."""
    _, classes, tree = _located(spark, d)
    return spatial.class_links(classes, spatial.near_classes(classes, tree, NEAR_M)).select("class_key", F.col("n").alias("n_keys"), "links", "keys_linked")


PERIODS = [7, 30]


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "antecedent_labels").select("station_id", "label_date", "mean_level", "recession_rate_7d")
    return rolling.trailing_totals(
        rows, "station_id", "label_date", {"mm": ("mean_level", 1e-3), "um": ("recession_rate_7d", 1e-6)}, PERIODS
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d).filter("not has_mm").select(
        "station_id", F.date_format("label_date", "yyyy-MM-dd").alias("label_date"),
        F.col("n_mm_7").alias("n_7"), F.col("total_mm_7").alias("total_7_mm"),
        F.col("n_mm_30").alias("n_30"), F.col("total_mm_30").alias("total_30_mm"), F.col("total_um_30").alias("slope_30_um"),
    )


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    """All days with totals and averages over both periods."""
    return tidy(_trailing(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.layout_changes(table(spark, d, "raw_gauge_lines"), table(spark, d, "gauge_files"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All landed lines in one schema, with rescued fields."""
    return drift.consistent_table(table(spark, d, "raw_gauge_lines"), table(spark, d, "gauge_files"))


def p6_replay(spark: SparkSession, d: str) -> DataFrame:
    """The table with a header that was approved later, replayed from what was rescued."""
    rows = p6_table(spark, d)
    return drift.replay(rows, "battery", "battery_v", "double").select("file_id", "line_no", "battery")


AUDITS = {
    "catchment_level_shortlist": [
        profile.Audit("sentinel_era_completeness_pct", 0.0, 100.0, 2),
        profile.Audit("sentinel_era_max_gap_days", 0.0, "sentinel_era_span_days", 2),
    ],
    "antecedent_labels": [profile.Audit("baseflow_index", 0.0, 1.0, 4)],
}


def _loads(spark: SparkSession, d: str) -> DataFrame:
    counts = [
        profile.value_counts(spark, f"{d}/{name}.parquet", "load_no", audits).withColumn("column", F.concat(F.lit(f"{name}."), "column"))
        for name, audits in AUDITS.items()
    ]
    return profile.load_profile(counts[0].unionByName(counts[1]))


def p7_loads(spark: SparkSession, d: str) -> DataFrame:
    """The audited columns of both tables, load by load."""
    return tidy(_loads(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.odd_loads(_loads(spark, d)).select(
        F.split_part("column", F.lit("."), F.lit(1)).alias("table_name"), F.split_part("column", F.lit("."), F.lit(2)).alias("column_name"),
        F.col("load").cast("bigint").alias("load_no"), "finding",
    )


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of both tables."""
    parts = [profile.column_profile(spark, f"{d}/{name}.parquet").withColumn("table_name", F.lit(name)) for name in AUDITS]
    return parts[0].unionByName(parts[1]).drop("least", "most")


def p7_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of every column of both tables their footers, their dictionaries and scans of their chunks settled."""
    parts = [profile.chunk_sources(spark, f"{d}/{name}.parquet").withColumn("table_name", F.lit(name)) for name in AUDITS]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_regions, p1_links, p2_found, p2_instants, p3_found, p4_found, p4_grid, p4_seams, p4_flags, p5_found, p5_rolling, p6_found, p6_table, p6_replay, p7_found, p7_loads, p7_profile, p7_chunks)}

NEAR = """g AS (SELECT DISTINCT station_id AS k, latitude + 0 AS y, longitude + 0 AS x, subcatchment_id AS s FROM catchment_level_shortlist
  WHERE station_id IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
p AS (SELECT DISTINCT k, y, x, CAST(floor(CASE WHEN isnan(y) THEN 0 ELSE y END * 2000) AS BIGINT) AS c FROM g),
n AS (SELECT a.k AS a, b.k AS b FROM p a JOIN (SELECT *, unnest([c - 1, c, c + 1]) AS cc FROM p) b ON a.c = b.cc AND a.k < b.k AND abs(a.x - b.x) < 0.01
  WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) < 25)"""
HELD = """r AS (SELECT subcatchment_id AS id, bbox, unnest(rings) AS ring FROM subcatchments),
e AS (SELECT id, bbox, ring[i].x AS x0, ring[i].y AS y0, ring[i + 1].x AS x1, ring[i + 1].y AS y1 FROM r, unnest(range(1, len(ring))) AS u(i)),
h AS (SELECT g.k, g.s, g.x, g.y, e.id FROM g JOIN e ON g.x BETWEEN e.bbox.xmin AND e.bbox.xmax AND g.y BETWEEN e.bbox.ymin AND e.bbox.ymax
  WHERE (e.y0 > g.y) <> (e.y1 > g.y) AND g.x < (e.x1 - e.x0) * (g.y - e.y0) / (e.y1 - e.y0) + e.x0 GROUP BY ALL HAVING count(*) % 2 = 1)"""
# SQL for the problems that SQL can state; the others are tested against brute force.
ORACLE = {
    "p2_found": rf"""WITH {INSTANTS} SELECT reading_id, utc_us // 1000 AS utc_ms FROM placed JOIN gauge_readings USING (reading_id)
WHERE utc IS NOT NULL AND NOT regexp_full_match(datetime, '\d{{4}}-\d\d-\d\d(T\d\d:\d\d:\d\d\.\d{{3}}Z| \d\d:\d\d:\d\d\+00:00)')""",
    "p2_instants": f"WITH {INSTANTS} SELECT reading_id, utc_us // 1000 AS utc_ms FROM placed",
    "p4_found": f"""WITH {INSTANTS}, q AS (SELECT DISTINCT station_ref, utc_us // 900000000 AS slot FROM placed JOIN gauge_readings USING (reading_id) WHERE utc IS NOT NULL AND value BETWEEN 0 AND 125 AND station_ref IS NOT NULL),
h AS (SELECT *, lead(slot) OVER (PARTITION BY station_ref ORDER BY slot) AS nxt FROM q) SELECT station_ref, (slot + 1) * 900000 AS gap_start_ms, nxt - slot - 1 AS n_slots FROM h WHERE nxt > slot + 1""",
    "p1_found": f"""WITH {NEAR}, {HELD} SELECT 'near' AS kind, a AS key_a, b AS key_b FROM n UNION SELECT 'region', k, id FROM h WHERE s IS DISTINCT FROM id""",
    "p1_regions": f"""WITH {NEAR}, {HELD}, w AS (SELECT k, y, x, min(id) AS id, count(DISTINCT id) AS m FROM h GROUP BY ALL), q AS (SELECT DISTINCT k, y, x FROM g)
SELECT DISTINCT s.station_id, w.id AS subcatchment_id, coalesce(m > 1, false) AS ambiguous_match FROM (SELECT DISTINCT station_id FROM catchment_level_shortlist WHERE station_id IS NOT NULL) s LEFT JOIN q ON q.k = s.station_id LEFT JOIN w ON w.k = q.k AND w.y = q.y AND w.x = q.x""",
    "p1_links": f"""WITH {NEAR}, c AS (SELECT y, x, min(k) AS ck, count(*) AS m, min(c) AS c FROM p GROUP BY y, x),
o AS (SELECT a.y, a.x, count(*) AS links, sum(b.m) AS linked FROM c a JOIN (SELECT *, unnest([c - 1, c, c + 1]) AS cc FROM c) b ON a.c = b.cc AND (a.y <> b.y OR a.x <> b.x) AND abs(a.x - b.x) < 0.01
  WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) < 25 GROUP BY 1, 2)
SELECT ck AS class_key, m AS n_keys, coalesce(links, 0) AS links, CAST(coalesce(linked, 0) AS BIGINT) AS keys_linked FROM c LEFT JOIN o ON o.y = c.y AND o.x = c.x""",
    "p4_seams": f"""WITH {INSTANTS} SELECT station_ref, count(DISTINCT utc_us // 900000000) AS filled, 0 AS off FROM placed JOIN gauge_readings USING (reading_id) WHERE utc IS NOT NULL AND value BETWEEN 0 AND 125 AND station_ref IS NOT NULL GROUP BY 1""",
    "p4_flags": f"""WITH {INSTANTS}, q AS (SELECT station_ref, count(DISTINCT utc_us // 900000000) AS n, max(utc_us // 900000000) - min(utc_us // 900000000) + 1 AS m FROM placed JOIN gauge_readings USING (reading_id) WHERE utc IS NOT NULL AND value BETWEEN 0 AND 125 AND station_ref IS NOT NULL GROUP BY 1)
SELECT station_ref, m AS n_rows, m - n AS n_missing, 0 AS n_without FROM q""",
    "p5_found": """WITH d AS (SELECT station_id AS s, label_date AS t, max(CASE WHEN isfinite(mean_level) THEN mean_level END) AS v, max(CASE WHEN isfinite(recession_rate_7d) THEN recession_rate_7d END) AS r
  FROM antecedent_labels WHERE station_id IS NOT NULL AND label_date IS NOT NULL GROUP BY 1, 2),
c AS (SELECT s, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM d GROUP BY s), x AS (SELECT c.s, c.t, v, r FROM c LEFT JOIN d USING (s, t)),
w AS (SELECT s, t, v, count(v) OVER a AS n7, sum(round(v * 1000)) OVER a AS t7, count(v) OVER b AS n30, sum(round(v * 1000)) OVER b AS t30, sum(round(r * 1e6)) OVER b AS sl FROM x
  WINDOW a AS (PARTITION BY s ORDER BY t ROWS 6 PRECEDING), b AS (PARTITION BY s ORDER BY t ROWS 29 PRECEDING))
SELECT s AS station_id, CAST(t AS VARCHAR) AS label_date, n7 AS n_7, CAST(coalesce(t7, 0) AS BIGINT) AS total_7_mm, n30 AS n_30, CAST(coalesce(t30, 0) AS BIGINT) AS total_30_mm, CAST(coalesce(sl, 0) AS BIGINT) AS slope_30_um FROM w WHERE v IS NULL""",
    "p6_found": r"""WITH l AS (SELECT file_id, line_no, rtrim(ltrim(line, chr(65279)), chr(13) || chr(10) || ' ') AS t FROM raw_gauge_lines WHERE line IS NOT NULL),
m AS (SELECT * FROM l WHERE trim(t) <> '' AND t NOT LIKE '#%'), h AS (SELECT file_id, arg_min(t, line_no) AS hd, min(line_no) AS no FROM m GROUP BY 1),
k AS (SELECT file_id, hd, no, CASE WHEN contains(hd, ';') THEN ';' ELSE ',' END AS dl FROM h),
c AS (SELECT k.file_id, i AS pos, trim(string_split(hd, dl)[i]) AS nm, no, hd, dl FROM k, unnest(range(1, len(string_split(hd, dl)) + 1)) AS u(i)),
f AS (SELECT *, regexp_replace(lower(nm), '[\s_\-]+', '', 'g') AS pl, CASE WHEN regexp_replace(lower(nm), '[\s_\-]+', '', 'g') IN ('qualitycode', 'qc', 'qcode', 'qflag', 'grade', 'codequal') THEN 'quality_code'
  WHEN regexp_replace(lower(nm), '[\s_\-]+', '', 'g') IN ('qualityok', 'ok', 'valid', 'usableyn', 'passed', 'isgood') THEN 'quality_ok' END AS fld FROM c),
v AS (SELECT f.file_id, f.fld, any_value(f.pl) AS pl, max(CASE WHEN regexp_full_match(x, '[+-]?\d+') THEN 0 WHEN regexp_full_match(x, '[+-]?(\d+\.\d*|\.\d+)') THEN 1 WHEN lower(x) IN ('true', 'false') THEN 2 WHEN x <> '' THEN 3 END) AS kd
  FROM f LEFT JOIN (SELECT m.file_id, m.line_no, m.t FROM m) m ON m.file_id = f.file_id AND m.line_no > f.no AND m.t <> f.hd, LATERAL (SELECT nullif(trim(string_split(m.t, f.dl)[f.pos]), '') AS x) WHERE fld IS NOT NULL GROUP BY 1, 2),
o AS (SELECT g.station_ref, g.seq_no, g.file_id, lag(g.file_id) OVER (PARTITION BY g.station_ref ORDER BY g.seq_no, g.file_id) AS was FROM gauge_files g WHERE g.file_id IN (SELECT file_id FROM k)),
z AS (SELECT o.file_id, q.fld, a.pl AS pa, b.pl AS pb, a.kd AS ka, b.kd AS kb FROM o CROSS JOIN (VALUES ('quality_code'), ('quality_ok')) q(fld) LEFT JOIN v a ON a.file_id = o.file_id AND a.fld = q.fld LEFT JOIN v b ON b.file_id = o.was AND b.fld = q.fld WHERE o.was IS NOT NULL)
SELECT file_id, fld AS field_name, 'added' AS change FROM z WHERE pa IS NOT NULL AND pb IS NULL UNION ALL SELECT file_id, fld, 'removed' FROM z WHERE pa IS NULL AND pb IS NOT NULL
UNION ALL SELECT file_id, fld, 'renamed' FROM z WHERE pa <> pb UNION ALL SELECT file_id, fld, 'retyped' FROM z WHERE ka <> kb""",
}
# Problem 3 by its rules alone, without the filter. The usual change of a gauge is the least u that no step exceeds but those
# beside excursions of over 2u; u is the largest change far from any excursion or the change of a step beside one.
_EXCURSION = """SELECT s, t, {n} AS days, {least} AS least FROM e WHERE NOT b AND NOT b{n} AND b IS NOT NULL AND b{n} IS NOT NULL AND p IS NOT NULL AND v{n} IS NOT NULL
  AND {known} AND {least} > 0 AND abs(v{n} - p) < greatest({least}, 1e-12)"""


def _excursion(n: int) -> str:
    least = "least(" + ", ".join(f"abs(v{j} - p), abs(v{j} - v{n})" for j in range(n)) + ")"
    return _EXCURSION.format(n=n, least=least, known=" AND ".join(f"v{j} IS NOT NULL" for j in range(n)))


ORACLE["p3_found"] = f"""WITH d AS (SELECT station_id AS s, label_date AS t, max(CASE WHEN NOT isnan(mean_level) THEN mean_level END) AS r, max(CASE WHEN NOT isnan(standardized_anomaly) THEN standardized_anomaly END) AS a, max(quality_code) AS q
  FROM antecedent_labels WHERE station_id IS NOT NULL AND label_date IS NOT NULL GROUP BY 1, 2),
c AS (SELECT s, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM d GROUP BY s),
x AS (SELECT c.s, c.t, CASE WHEN isfinite(r) THEN r END AS v, coalesce(r < {LEVEL_LOW} OR r > {LEVEL_HIGH}, false) AS bad FROM c LEFT JOIN d USING (s, t)),
e AS (SELECT s, t, lag(v) OVER w AS p, lag(bad) OVER w AS b, v AS v0, {", ".join(f"lead(v, {n}) OVER w AS v{n}, lead(bad, {n}) OVER w AS b{n}" for n in (1, 2, 3))}, bad FROM x WINDOW w AS (PARTITION BY s ORDER BY t)),
k AS ({" UNION ALL ".join(_excursion(n) for n in (1, 2, 3))}),
kd AS (SELECT s, t + CAST(j AS INT) AS t, least FROM k, unnest(range(0, days)) AS u(j)), cv AS (SELECT s, t, max(least) AS m FROM kd GROUP BY 1, 2),
st AS (SELECT e.s, abs(e.v0 - e.p) AS st, greatest(a.m, z.m) AS m FROM e LEFT JOIN cv a ON a.s = e.s AND a.t = e.t LEFT JOIN cv z ON z.s = e.s AND z.t = e.t - 1 WHERE e.v0 IS NOT NULL AND e.p IS NOT NULL AND NOT e.bad AND NOT e.b),
u0 AS (SELECT s, max(st) AS u FROM st WHERE m IS NULL GROUP BY 1), cu AS (SELECT s, u, u AS far FROM u0 UNION SELECT s, st, u FROM st JOIN u0 USING (s) WHERE m IS NOT NULL AND st > u),
fu AS (SELECT cu.s, cu.u FROM cu LEFT JOIN st ON st.s = cu.s AND st.m <= 2 * cu.u GROUP BY cu.s, cu.u, cu.far HAVING greatest(cu.far, max(st.st)) <= cu.u), us AS (SELECT s, min(u) AS u FROM fu GROUP BY 1),
y AS (SELECT *, v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY s ORDER BY t) AS same, lag(t) OVER (PARTITION BY s ORDER BY t) IS NULL AS head FROM x WHERE v IS NOT NULL AND NOT bad),
yr AS (SELECT *, count(*) FILTER (WHERE NOT same OR head) OVER (PARTITION BY s ORDER BY t) AS run FROM y), yl AS (SELECT *, count(*) OVER (PARTITION BY s, run) >= 10 AS long FROM yr),
yp AS (SELECT *, lag(long) OVER (PARTITION BY s ORDER BY t) AS was FROM yl), mv AS (SELECT s FROM yp WHERE NOT head AND NOT (long AND was) GROUP BY 1 HAVING avg(CAST(same AS INT)) <= 0.5),
f AS (SELECT s, t, 'mean_level' AS f FROM d WHERE r < {LEVEL_LOW} OR r > {LEVEL_HIGH} UNION SELECT s, t, 'mean_level' FROM kd JOIN us USING (s) WHERE least > 2 * u UNION SELECT s, t, 'mean_level' FROM yl SEMI JOIN mv USING (s) WHERE long
  UNION SELECT s, t, 'standardized_anomaly' FROM d WHERE abs(a) > 8
  UNION SELECT s, t, 'quality_code' FROM (SELECT *, count(*) OVER (PARTITION BY s, q) / count(*) OVER (PARTITION BY s) AS share FROM d) WHERE q IS NOT NULL AND share < 0.03)
SELECT s AS station_id, CAST(t AS VARCHAR) AS label_date, f AS field_name FROM f"""
_SPANS = [(m, c, u, p) for m, c, u in (("mm", "v", "1000"), ("um", "r", "1e6")) for p in PERIODS]
_DAYS = """d AS (SELECT station_id AS s, label_date AS t, max(CASE WHEN isfinite(mean_level) THEN mean_level END) AS v, max(CASE WHEN isfinite(recession_rate_7d) THEN recession_rate_7d END) AS r
  FROM antecedent_labels WHERE station_id IS NOT NULL AND label_date IS NOT NULL GROUP BY 1, 2),
c AS (SELECT s, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM d GROUP BY s), x AS (SELECT c.s, c.t, v, r FROM c LEFT JOIN d USING (s, t))"""
ORACLE["p5_rolling"] = f"""WITH {_DAYS}, w AS (SELECT *, {", ".join(f"count({c}) OVER w{p} AS n_{m}_{p}, CAST(coalesce(sum(round({c} * {u})) OVER w{p}, 0) AS BIGINT) AS total_{m}_{p}" for m, c, u, p in _SPANS)} FROM x
 WINDOW {", ".join(f"w{p} AS (PARTITION BY s ORDER BY t ROWS {p - 1} PRECEDING)" for p in PERIODS)})
SELECT s AS station_id, CAST(t AS VARCHAR) AS label_date, v IS NOT NULL AS has_mm, r IS NOT NULL AS has_um,
 {", ".join(f"n_{m}_{p}, total_{m}_{p}, {near(f'total_{m}_{p} / nullif(n_{m}_{p}, 0)')} AS avg_{m}_{p}" for m, _, _, p in _SPANS)} FROM w"""
_LOADS = """SELECT '{t}' AS tn, '{c}' AS cn, load_no AS l, CASE WHEN NOT isnan({c}) THEN {c} END AS v, coalesce(NOT isnan({c}) AND {c} >= 0 AND {c} <= {hi}, false) AS ok, {dec} AS dec FROM {t}"""
_ALL = " UNION ALL ".join(
    _LOADS.format(t=t, c=a.column, hi=a.high, dec=a.decimals) for t, audits in AUDITS.items() for a in audits
)
LOADS = f"""x AS ({_ALL}), s AS (SELECT tn, cn, l, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nn, count(*) FILTER (WHERE v IS NULL) / count(*) AS sh, count(DISTINCT v) AS dn, min(v) FILTER (WHERE isfinite(v)) + 0 AS lo, max(v) FILTER (WHERE isfinite(v)) + 0 AS hi,
 count(*) FILTER (WHERE v IS NOT NULL AND NOT ok) AS bad, count_if(ok AND round(v * pow(10, dec)) / pow(10, dec) <> v) AS rough FROM x GROUP BY 1, 2, 3),
m AS (SELECT *, sh - median(sh) OVER w > 0.2 AS nul, dn < 0.5 * median(dn) OVER w AS few FROM s WINDOW w AS (PARTITION BY tn, cn)),
u AS (SELECT tn, cn, l, v, count(*) AS n FROM x WHERE ok GROUP BY ALL), pts AS (SELECT DISTINCT cn, v FROM u), ld AS (SELECT cn, l, sum(n) AS tot FROM u GROUP BY 1, 2), al AS (SELECT cn, sum(tot) AS al FROM ld GROUP BY 1),
g AS (SELECT p.cn, ld.l, p.v, ld.tot, al.al, coalesce(u.n, 0) AS n, sum(coalesce(u.n, 0)) OVER (PARTITION BY p.cn, ld.l ORDER BY p.v) AS own FROM pts p JOIN ld USING (cn) JOIN al USING (cn) LEFT JOIN u ON u.cn = p.cn AND u.l = ld.l AND u.v = p.v),
k AS (SELECT *, sum(own) OVER (PARTITION BY cn, v) AS everyone FROM g), ks AS (SELECT cn, l, max(abs(own / tot - (everyone - own) / (al - tot))) AS d FROM k GROUP BY 1, 2)"""
ORACLE["p7_loads"] = f"""WITH {LOADS} SELECT tn || '.' || cn AS "column", CAST(l AS BIGINT) AS load, n AS rows, nn AS nulls, dn AS "distinct", {near('lo')} AS least, {near('hi')} AS most, bad AS impossible, rough, {near('d')} AS shift FROM m LEFT JOIN ks USING (cn, l)"""
ORACLE["p7_found"] = f"""WITH {LOADS},
r AS (SELECT m.*, coalesce(ks.d, 0) > 0.4 AS sft FROM m LEFT JOIN ks USING (cn, l))
SELECT tn AS table_name, cn AS column_name, CAST(l AS BIGINT) AS load_no, f AS finding FROM r, unnest([CASE WHEN nul THEN 'nulls' END, CASE WHEN bad > 0 THEN 'range' END, CASE WHEN rough > 0 THEN 'pattern' END, CASE WHEN NOT nul AND few THEN 'distinct' END, CASE WHEN NOT nul AND sft THEN 'shift' END]) AS q(f) WHERE f IS NOT NULL"""

_KINDS = {
    "catchment_level_shortlist": {
        "text": "station_id station_name water_body rbd catchment_id subcatchment_id opw_catchment_area status quality_code_top5", "whole": "load_no", "boolean": "usable_for_study",
        "instant": "sentinel_era_start sentinel_era_end", "real": "subcatchment_area_km2 subcatchment_to_true_area_ratio latitude longitude sentinel_era_span_days "
        "sentinel_era_completeness_pct sentinel_era_max_gap_days sentinel_era_quality_ok_pct sentinel_era_interval_minutes",
    },
    "antecedent_labels": {
        "text": "station_id", "day": "label_date", "whole": "days_since_last_peak quality_code load_no", "real": "mean_level level_percentile standardized_anomaly baseflow_index recession_rate_7d",
    },
}
_SHOWN = {
    "text": "{f}({c})", "day": "CAST({f}({c}) AS VARCHAR)", "instant": "strftime(make_timestamp(epoch_us({f}({c}))), '%Y-%m-%d %H:%M:%S.%f') || 'Z'",
    "whole": "CAST({f}({c}) AS DOUBLE)", "boolean": "CAST({f}(CAST({c} AS INT)) AS DOUBLE)", "real": "{f}({c}) FILTER (WHERE isfinite({c})) + 0",
}


def _profile_sql(table_name: str, kind: str, c: str) -> str:
    number, least, most = kind in ("whole", "boolean", "real"), *(_SHOWN[kind].format(f=f, c=c) for f in ("min", "max"))
    nan = f"count_if(isnan({c}))" if kind == "real" else "0"
    seen = f"CASE WHEN NOT isnan({c}) THEN {c} END" if kind == "real" else c
    shown = [least, most, "NULL", "NULL"] if number else ["NULL", "NULL", least, most]
    return f"""SELECT '{table_name}' AS table_name, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, {nan} AS nans, count(DISTINCT {seen}) AS "distinct",
 {shown[0]} AS least_number, {shown[1]} AS most_number, {shown[2]} AS least_text, {shown[3]} AS most_text FROM {table_name}"""


ORACLE["p7_profile"] = " UNION ALL ".join(_profile_sql(t, kind, c) for t, kinds in _KINDS.items() for kind, names in kinds.items() for c in names.split())

TABLE = r"""l AS (SELECT file_id, line_no, rtrim(ltrim(line, chr(65279)), chr(13) || chr(10) || ' ') AS t FROM raw_gauge_lines WHERE line IS NOT NULL),
m AS (SELECT * FROM l WHERE trim(t) <> '' AND t NOT LIKE '#%'), h AS (SELECT file_id, arg_min(t, line_no) AS hd, min(line_no) AS no FROM m GROUP BY 1),
k AS (SELECT file_id, hd, no, CASE WHEN contains(hd, ';') THEN ';' ELSE ',' END AS dl FROM h),
d AS (SELECT m.file_id, m.t, any_value(hd) AS hd, any_value(dl) AS dl, min(m.line_no) AS line_no FROM m JOIN k USING (file_id) WHERE m.line_no > no AND m.t <> hd GROUP BY 1, 2),
c AS (SELECT d.file_id, d.line_no, i AS pos, lower(trim(string_split(hd, dl)[i])) AS nm, nullif(trim(string_split(t, dl)[i]), '') AS x FROM d, unnest(range(1, len(string_split(hd, dl)) + 1)) AS u(i)),
f AS (SELECT *, CASE WHEN regexp_replace(nm, '[\s_\-]+', '', 'g') IN ('qualitycode', 'qc', 'qcode', 'qflag', 'grade', 'codequal') THEN 'quality_code'
  WHEN regexp_replace(nm, '[\s_\-]+', '', 'g') IN ('qualityok', 'ok', 'valid', 'usableyn', 'passed', 'isgood') THEN 'quality_ok' ELSE nm END AS fld FROM c),
g AS (SELECT *, CASE WHEN fld = 'value' THEN try_cast(x AS DOUBLE) END AS v, CASE WHEN fld = 'quality_code' THEN coalesce(try_cast(regexp_extract(x, '(?i)^q?\s*([+-]?\d+)(\.0*)?$', 1) AS INT),
  CASE lower(x) WHEN 'good' THEN 254 WHEN 'fair' THEN 31 WHEN 'estimated' THEN 32 WHEN 'poor' THEN 42 WHEN 'suspect' THEN 99 WHEN 'unchecked' THEN 101 WHEN 'missing' THEN -1 END) END AS q,
 CASE WHEN fld = 'quality_ok' THEN CASE WHEN lower(x) IN ('true', '1', '1.0', 'y', 'yes', 'pass', 'ok', 't') THEN true WHEN lower(x) IN ('false', '0', '0.0', 'n', 'no', 'fail', 'bad', 'f') THEN false END END AS o FROM f)"""
_LOST = "x IS NOT NULL AND fld <> 'datetime' AND v IS NULL AND q IS NULL AND o IS NULL"
ORACLE["p6_table"] = f"""WITH {TABLE} SELECT file_id, line_no, max(CASE WHEN fld = 'datetime' THEN x END) AS datetime, max(v) AS value, max(q) AS quality_code, bool_or(o) AS quality_ok,
 '{{' || string_agg(CASE WHEN {_LOST} THEN to_json(fld) || ':' || to_json(x) END, ',' ORDER BY pos) || '}}' AS _rescued FROM g GROUP BY 1, 2"""
ORACLE["p6_replay"] = f"WITH {TABLE} SELECT file_id, line_no, max(CASE WHEN fld = 'battery_v' THEN try_cast(x AS DOUBLE) END) AS battery FROM g GROUP BY 1, 2"
