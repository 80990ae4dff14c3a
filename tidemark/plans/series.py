"""Queries of the time-series, label and source operators, with the SQL that checks them.

Readings come with the instants of every notation; the SQL gets them by a parse of its own (instants_sql).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import labels as L
from tidemark.operators import timeseries as S
from tidemark.plans.instants_sql import INSTANTS
from tidemark.plans.tidy import near, query, tidy
from tidemark.session import table
from tidemark.sources import readings as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
add = query(QUERIES, ORACLE)

ERA_S = 1_483_228_800  # 2017-01-01


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return R.typed_readings(table(spark, d, "gauge_readings"), table(spark, d, "gauge_files"))


def also_named_all(add, sql: dict[str, str], *queries) -> None:
    """Keeps ``<name>_all`` as another name of queries that were once registered under both."""
    for fn in queries:

        def run(spark, d, fn=fn):
            return fn(spark, d)

        run.__name__, run.__doc__ = f"{fn.__name__}_all", f"Another name of {fn.__name__}."
        add(sql[fn.__name__])(run)


def _days(spark: SparkSession, d: str) -> DataFrame:
    return R.daily_levels(table(spark, d, "antecedent_labels"))


READ = rf"""{INSTANTS},
r AS (SELECT reading_id, file_id, station_ref AS station_id, utc AS ts,
 CASE WHEN value BETWEEN 0 AND 125 THEN value END AS value, coalesce(quality_code, 0) AS quality_code,
 coalesce(quality_code, 0) = 254 AS quality_ok,
 CASE lower(trim(quality_ok)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM gauge_readings JOIN placed USING (reading_id)),
t AS (SELECT *, epoch_ms(ts) // 1000 AS s FROM r)"""
DAYS = """d AS (SELECT station_id, label_date AS day, max(CASE WHEN mean_level BETWEEN 0 AND 125 THEN mean_level END) AS value
 FROM antecedent_labels WHERE station_id IS NOT NULL AND label_date IS NOT NULL GROUP BY 1, 2),
c AS (SELECT station_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY station_id),
e AS (SELECT c.station_id, c.day, d.value FROM c LEFT JOIN d USING (station_id, day))"""


def _grid(step: int, agg: str = "avg(value)", empty: str = "NULL") -> str:
    return f"""b AS (SELECT station_id, s // {step} * {step} AS bin_s, {agg} AS value, count(value) AS n FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT station_id, unnest(range(min(bin_s), max(bin_s) + 1, {step})) AS bin_s FROM b GROUP BY 1),
g AS (SELECT sp.station_id, sp.bin_s, coalesce(b.value, {empty}) AS value, coalesce(b.n, 0) AS n FROM sp LEFT JOIN b USING (station_id, bin_s))"""


@add(f"WITH {READ} SELECT station_id, count(*) AS n, count(ts) AS timed, count(value) AS valued, count(*) FILTER (WHERE quality_ok) AS ok, count(*) FILTER (WHERE flag) AS flagged FROM t GROUP BY 1")
def typed_readings(spark, d):
    r = _readings(spark, d)
    return r.groupBy("station_id").agg(
        F.count("*").alias("n"), F.count("ts").alias("timed"), F.count("value").alias("valued"), F.count_if("quality_ok").alias("ok"), F.count_if("flag").alias("flagged")
    )


@add(f"WITH {READ} SELECT station_id, count(*) AS n_rows, min(s) AS first_s, max(s) AS last_s, {near('100.0 * count(*) FILTER (WHERE value IS NULL) / count(*)', 1)} AS missing_pct, {near('avg(value)', 3)} AS mean_value FROM t WHERE ts IS NOT NULL GROUP BY 1")
def download_summary(spark, d):
    s = S.epoch_s("ts")
    got = _readings(spark, d).filter("ts is not null").groupBy("station_id").agg(
        F.count("*").alias("n_rows"), F.min(s).alias("first_s"), F.max(s).alias("last_s"),
        (100.0 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_pct"), F.avg("value").alias("mean_value"),
    )
    return tidy(got, missing_pct=1, mean_value=3)


@add(f"WITH {READ}, {_grid(900)} SELECT station_id, bin_s, {near('value')} AS value, n FROM g")
def resample_quarter(spark, d):
    return S.resample(_readings(spark, d), 900)


@add(f"WITH {READ}, {_grid(3600, 'sum(value)', '0')} SELECT station_id, bin_s, {near('value')} AS value, n FROM g")
def resample_hourly_sum(spark, d):
    return S.resample(_readings(spark, d), 3600, "sum")


@add(f"WITH {READ}, {_grid(86400)} SELECT station_id, bin_s, {near('value')} AS value, n FROM g")
def resample_daily(spark, d):
    return S.resample(_readings(spark, d), 86400)


@add(f"WITH {READ}, {_grid(900)} SELECT station_id, count(*) AS total, count(value) AS available, count(*) - count(value) AS missing, {near('100.0 * count(value) / count(*)', 1)} AS completeness_pct, count(value) / count(*) >= 0.7 AS passes FROM g GROUP BY 1")
def completeness_report(spark, d):
    got = S.completeness(S.resample(_readings(spark, d), 900))
    return tidy(got.withColumn("completeness_pct", 100.0 * F.col("available") / F.col("total")), completeness_pct=1)


@add(f"""WITH {READ}, {_grid(900)}, i AS (SELECT *, count(value) OVER (PARTITION BY station_id ORDER BY bin_s) AS k, max(bin_s) OVER (PARTITION BY station_id) AS z FROM g)
SELECT station_id, min(bin_s) AS start_s, least(max(bin_s) + 900, max(z)) AS end_s, {near('(least(max(bin_s) + 900, max(z)) - min(bin_s)) / 3600.0')} AS hours
FROM i WHERE value IS NULL GROUP BY station_id, k HAVING least(max(bin_s) + 900, max(z)) - min(bin_s) >= 21600""")
def gap_islands(spark, d):
    return S.gaps(S.resample(_readings(spark, d), 900), 900, 6 * 3600)


@add(f"""WITH {READ}, n AS (SELECT station_id, quality_code, count(*) AS n FROM t GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, quality_code) AS rank FROM n)
SELECT station_id, string_agg(quality_code || ':' || n, '; ' ORDER BY rank) AS top_codes FROM k WHERE rank <= 5 GROUP BY 1""")
def quality_top5(spark, d):
    return S.top_codes(R.typed_codes(table(spark, d, "gauge_readings")))


@add(f"""WITH {READ}, p AS (SELECT station_id, count(*) AS total_rows, count(*) FILTER (WHERE ts IS NULL) AS n_bad_timestamps FROM t GROUP BY 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, s ORDER BY reading_id) AS k FROM t WHERE s >= {ERA_S}) WHERE k = 1),
w AS (SELECT *, s - lag(s) OVER (PARTITION BY station_id ORDER BY s) AS step, CASE WHEN value IS NOT NULL THEN s - last_value(CASE WHEN value IS NOT NULL THEN s END IGNORE NULLS)
  OVER (PARTITION BY station_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS hole FROM f),
a AS (SELECT station_id, min(s) AS x, max(s) AS y, count(*) AS era_rows, count(value) AS era_values, greatest(coalesce(median(step), 900.0), 1.0) AS cad, max(hole) AS hole, avg(CAST(flag AS INT)) AS ok FROM w GROUP BY 1),
o AS (SELECT *, floor((y - x) / 86400) AS span_days, 100.0 * era_values / greatest(1, floor((y - x) / cad) + 1) AS pct FROM p LEFT JOIN a USING (station_id))
SELECT station_id, total_rows, n_bad_timestamps, x AS era_start_s, y AS era_end_s, era_rows, era_values, CAST(span_days AS BIGINT) AS span_days, {near('cad / 60', 3)} AS interval_minutes,
 {near('pct', 1)} AS completeness_pct, {near('100 * ok', 1)} AS quality_ok_pct, {near('hole / 86400.0', 3)} AS max_gap_days,
 CASE WHEN total_rows = n_bad_timestamps THEN 'no_valid_timestamps' WHEN era_rows IS NULL THEN 'empty' ELSE 'ok' END AS status,
 coalesce(span_days >= 1825 AND pct >= 70 AND (hole IS NULL OR hole / 86400.0 <= 60), false) AS usable FROM o""")
def availability(spark, d):
    got = S.availability(_readings(spark, d), ERA_S, digits=None)
    return tidy(got.withColumn("span_days", F.col("span_days").cast("bigint")), interval_minutes=3, completeness_pct=1, quality_ok_pct=1, max_gap_days=3)


@add(f"""WITH {READ} SELECT station_id, s, reading_id, {near('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY station_id, s ORDER BY reading_id) AS k FROM t WHERE ts IS NOT NULL) WHERE k = 1""")
def dedup_keep_first(spark, d):
    r = _readings(spark, d).filter("ts is not null").withColumn("s", S.epoch_s("ts"))
    return S.dedup_first(r, ["station_id", "s"], ["reading_id"]).select("station_id", "s", "reading_id", "value")


@add(r"""WITH m AS (SELECT file_id, line_no, regexp_replace(line, '^﻿', '') AS x FROM raw_gauge_lines), p AS (SELECT file_id, line_no, lower(trim(regexp_extract(x, '^\s*#\s*([^;]*);', 1))) AS k, trim(regexp_extract(x, '^[^;]*;(.*)$', 1)) AS v FROM m WHERE trim(x) LIKE '#%')
SELECT file_id, max(CASE WHEN k = 'station_no' THEN v END) AS station_no, max(CASE WHEN k = 'rows' THEN v END) AS rows FROM p GROUP BY 1""")
def header_metadata(spark, d):
    return R.header_metadata(table(spark, d, "raw_gauge_lines"), ["station_no", "rows"])


@add(r"SELECT file_id, nullif(regexp_extract(file_name, '^wl_(\d+)_\d+\.csv$', 1), '') AS station, regexp_extract(file_name, '^wl_(\d+)_\d+\.csv$', 1) = station_ref AS agrees FROM gauge_files")
def file_stations(spark, d):
    return table(spark, d, "gauge_files").select(
        "file_id", R.station_of_file("file_name").alias("station"), (F.coalesce(R.station_of_file("file_name"), F.lit("")) == F.col("station_ref")).alias("agrees")
    )


@add(f"WITH {DAYS} SELECT station_id, CAST(day AS VARCHAR) AS day, value IS NULL AS missing FROM e")
def spine_daily(spark, d):
    return L.every_day(_days(spark, d)).select("station_id", "day", F.col("value").isNull().alias("missing"))


@add(f"""WITH {DAYS} SELECT station_id, CAST(day AS VARCHAR) AS day, CASE WHEN value IS NOT NULL THEN {near('100 * (rank() OVER (PARTITION BY station_id ORDER BY value ASC NULLS LAST) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0) / count(value) OVER (PARTITION BY station_id)')} END AS level_percentile FROM e""")
def pct_rank(spark, d):
    return L.percentile_rank(L.every_day(_days(spark, d))).select("station_id", "day", "level_percentile")


@add(f"""WITH {DAYS}, x AS (SELECT *, dayofyear(day) AS doy, value - avg(value) OVER (PARTITION BY station_id) AS v FROM e),
p AS (SELECT station_id, doy, count(v) AS n, sum(v) AS s, sum(v * v) AS ss, min(v) AS lo, max(v) AS hi FROM x WHERE v IS NOT NULL GROUP BY 1, 2),
q AS (SELECT station_id, ((doy + o - 1 + 366) % 366) + 1 AS doy, n, s, ss, lo, hi FROM p, unnest(range(-7, 8)) AS u(o)),
k AS (SELECT station_id, doy, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, min(lo) AS lo, max(hi) AS hi FROM q GROUP BY 1, 2)
SELECT x.station_id, CAST(x.day AS VARCHAR) AS day, CASE WHEN k.n >= 5 AND k.hi > k.lo AND v IS NOT NULL THEN {near('(v - k.s / k.n) / nullif(sqrt(greatest(k.ss / k.n - (k.s / k.n) * (k.s / k.n), 0)), 0)')} END AS standardized_anomaly
FROM x LEFT JOIN k USING (station_id, doy)""")
def seasonal_anomaly(spark, d):
    return L.seasonal_anomaly(L.every_day(_days(spark, d)))


FILL = f"""{DAYS}, i AS (SELECT *, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY station_id ORDER BY day)),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
 first_value(value IGNORE NULLS) OVER z AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ni FROM i
 WINDOW a AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT station_id, day, value, CASE WHEN value IS NOT NULL THEN value WHEN i - pi <= 3 THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END AS filled FROM f)"""


@add(f"WITH {FILL} SELECT station_id, CAST(day AS VARCHAR) AS day, {near('filled')} AS filled FROM h")
def interp_limited(spark, d):
    return L.interpolate(L.every_day(_days(spark, d))).select("station_id", "day", "filled")


@add(f"""WITH {FILL}, v AS (SELECT station_id, day, filled AS x, row_number() OVER (PARTITION BY station_id ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY station_id) AS n FROM h WHERE filled IS NOT NULL),
a AS (SELECT *, n - 1 - k AS j, coalesce(x - lag(x) OVER (PARTITION BY station_id ORDER BY k), 0) AS d1, coalesce(x - lead(x) OVER (PARTITION BY station_id ORDER BY k), 0) AS d2 FROM v),
b AS (SELECT *, sum(d1 * 0.9625 * pow(0.925::DOUBLE, -k)) OVER (PARTITION BY station_id ORDER BY k) AS s1, sum(d2 * 0.9625 * pow(0.925::DOUBLE, -j)) OVER (PARTITION BY station_id ORDER BY j) AS s2 FROM a),
m AS (SELECT *, min(s1) OVER (PARTITION BY station_id ORDER BY k) AS m1, min(s2) OVER (PARTITION BY station_id ORDER BY j) AS m2 FROM b),
q AS (SELECT *, least(greatest(x - pow(0.925::DOUBLE, k) * (s1 - m1), 0), x) AS b1, least(greatest(x - pow(0.925::DOUBLE, j) * (s2 - m2), 0), x) AS b2 FROM m)
SELECT h.station_id, CAST(h.day AS VARCHAR) AS day, {near('CASE WHEN n > 10 AND x > 0 THEN least(greatest((b1 + b2) / 2 / x, 0), 1) END', 4)} AS baseflow_index FROM h LEFT JOIN q USING (station_id, day)""")
def baseflow_index(spark, d):
    return tidy(L.baseflow_index(L.every_day(_days(spark, d))), baseflow_index=4)


@add(f"""WITH {DAYS} SELECT station_id, CAST(day AS VARCHAR) AS day, CASE WHEN count(value) OVER w >= 4 THEN {near('regr_slope(value, epoch(day) / 86400.0) OVER w')} END AS recession_rate FROM e WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def recession_slope(spark, d):
    return L.recession_slope(L.every_day(_days(spark, d))).select("station_id", "day", "recession_rate")


PEAKS = f"""{DAYS}, v AS (SELECT *, row_number() OVER w AS i, max(value) OVER (PARTITION BY station_id) - min(value) OVER (PARTITION BY station_id) AS rg, count(*) OVER (PARTITION BY station_id) AS n FROM e WHERE value IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY day)),
l AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY station_id ORDER BY i) = value THEN 0 ELSE 1 END AS nw FROM v),
u AS (SELECT *, sum(nw) OVER (PARTITION BY station_id ORDER BY i) AS run FROM l),
r AS (SELECT station_id, run, max(value) AS h, min(i) AS a, max(i) AS b, max(rg) AS rg, max(n) AS n FROM u GROUP BY 1, 2),
p AS (SELECT *, lag(h) OVER (PARTITION BY station_id ORDER BY run) AS ph, lead(h) OVER (PARTITION BY station_id ORDER BY run) AS nh FROM r),
k AS (SELECT * FROM p WHERE h > ph AND h > nh AND n > 5),
s AS (SELECT k.station_id, k.run, coalesce(max(CASE WHEN r.run < k.run AND r.h > k.h THEN r.run END), 0) AS lo, coalesce(min(CASE WHEN r.run > k.run AND r.h > k.h THEN r.run END), 1000000000) AS hi FROM k JOIN r USING (station_id) GROUP BY 1, 2),
x AS (SELECT k.station_id, k.run, k.h, k.a, k.b, k.rg, min(CASE WHEN r.run <= k.run THEN r.h END) AS ml, min(CASE WHEN r.run >= k.run THEN r.h END) AS mr FROM k JOIN s USING (station_id, run) JOIN r ON r.station_id = k.station_id AND r.run > s.lo AND r.run < s.hi GROUP BY ALL),
pk AS (SELECT v.station_id, v.day, v.value FROM x JOIN v ON v.station_id = x.station_id AND v.i = (x.a + x.b) // 2 WHERE x.h - greatest(x.ml, x.mr) >= greatest(0.03 * x.rg, 1e-6))"""


@add(f"WITH {PEAKS} SELECT station_id, CAST(day AS VARCHAR) AS day, {near('value')} AS value FROM pk")
def peaks_prominence(spark, d):
    return L.prominent_peaks(L.every_day(_days(spark, d)))


@add(f"""WITH {PEAKS}, z AS (SELECT e.station_id, e.day, row_number() OVER w AS i, pk.day IS NOT NULL AS peak FROM e LEFT JOIN pk USING (station_id, day) WINDOW w AS (PARTITION BY e.station_id ORDER BY e.day))
SELECT station_id, CAST(day AS VARCHAR) AS day, i - last_value(CASE WHEN peak THEN i END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_last_peak FROM z""")
def days_since_peak(spark, d):
    days = L.every_day(_days(spark, d))
    return L.days_since_peak(days, L.prominent_peaks(days))


@add(f"""WITH {DAYS}, v AS (SELECT *, lag(value) OVER (PARTITION BY station_id ORDER BY day) AS p FROM d WHERE value IS NOT NULL),
k AS (SELECT *, sum(CASE WHEN abs(value - p) <= 1e-6 + 1e-5 * abs(p) THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY day) AS run FROM v),
n AS (SELECT station_id, run, count(*) AS n FROM k GROUP BY 1, 2) SELECT station_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) END AS longest_stuck_run_days FROM n GROUP BY 1""")
def stuck_run(spark, d):
    return L.stuck_run(_days(spark, d))


SIGNED = "arg_max(z, CASE WHEN z IS NOT NULL THEN {'a': abs(z), 'b': -epoch(label_date)} END)"


@add(f"""WITH x AS (SELECT *, CASE WHEN NOT isnan(standardized_anomaly) THEN standardized_anomaly END AS z, CASE WHEN NOT isnan(baseflow_index) THEN baseflow_index END AS b,
 CASE WHEN NOT isnan(level_percentile) THEN level_percentile END AS p, CASE WHEN NOT isnan(recession_rate_7d) THEN recession_rate_7d END AS r, CASE WHEN NOT isnan(mean_level) THEN mean_level END AS l FROM antecedent_labels)
SELECT station_id, count(*) AS n_rows, count(DISTINCT label_date) AS n_days, CAST(min(label_date) AS VARCHAR) AS date_min, CAST(max(label_date) AS VARCHAR) AS date_max,
 max(label_date) - min(label_date) + 1 - count(DISTINCT label_date) AS n_missing_days, {near('min(l)')} AS level_min, {near('max(l)')} AS level_max,
 count(*) FILTER (WHERE p < 0 OR p > 100) AS percentile_out, count(*) FILTER (WHERE b < -1e-6 OR b > 1 + 1e-6) AS baseflow_out, {near('100.0 * count(*) FILTER (WHERE b IS NULL) / count(*)', 1)} AS baseflow_nan_pct,
 count(*) FILTER (WHERE abs(z) > 8) AS anomaly_extremes, count(*) FILTER (WHERE days_since_last_peak = 0) AS n_peaks,
 {near('100.0 * count(*) FILTER (WHERE z IS NULL) / count(*)', 1)} AS anomaly_nan_pct, {near('100.0 * count(*) FILTER (WHERE r IS NULL) / count(*)', 1)} AS recession_nan_pct,
 {near('count(*) / nullif(count(*) FILTER (WHERE days_since_last_peak = 0), 0)', 1)} AS days_per_peak,
 CASE WHEN isinf(max(abs(z))) THEN NULL ELSE {near(SIGNED)} END AS extreme_signed,
 CAST(arg_max(label_date, CASE WHEN z IS NOT NULL THEN {{'a': abs(z), 'b': -epoch(label_date)}} END) AS VARCHAR) AS extreme_date, CASE WHEN isinf(max(abs(z))) THEN NULL ELSE {near('max(abs(z))')} END AS anomaly_max_abs FROM x WHERE station_id IS NOT NULL GROUP BY 1""")
def label_qa(spark, d):
    got = L.label_quality(table(spark, d, "antecedent_labels"))
    top = F.col("anomaly_max_abs")
    finite = got.withColumn("extreme_signed", F.when(top < float("inf"), F.col("extreme_signed"))).withColumn("anomaly_max_abs", F.when(top < float("inf"), top))
    return tidy(finite, baseflow_nan_pct=1, anomaly_nan_pct=1, recession_nan_pct=1, days_per_peak=1)


@add(f"""WITH {DAYS}, v AS (SELECT *, lag(value) OVER (PARTITION BY station_id ORDER BY day) AS p FROM d WHERE value IS NOT NULL),
k AS (SELECT *, sum(CASE WHEN abs(value - p) <= 1e-6 + 1e-5 * abs(p) THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY day) AS run FROM v),
n AS (SELECT station_id, run, count(*) AS n FROM k GROUP BY 1, 2), s AS (SELECT station_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) END AS stuck FROM n GROUP BY 1),
q AS (SELECT station_id, count(*) FILTER (WHERE NOT isnan(level_percentile) AND (level_percentile < 0 OR level_percentile > 100)) AS po, count(*) FILTER (WHERE NOT isnan(baseflow_index) AND (baseflow_index < -1e-6 OR baseflow_index > 1 + 1e-6)) AS bo,
 count(*) FILTER (WHERE NOT isnan(standardized_anomaly) AND abs(standardized_anomaly) > 8) AS ae FROM antecedent_labels WHERE station_id IS NOT NULL GROUP BY 1)
SELECT station_id, po AS percentile_out, bo AS baseflow_out, coalesce(stuck, 0) AS longest_stuck_run_days, ae AS anomaly_extremes FROM q LEFT JOIN s USING (station_id) WHERE po > 0 OR bo > 0 OR coalesce(stuck, 0) >= 14 OR ae > 0""")
def label_review(spark, d):
    """Stations that fail any of the four label checks."""
    return L.needs_review(L.label_quality(table(spark, d, "antecedent_labels")), L.stuck_run(_days(spark, d)))


@add(f"""WITH {DAYS}, y AS (SELECT station_id, year(day) AS y, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT station_id, CASE WHEN count(*) < max(y) - min(y) + 1 THEN 0 ELSE min(n) END AS label_days_min_year FROM y GROUP BY 1),
q AS (SELECT station_id, CASE WHEN count(*) > 20 THEN quantile_cont(value, 0.95) - quantile_cont(value, 0.05) END AS r FROM d WHERE value IS NOT NULL GROUP BY 1)
SELECT station_id, label_days_min_year, {near('r')} AS label_range FROM k JOIN q USING (station_id)""")
def label_range(spark, d):
    return L.label_range(_days(spark, d))


@add(f"""WITH {DAYS}, s AS (SELECT station_id, day - lag(day) OVER (PARTITION BY station_id ORDER BY day) AS step FROM d),
n AS (SELECT station_id, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT station_id, arg_max(step, n * 100000 - step) AS mode_days, {near('max(n) / sum(n)')} AS mode_share, max(step) AS max_days, max(med) AS median_days FROM n JOIN (SELECT station_id, median(step) AS med FROM s WHERE step IS NOT NULL GROUP BY 1) USING (station_id) GROUP BY 1""")
def gap_mode(spark, d):
    return S.modal_gap(_days(spark, d))


@add(f"""WITH {READ}, {_grid(86400)}, x AS (SELECT station_id, CAST(make_timestamp(bin_s * 1000000) AS DATE) AS day, value FROM g), {DAYS.replace('d AS', 'd AS', 1)}
SELECT x.station_id, count(*) AS shared_days, {near('max(abs(x.value - d.value))')} AS max_abs_diff FROM x JOIN d USING (station_id, day) WHERE x.value IS NOT NULL AND d.value IS NOT NULL GROUP BY 1""")
def recompute_check(spark, d):
    """Daily means from readings against the stored daily levels."""
    fresh = S.resample(_readings(spark, d), 86400).select("station_id", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("bin_s") / 86400).cast("int")).alias("day"), F.col("value").alias("v"))
    both = fresh.join(_days(spark, d), ["station_id", "day"]).filter("v is not null and value is not null")
    return both.groupBy("station_id").agg(F.count("*").alias("shared_days"), F.max(F.abs(F.col("v") - F.col("value"))).alias("max_abs_diff"))


@add("""SELECT file_id, n, nth FROM (SELECT file_id, n, row_number() OVER (PARTITION BY station_ref ORDER BY downloaded_at DESC, file_id DESC) AS nth FROM (SELECT f.*, count(g.reading_id) AS n FROM gauge_files f LEFT JOIN gauge_readings g USING (file_id) GROUP BY ALL)) WHERE nth = 1""")
def keep_last_file(spark, d):
    """The file of each gauge that came last, with its number of readings."""
    n = table(spark, d, "gauge_readings").groupBy("file_id").agg(F.count("reading_id").alias("n"))
    files = table(spark, d, "gauge_files").join(n, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("station_ref").orderBy(F.desc("downloaded_at"), F.desc("file_id")))
    return files.withColumn("nth", nth).filter("nth = 1").select("file_id", "n", "nth")


also_named_all(
    add, ORACLE, typed_readings, download_summary, resample_quarter, resample_hourly_sum, resample_daily, completeness_report, gap_islands, availability,
    dedup_keep_first, recompute_check,
)
