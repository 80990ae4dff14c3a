"""Queries of verification, reconciliation, lookup and model-input operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import encoders
from tidemark.operators import drift
from tidemark.operators import features as X
from tidemark.operators import jobs as J
from tidemark.operators import labels as L
from tidemark.operators import raster as P
from tidemark.operators import selection as C
from tidemark.operators import timeseries as S
from tidemark.operators.places import numbered, running_total
from tidemark.plans.models import CELLS, PIXELS, SCENES, SHORT, SIMPLE, _jobs, _pixels, _predictions, _scenes, _series, _short
from tidemark.plans.series import DAYS, READ, _days, _grid, _readings, also_named_all
from tidemark.plans.tidy import near, query
from tidemark.session import table
from tidemark.sources import readings as R
from tidemark.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
add = query(QUERIES, ORACLE)


@add("""WITH q AS (SELECT station_id, count(*) AS n, count(*) FILTER (WHERE abs(standardized_anomaly) > 8 AND NOT isnan(standardized_anomaly)) AS extreme, count(*) FILTER (WHERE level_percentile < 0 OR level_percentile > 100) AS off,
 count(*) FILTER (WHERE baseflow_index IS NULL OR isnan(baseflow_index)) AS gone FROM antecedent_labels GROUP BY 1) SELECT station_id, n, extreme, off, gone FROM q WHERE extreme > 0 OR off > 0 OR gone > 0.5 * n""")
def label_flags(spark, d):
    """Stations whose labels a reviewer should see."""
    z, b, p = F.col("standardized_anomaly"), F.col("baseflow_index"), F.col("level_percentile")
    got = table(spark, d, "antecedent_labels").groupBy("station_id").agg(
        F.count("*").alias("n"), F.count_if((F.abs(z) > 8) & ~F.isnan(z)).alias("extreme"), F.count_if((p < 0) | (p > 100)).alias("off"), F.count_if(b.isNull() | F.isnan(b)).alias("gone")
    )
    return got.filter((F.col("extreme") > 0) | (F.col("off") > 0) | (F.col("gone") > 0.5 * F.col("n")))


@add(f"WITH {READ} SELECT station_id, count(*) AS n, {near('avg(value)')} AS level FROM t WHERE ts >= TIMESTAMP '2019-01-01' AND ts < TIMESTAMP '2024-01-01' GROUP BY 1")
def half_open_window(spark, d):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2019-01-01", "2024-01-01"))
    return _readings(spark, d).filter((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy("station_id").agg(F.count("*").alias("n"), F.avg("value").alias("level"))


@add(f"WITH {PIXELS}, s AS (SELECT *, (row * 8 + col + vec_id) % 12 AS scl FROM px) SELECT site, CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE scl NOT IN (0, 1, 3, 8, 9, 10)) AS clear, {near('avg(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10) THEN v END)')} AS mean FROM s GROUP BY site, day")
def cloud_mask(spark, d):
    """Pixels of clear classes; the class of a pixel follows from its place and scene."""
    px = _pixels(spark, d).withColumn("scl", (F.col("row") * 8 + F.col("col") + F.datediff("day", F.lit("2015-01-01").cast("date"))) % 12)
    ok = P.clear_sky(F.col("scl"))
    return px.groupBy("site", "day").agg(F.count_if(ok).alias("clear"), F.avg(F.when(ok, F.col("v"))).alias("mean"))


@add(f"""WITH {CELLS}, b AS (SELECT 'B' || pos AS band, avg(x) AS m, stddev_pop(x) AS s FROM k GROUP BY 1) SELECT vec_id, 'B' || pos AS band, {near('(x - m) / s')} AS z FROM k JOIN b ON b.band = 'B' || k.pos""")
def band_standardise(spark, d):
    """Bands against their statistics over the whole table, looked up by name."""
    cells = X.long_vectors(_scenes(spark, d), ["vec_id"], "embedding").select("vec_id", F.concat(F.lit("B"), "pos").alias("band"), "x")
    bands = cells.groupBy("band").agg(F.avg("x").alias("band_mean"), F.stddev_pop("x").alias("band_std"))
    return P.standardise(cells, bands).select("vec_id", "band", "z")


@add(f"""WITH {SCENES}, v AS (SELECT site, count(*) AS dates, count(*) FILTER (WHERE list_count(list_filter(embedding, lambda x: NOT isfinite(x))) = 0) AS good, min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM z GROUP BY 1)
SELECT site, dates, CASE WHEN dates < 5 THEN 'too few dates' WHEN lo <> hi THEN 'lengths differ' WHEN good = 0 THEN 'nothing finite' ELSE 'ok' END AS verdict FROM v""")
def verify_outputs(spark, d):
    got = _scenes(spark, d).groupBy("site").agg(
        F.count("*").alias("dates"), F.count_if(X.usable_vector("embedding")).alias("good"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")
    )
    verdict = F.when(F.col("dates") < 5, "too few dates").when(F.col("lo") != F.col("hi"), "lengths differ").when(F.col("good") == 0, "nothing finite").otherwise("ok")
    return got.select("site", "dates", verdict.alias("verdict"))


@add("""WITH w AS (SELECT station_ref, year(downloaded_at) AS y, count(*) AS files, count(*) FILTER (WHERE n > 0) AS filled FROM gauge_files LEFT JOIN (SELECT file_id, count(*) AS n FROM gauge_readings GROUP BY 1) USING (file_id) GROUP BY 1, 2)
SELECT station_ref, y, files, filled = files AS complete FROM w""")
def complete_units(spark, d):
    """Units (gauge and year) all of whose files brought readings."""
    n = table(spark, d, "gauge_readings").groupBy("file_id").agg(F.count("*").alias("n"))
    files = table(spark, d, "gauge_files").join(n, "file_id", "left")
    return files.groupBy("station_ref", F.year("downloaded_at").alias("y")).agg(F.count("*").alias("files"), F.bool_and(F.coalesce(F.col("n") > 0, F.lit(False))).alias("complete"))


@add(f"""WITH {SCENES}, {DAYS}, s AS (SELECT row_number() OVER (ORDER BY station_id) - 1 AS site, station_id FROM (SELECT DISTINCT station_id FROM d)),
l AS (SELECT CAST(s.site AS BIGINT) AS site, d.day, d.value FROM d JOIN s USING (station_id)) SELECT z.vec_id, {near('l.value')} AS level FROM z LEFT JOIN l ON l.site = z.site AND l.day = CAST(z.day + 1000 AS DATE)""")
def features_with_labels(spark, d):
    """Left join of scenes to daily levels on site and day; scenes without a level stay."""
    days = _days(spark, d)
    ids = numbered(days.select("station_id").distinct(), ["station_id"], "site")
    labels = days.join(ids, "station_id").select("site", "day", F.col("value").alias("level"))
    scenes = _scenes(spark, d).select("vec_id", "site", F.date_add("day", 1000).alias("day"))
    return scenes.join(labels, ["site", "day"], "left").select("vec_id", "level")


@add(f"""WITH {READ}, a AS (SELECT station_id, CAST(ts AS DATE) AS day, 1 AS one FROM t WHERE ts IS NOT NULL GROUP BY 1, 2), b AS (SELECT station_id, label_date AS day FROM antecedent_labels),
x AS (SELECT station_id, day, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT station_id, day, count(*) AS n FROM b GROUP BY 1, 2)
SELECT coalesce(x.station_id, y.station_id) AS station_id, CAST(coalesce(x.day, y.day) AS VARCHAR) AS day, coalesce(x.n, 0) AS n_left, coalesce(y.n, 0) AS n_right FROM x FULL JOIN y ON x.station_id = y.station_id AND x.day = y.day WHERE coalesce(x.n, 0) <> 1 OR coalesce(y.n, 0) <> 1""")
def reconcile_days(spark, d):
    """Days that only readings or only labels have, or that labels have twice."""
    a = _readings(spark, d).filter("ts is not null").select("station_id", F.to_date("ts").alias("day")).distinct()
    return X.reconcile(a, table(spark, d, "antecedent_labels").select("station_id", F.col("label_date").alias("day")), ["station_id", "day"])


@add(f"""WITH {CELLS}, m AS (SELECT site, CAST(day AS DATE) AS day, pos, x FROM k), t AS (SELECT site, max(day) - n AS target FROM m, unnest([0, 120, 240]) AS u(n) GROUP BY site, n),
q AS (SELECT t.site, t.target, pos AS series, 11 - (target - day) // 30 AS step, avg(x) AS v FROM t JOIN m USING (site) WHERE target - day BETWEEN 0 AND 359 GROUP BY ALL),
g AS (SELECT DISTINCT site, target, series FROM q) SELECT g.site, CAST(g.target AS VARCHAR) AS target_day, g.series, CAST(s.step AS BIGINT) AS step, {near('coalesce((v + 25) / 25, 0)')} AS x, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS mask
FROM g CROSS JOIN (SELECT unnest(range(0, 12)) AS step) s LEFT JOIN q ON q.site = g.site AND q.target = g.target AND q.series = g.series AND q.step = s.step""")
def masked_model_input(spark, d):
    cells, targets = _series(spark, d)
    rows = P.model_input(P.temporal_bins(targets, cells))
    zipped = F.arrays_zip("x", "mask")
    return rows.select("site", "target_day", "series", F.posexplode(zipped).alias("step", "c")).select("site", "target_day", "series", "step", "c.x", "c.mask")


@add(f"""WITH {CELLS}, m AS (SELECT site, CAST(day AS DATE) AS day, pos, x FROM k), t AS (SELECT site, max(day) - n AS target FROM m, unnest([0, 120, 240]) AS u(n) GROUP BY site, n),
q AS (SELECT t.site, t.target, pos AS series, 11 - (target - day) // 30 AS step, avg(x) AS v FROM t JOIN m USING (site) WHERE target - day BETWEEN 0 AND 359 GROUP BY ALL),
p AS (SELECT site, target, series, count(*) AS steps, avg(v) AS v FROM q GROUP BY ALL), o AS (SELECT site, day AS target, count(DISTINCT pos) AS seen FROM m GROUP BY ALL),
k2 AS (SELECT site, target, count(*) AS n, avg(steps) AS ms, avg(v) AS v FROM p WHERE steps >= 2 GROUP BY ALL)
SELECT g.site, CAST(g.target AS VARCHAR) AS target_day, coalesce(k2.n, 0) AS n_series, {near('ms')} AS mean_steps, {near('CASE WHEN coalesce(seen, 0) >= 20 AND coalesce(k2.n, 0) >= 20 THEN k2.v END')} AS pooled
FROM (SELECT DISTINCT site, target FROM p) g LEFT JOIN k2 USING (site, target) LEFT JOIN o USING (site, target)""")
def gated_pooling(spark, d):
    cells, targets = _series(spark, d)
    return P.gated_pool(P.temporal_bins(targets, cells), cells)


@add("""WITH y AS (SELECT station_ref AS site, year(downloaded_at) AS year, seq_no AS series, longitude AS x, latitude AS y FROM gauge_files JOIN (SELECT station_id, max(longitude) AS longitude, max(latitude) AS latitude FROM catchment_level_shortlist GROUP BY 1) ON station_id = station_ref)
SELECT site, year, pixels, min(year) OVER (PARTITION BY site, p) AS "group" FROM (SELECT site, year, count(DISTINCT series) AS pixels, list_sort(list(DISTINCT concat_ws('|', series, round(x, 6) + 0.0, round(y, 6) + 0.0)))::VARCHAR AS p FROM y GROUP BY 1, 2)""")
def cube_groups(spark, d):
    """Series of each unit, and the first year of the site whose series lie at the same coordinates."""
    at = table(spark, d, "catchment_level_shortlist").groupBy("station_id").agg(F.max("longitude").alias("x"), F.max("latitude").alias("y"))
    cube = table(spark, d, "gauge_files").join(at, F.col("station_id") == F.col("station_ref")).select(
        F.col("station_ref").alias("site"), F.year("downloaded_at").alias("year"), F.col("seq_no").alias("series"), "x", "y"
    )
    return P.coordinate_groups(cube).select("site", "year", "pixels", "group")


@add(f"""WITH {SHORT}, b AS (SELECT station_id, load_no, pct, gap FROM s WHERE pct IS NOT NULL AND gap IS NOT NULL)
SELECT station_id, load_no, {near('100.0 * (rank() OVER (ORDER BY pct) + (count(*) OVER (PARTITION BY pct) - 1) / 2.0) / count(*) OVER () + 100.0 * (rank() OVER (ORDER BY -gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2.0) / count(*) OVER ()', 3)} AS quality FROM b""")
def quality_score(spark, d):
    """Percentile rank of completeness plus that of short gaps; ranks come from counted values, numbered range by range."""
    from tidemark.plans.tidy import tidy

    rows = _short(spark, d).filter("pct is not null and gap is not null").select("station_id", "load_no", "pct", (-F.col("gap")).alias("short"))
    n = rows.count()
    for c in ("pct", "short"):
        values = rows.groupBy(c).agg(F.count("*").alias("k"))
        ranks = running_total(values, [c], "k", "upto").select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r_{c}"))
        rows = rows.join(ranks, c)
    return tidy(rows.select("station_id", "load_no", (100 * (F.col("r_pct") + F.col("r_short")) / F.lit(n)).alias("quality")), quality=3)


@add(f"""WITH {DAYS} SELECT CAST(day AS VARCHAR) AS day, {near("max(CASE WHEN right(station_id, 1) = '1' THEN value END)")} AS one, {near("max(CASE WHEN right(station_id, 1) = '2' THEN value END)")} AS two FROM d GROUP BY day""")
def wide_daily(spark, d):
    """Days by station group as columns, for a list of groups known beforehand."""
    days = _days(spark, d).withColumn("group", F.when(F.right("station_id", F.lit(1)) == "1", "one").when(F.right("station_id", F.lit(1)) == "2", "two"))
    top = days.groupBy("day", "group").agg(F.max("value").alias("value"))
    return sinks.wide_panel(top, "day", "group", "value", ["one", "two"])


@add(r"""SELECT file_name, CASE WHEN regexp_matches(file_name, '^wl_\d+_001\.csv$') THEN 'first' WHEN regexp_matches(file_name, '^wl_\d+_\d+\.csv$') THEN 'later' ELSE 'other' END AS kind, 'gauges/' || station_ref || '/' || file_name AS target FROM gauge_files WHERE file_id NOT IN (SELECT file_id FROM gauge_readings)""")
def migration_plan(spark, d):
    """Where files without readings would move, never over a file that has some."""
    taken = table(spark, d, "gauge_readings").select("file_id").distinct()
    name = F.col("file_name")
    kind = F.when(name.rlike(r"^wl_\d+_001\.csv$"), "first").when(name.rlike(r"^wl_\d+_\d+\.csv$"), "later").otherwise("other")
    rows = table(spark, d, "gauge_files").join(taken, "file_id", "left_anti")
    return rows.select("file_name", kind.alias("kind"), F.concat(F.lit("gauges/"), "station_ref", F.lit("/"), name).alias("target"))


@add()
def principal_scores(spark, d):
    """First three components of the vectors; signs are free, so SQL can't repeat them."""
    return X.principal_components(_scenes(spark, d), "embedding", 3)[0].select("vec_id", F.col("scores")[0].alias("s0"), F.col("scores")[1].alias("s1"), F.col("scores")[2].alias("s2"))


@add()
def vector_health(spark, d):
    """Dead dimensions, spread and explained variance of all vectors."""
    return X.vector_health(_scenes(spark, d), "embedding")


@add(f"""WITH {CELLS}, s AS (SELECT pos, stddev_pop(x) AS sd, var_pop(x) AS v FROM k GROUP BY 1), l AS (SELECT avg(l) AS l, count(*) AS n FROM (SELECT vec_id, sqrt(sum(x * x)) AS l FROM k GROUP BY 1))
SELECT n, {near('(SELECT avg(CASE WHEN sd < 1e-6 THEN 1.0 ELSE 0.0 END) FROM s)')} AS dead_share, {near('(SELECT sqrt(sum(v)) FROM s) / l')} AS relative_spread FROM l""")
def vector_spread(spark, d):
    return X.vector_health(_scenes(spark, d), "embedding").select("n", "dead_share", "relative_spread")


@add(f"""WITH {SCENES}, k AS (SELECT vec_id, (i - 1) // 16 AS band, CAST(embedding[i] AS DOUBLE) AS x FROM z, unnest(range(1, len(embedding) + 1)) AS u(i)), m AS (SELECT vec_id, band, avg(x) AS a, stddev_pop(x) AS s FROM k GROUP BY 1, 2)
SELECT vec_id, band AS pos, {near('a')} AS x FROM m UNION ALL SELECT vec_id, 4 + band, {near('s')} FROM m""")
def dummy_embedding(spark, d):
    """Mean and deviation of each of four bands by the encoder that needs no weights."""
    return _scenes(spark, d).select("vec_id", F.posexplode(encoders.encode("embedding", 4)).alias("pos", "x"))


BANDS = f"{SCENES}, w AS (SELECT vec_id, site, day, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS vv, CAST(embedding[i + 32] AS DOUBLE) AS vh FROM z, unnest(range(1, 33)) AS u(i))"


def _bands(spark, d):
    """The halves of a vector as two bands of the same pixels."""
    both = F.arrays_zip(F.slice("embedding", 1, 32).alias("vv"), F.slice("embedding", 33, 32).alias("vh"))
    cells = _scenes(spark, d).select("vec_id", "site", "day", F.posexplode(both).alias("i", "b"))
    return cells.select("vec_id", "site", "day", "i", F.col("b.vv").cast("double").alias("vv"), F.col("b.vh").cast("double").alias("vh"))


@add(f"""WITH {BANDS}, k AS (SELECT *, coalesce(vv > 0 AND vh > 0, false) AS ok FROM w) SELECT site, CAST(day AS VARCHAR) AS day, {near('count(*) FILTER (WHERE ok) / count(*)')} AS valid_frac,
 {near('avg(vv) FILTER (WHERE ok)')} AS vv_mean, {near('stddev_pop(vv) FILTER (WHERE ok)')} AS vv_std, {near('avg(10 * log10(greatest(vv, 1e-6))) FILTER (WHERE ok)', 4)} AS vv_db_mean,
 {near('avg(vh) FILTER (WHERE ok)')} AS vh_mean, {near('stddev_pop(vh) FILTER (WHERE ok)')} AS vh_std, {near('avg(10 * log10(greatest(vh, 1e-6))) FILTER (WHERE ok)', 4)} AS vh_db_mean FROM k GROUP BY site, day""")
def zonal_bands(spark, d):
    """Statistics of two bands over the pixels that are valid in both."""
    from tidemark.plans.tidy import tidy

    return tidy(P.zonal_bands(_bands(spark, d), ["vv", "vh"]), vv_db_mean=4, vh_db_mean=4)


@add(f"""WITH {BANDS}, k AS (SELECT *, (i + vec_id) % 12 NOT IN (0, 1, 3, 8, 9, 10) AS ok, CASE WHEN vv + vh <> 0 THEN (vv - vh) / (vv + vh) END AS nd FROM w)
SELECT site, CAST(day AS VARCHAR) AS day, {near('avg(nd) FILTER (WHERE ok)', 3)} AS index_mean, {near('count(*) FILTER (WHERE ok) / count(*)')} AS valid_frac FROM k GROUP BY site, day""")
def index_means(spark, d):
    """Mean index of two bands over clear pixels, with their share."""
    from tidemark.plans.tidy import tidy

    rows = _bands(spark, d).withColumn("scl", ((F.col("i") + F.col("vec_id")) % 12).cast("int"))
    return tidy(P.index_means(rows, "vv", "vh", "scl"), index_mean=3)


@add(r"""SELECT station_ref, file_name, CASE WHEN regexp_full_match(file_name, 'wl_' || station_ref || '_002\.csv') THEN 0 ELSE 1 END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY station_ref ORDER BY CASE WHEN regexp_full_match(file_name, 'wl_' || station_ref || '_002\.csv') THEN 0 ELSE 1 END, file_name) AS k
 FROM gauge_files WHERE regexp_full_match(file_name, 'wl_' || station_ref || '_\d+\.csv')) WHERE k = 1""")
def preferred_file(spark, d):
    """The file of each gauge by patterns in order of preference."""
    got = R.preferred_file(table(spark, d, "gauge_files"), "station_ref", "file_name", [r"^wl_{station}_002\.csv$", r"^wl_{station}_\d+\.csv$"])
    return got.select("station_ref", "file_name", "priority")


@add(r"""WITH l AS (SELECT file_id, line_no, rtrim(ltrim(line, chr(65279)), chr(13) || chr(10) || ' ') AS t FROM raw_gauge_lines WHERE line IS NOT NULL AND file_id IS NOT NULL),
m AS (SELECT * FROM l WHERE trim(t) <> '' AND t NOT LIKE '#%'), h AS (SELECT file_id, arg_min(t, line_no) AS hd, min(line_no) AS no FROM m GROUP BY 1),
n AS (SELECT file_id, count(DISTINCT t) AS n FROM m JOIN h USING (file_id) WHERE line_no > no AND t <> hd GROUP BY 1), q AS (SELECT file_id, count(*) FILTER (WHERE t LIKE '#%') AS n_meta FROM l GROUP BY 1)
SELECT file_id, CASE WHEN n_meta > 0 THEN 'headed' ELSE 'plain' END AS form, n_meta, coalesce(n, 0) AS n_data, CASE WHEN n > 0 THEN 'ok' ELSE 'no_data' END AS status FROM q LEFT JOIN n USING (file_id)""")
def landed_files(spark, d):
    """The form of each landed file, its rows, and an error status for files without any."""
    return drift.file_status(table(spark, d, "raw_gauge_lines"))


@add("""WITH h AS (SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type = 'click') AS c, count(DISTINCT event_type) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY 1)
SELECT c_custkey AS unit, concat_ws(',', CASE WHEN coalesce(c, 0) = 0 THEN 'click' END, CASE WHEN coalesce(v, 0) = 0 THEN 'view' END) AS missing, coalesce(c, 0) > 0 AND coalesce(v, 0) > 0 AS complete FROM customer LEFT JOIN h ON h.user_id = c_custkey""")
def complete_sensors(spark, d):
    """Units that have every wanted sensor, and which they lack."""
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"))
    return J.complete_over(units, table(spark, d, "events").select(F.col("user_id").alias("unit"), "event_type"), ["unit"], "event_type", ["click", "view"]).select("unit", "missing", "complete")


FORCED = "07"


@add(f"""WITH {SHORT}, {DAYS}, y AS (SELECT station_id, year(day) AS y, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY 1, 2),
lb AS (SELECT station_id, CASE WHEN count(*) < max(y) - min(y) + 1 THEN 0 ELSE min(n) END AS least FROM y GROUP BY 1),
q AS (SELECT s.station_id, load_no, least, CASE WHEN coalesce(pct >= 70, false) THEN '' ELSE 'incomplete,' END || CASE WHEN coalesce(least >= 100, false) THEN '' ELSE 'labels,' END AS reasons FROM s LEFT JOIN lb USING (station_id))
SELECT station_id, load_no, least AS label_days_min_year, reasons, coalesce(reasons = '' OR right(station_id, 2) = '{FORCED}', false) AS eligible FROM q""")
def eligible_with_labels(spark, d):
    """Eligibility joined with the labels' yearly counts; forced stations stay in whatever they fail."""
    stats = L.label_range(_days(spark, d)).select("station_id", "label_days_min_year")
    rules = {"incomplete": F.col("pct") >= 70, "labels": F.col("label_days_min_year") >= 100}
    rows = C.eligibility(_short(spark, d).join(stats, "station_id", "left"), rules, F.right("station_id", F.lit(2)) == FORCED)
    return rows.select("station_id", "load_no", "label_days_min_year", F.concat_ws("", F.transform("reasons", lambda r: F.concat(r, F.lit(",")))).alias("reasons"), "eligible")


@add(f"""WITH {SHORT}, {DAYS}, q AS (SELECT station_id, CASE WHEN count(*) > 20 THEN quantile_cont(value, 0.95) - quantile_cont(value, 0.05) END AS r FROM d WHERE value IS NOT NULL GROUP BY 1),
f AS (SELECT station_id, load_no, log10(subcatchment_area_km2) AS a, CASE WHEN NOT isnan(latitude) THEN latitude END AS y, r FROM s LEFT JOIN q USING (station_id)), g AS (SELECT * REPLACE (coalesce(r, (SELECT median(r) FROM f)) AS r) FROM f),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(y) AS my, stddev_pop(y) AS sy, avg(r) AS mr, CASE WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1 END AS sr FROM g)
SELECT station_id, load_no, {near('coalesce((a - ma) / sa, 0)')} AS z_area, {near('coalesce((y - my) / sy, 0)')} AS z_lat, {near('coalesce((r - mr) / sr, 0)')} AS z_range FROM g, m""")
def diversity_features(spark, d):
    """Scores of the features by which catchments are chosen; a missing label range counts as the median."""
    stats = L.label_range(_days(spark, d)).select("station_id", F.col("label_range").alias("range"))
    rows = _short(spark, d).join(stats, "station_id", "left").withColumns({"area": F.log10("subcatchment_area_km2"), "lat": F.col("latitude")})
    return C.standard_scores(rows, ["area", "lat", "range"], ("range",)).select("station_id", "load_no", "z_area", "z_lat", "z_range")


@add("""WITH m AS (SELECT o_custkey AS unit, bool_and(o_orderstatus = 'F') AS listed FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), i AS (SELECT unit, max(n) AS most FROM (SELECT user_id AS unit, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT c_custkey AS unit, coalesce(listed, most >= 5, false) AS ready FROM customer LEFT JOIN m ON m.unit = c_custkey LEFT JOIN i ON i.unit = c_custkey""")
def ready_units(spark, d):
    """Units whose raw data are there: by their manifest, or by enough images of one sensor where they have none."""
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"))
    manifest = _jobs(spark, d, "o_orderpriority = '1-URGENT'").select("unit", "status")
    images = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("sensor"))
    return J.ready_units(units, manifest, images, ["unit"]).select("unit", "ready")


@add("""WITH f AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT c_custkey AS unit FROM customer WHERE c_custkey NOT IN (SELECT unit FROM f) ORDER BY 1 LIMIT 50""")
def submissions(spark, d):
    """The open units of one run, fifty at most, as a run submits no more."""
    open_ = J.open_work(table(spark, d, "customer").select(F.col("c_custkey").alias("unit")), _jobs(spark, d).select("unit", "status"), ["unit"])
    return J.submissions(open_, ["unit"], 50)


@add("""WITH e AS (SELECT user_id, event_id, ts, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS r FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e WHERE r = 3) WHERE k = 1""")
def breaker_stops(spark, d):
    """The event of each log at which three failures in a row stop it."""
    return J.breaker_stops(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 20, 3).select("user_id", "event_id")


@add()
def model_fold_wins(spark, d):
    scores = X.fit_quality(_predictions(spark, d), ["target", "model", "f"], "y", "p")
    return X.fold_wins(scores, {m.name: m.matched for m in SIMPLE if m.matched})


@add(f"""WITH {READ}, {_grid(900)}, i AS (SELECT *, count(value) OVER (PARTITION BY station_id ORDER BY bin_s) AS k, max(bin_s) OVER (PARTITION BY station_id) AS z FROM g),
h AS (SELECT station_id, min(bin_s) AS start_s, least(max(bin_s) + 900, max(z)) AS end_s FROM i WHERE value IS NULL GROUP BY station_id, k HAVING least(max(bin_s) + 900, max(z)) - min(bin_s) >= 21600),
l AS (SELECT station_id, count(*) AS n, max(end_s - start_s) / 3600 AS most, list({{'hours': (end_s - start_s) / 3600, 'start_s': start_s, 'end_s': end_s}} ORDER BY end_s - start_s DESC, start_s DESC) AS gaps FROM h GROUP BY 1),
c AS (SELECT station_id, count(*) AS n, count(value) AS v FROM g GROUP BY 1)
SELECT CAST(to_json({{'station_id': station_id, 'total': c.n, 'available': v, 'missing': c.n - v, 'completeness_pct': round_even(100 * (v / c.n), 2), 'passes': v / c.n >= 0.7,
 'n_gaps': coalesce(l.n, 0), 'longest_gap_h': most, 'gaps': gaps}}) AS VARCHAR) AS json FROM c LEFT JOIN l USING (station_id)""")
def gap_reports(spark, d):
    """Nested coverage reports as JSON, one text a station."""
    return sinks.json_report(S.gap_report(S.resample(_readings(spark, d), 900), 900, 6 * 3600))


also_named_all(add, ORACLE, half_open_window, reconcile_days)
