"""Queries of the selection, raster, feature, model and job operators, with the SQL that checks them.

Where the given tables lack a kind of data, they stand in for it: a vector is a scene of a site (its label)
on a day (its number), its elements are the pixels of an 8 x 8 grid; ``orders`` are jobs of a manifest,
``events`` the log of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import crossval as V
from tidemark.operators import features as X
from tidemark.operators import jobs as J
from tidemark.operators import raster as P
from tidemark.operators import selection as C
from tidemark.operators.places import numbered
from tidemark.plans.tidy import near, query
from tidemark.session import table
from tidemark.sources import readings as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
add = query(QUERIES, ORACLE)

ANCHOR = "DATE '2015-01-01'"
WIDTH = 8
#: The given table of vectors.
VECTORS = "embeddings"


def _day(c: str = "vec_id"):
    return F.date_add(F.lit("2015-01-01").cast("date"), F.col(c).cast("int"))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, VECTORS)
    return e.select("vec_id", F.col("label").alias("site"), _day().alias("day"), "embedding")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of positive power; the negative ones are invalid."""
    px = P.as_pixels(table(spark, d, VECTORS), "label", _day(), "embedding", WIDTH)
    return px.withColumn("v", F.when(F.col("v") > 0, F.col("v")))


SCENES = f"z AS (SELECT vec_id, label AS site, {ANCHOR} + CAST(vec_id AS INT) AS day, embedding FROM {VECTORS})"
PIXELS = f"""{SCENES}, px AS (SELECT vec_id, site, day, (i - 1) // 8 AS row, (i - 1) % 8 AS col, CASE WHEN embedding[i] > 0 THEN CAST(embedding[i] AS DOUBLE) END AS v FROM z, unnest(range(1, len(embedding) + 1)) AS u(i))"""
CELLS = f"{SCENES}, k AS (SELECT vec_id, site, day, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM z, unnest(range(1, len(embedding) + 1)) AS u(i))"
SHORT = """s AS (SELECT *, CASE WHEN NOT isnan(sentinel_era_completeness_pct) AND NOT isinf(sentinel_era_completeness_pct) THEN sentinel_era_completeness_pct END AS pct,
 CASE WHEN NOT isnan(sentinel_era_max_gap_days) AND NOT isinf(sentinel_era_max_gap_days) THEN sentinel_era_max_gap_days END AS gap, sentinel_era_span_days AS span FROM catchment_level_shortlist)"""


def _short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catchment_level_shortlist").withColumns({
        "pct": R.finite("sentinel_era_completeness_pct"), "gap": R.finite("sentinel_era_max_gap_days"), "span": F.col("sentinel_era_span_days"),
    })


# --- sources, matching, selection ---------------------------------------------------------------


@add(r"SELECT station_id, load_no, lower(trim(status)) AS status, round(coalesce(try_cast(nullif(regexp_replace(replace(opw_catchment_area, 'km²', ''), '[^\d.]', '', 'g'), '') AS DOUBLE), -1) + 3e-8, 5) AS area FROM catchment_level_shortlist")
def overview_normalised(spark, d):
    rows = table(spark, d, "catchment_level_shortlist")
    return rows.select("station_id", "load_no", F.lower(F.trim("status")).alias("status"), F.coalesce(R.area_number("opw_catchment_area"), F.lit(-1.0)).alias("area"))


@add("SELECT s.station_id, s.load_no, k.station_id IS NOT NULL AS matched FROM catchment_level_shortlist s LEFT JOIN (SELECT DISTINCT station_id FROM antecedent_labels WHERE station_id IS NOT NULL) k USING (station_id)")
def left_match(spark, d):
    got = C.match_flags(table(spark, d, "catchment_level_shortlist").select("station_id", "load_no"), table(spark, d, "antecedent_labels"), "station_id")
    return got


@add("""SELECT station_id, 'left' AS side FROM (SELECT station_ref AS station_id FROM gauge_readings EXCEPT SELECT station_id FROM antecedent_labels)
UNION ALL SELECT station_id, 'right' FROM (SELECT station_id FROM antecedent_labels EXCEPT SELECT station_ref FROM gauge_readings)""")
def anti_both(spark, d):
    a = table(spark, d, "gauge_readings").select(F.col("station_ref").alias("station_id"))
    return C.only_in_either(a, table(spark, d, "antecedent_labels").select("station_id"), "station_id")


@add("SELECT station_id, count(*) AS n FROM antecedent_labels WHERE station_id IN (SELECT station_id FROM catchment_level_shortlist WHERE usable_for_study) GROUP BY 1")
def semi_shortlisted(spark, d):
    ids = table(spark, d, "catchment_level_shortlist").filter("usable_for_study").select("station_id")
    return table(spark, d, "antecedent_labels").join(ids, "station_id", "left_semi").groupBy("station_id").agg(F.count("*").alias("n"))


@add(f"WITH {SHORT} SELECT station_id, load_no, coalesce(span >= 1825 AND pct >= 70 AND gap <= 60, false) AS meets FROM s")
def meets_thresholds(spark, d):
    rows = _short(spark, d).withColumnsRenamed({"span": "span_days", "pct": "completeness_pct", "gap": "max_gap_days"})
    return C.meets_thresholds(rows).select("station_id", "load_no", "meets")


@add(f"""WITH {SHORT}, q AS (SELECT station_id, load_no, CASE WHEN coalesce(usable_for_study, false) THEN '' ELSE 'unusable,' END || CASE WHEN coalesce(pct >= 70, false) THEN '' ELSE 'incomplete,' END
 || CASE WHEN coalesce(gap <= 60, false) THEN '' ELSE 'gap,' END || CASE WHEN coalesce(subcatchment_to_true_area_ratio BETWEEN 0.7 AND 1.3, false) THEN '' ELSE 'area,' END AS reasons FROM s)
SELECT station_id, load_no, reasons, reasons = '' AS eligible FROM q""")
def eligibility(spark, d):
    rules = {
        "unusable": F.col("usable_for_study"), "incomplete": F.col("pct") >= 70, "gap": F.col("gap") <= 60,
        "area": F.col("subcatchment_to_true_area_ratio").between(0.7, 1.3),
    }
    got = C.eligibility(_short(spark, d), rules)
    return got.select("station_id", "load_no", F.concat_ws("", F.transform("reasons", lambda r: F.concat(r, F.lit(",")))).alias("reasons"), "eligible")


@add(f"""WITH {SHORT} SELECT subcatchment_id, station_id, load_no, candidates FROM (SELECT *, count(*) OVER w AS candidates, row_number() OVER (PARTITION BY subcatchment_id ORDER BY pct DESC NULLS LAST, gap ASC NULLS LAST, station_id, load_no) AS k
 FROM s WHERE subcatchment_id IS NOT NULL WINDOW w AS (PARTITION BY subcatchment_id)) WHERE k = 1""")
def best_per_group(spark, d):
    order = [F.coalesce(-F.col("pct"), F.lit(float("inf"))), F.coalesce("gap", F.lit(float("inf"))), F.col("station_id"), F.col("load_no")]
    return C.best_per_group(_short(spark, d).filter("subcatchment_id is not null"), "subcatchment_id", order).select("subcatchment_id", "station_id", "load_no", "candidates")


@add(f"""WITH {SHORT}, f AS (SELECT avg(pct) AS mp, stddev_pop(pct) AS sp, avg(ln(subcatchment_area_km2)) AS ma, stddev_pop(ln(subcatchment_area_km2)) AS sa FROM s WHERE true)
SELECT station_id, load_no, {near('coalesce((pct - mp) / sp, 0)')} AS z_pct, {near('coalesce((ln(subcatchment_area_km2) - ma) / sa, 0)')} AS z_area FROM s, f""")
def feature_scores(spark, d):
    rows = _short(spark, d).withColumn("area", F.ln("subcatchment_area_km2"))
    return C.standard_scores(rows, ["pct", "area"]).select("station_id", "load_no", "z_pct", "z_area")


@add()
def diverse_selection(spark, d):
    """Ten catchments chosen for diversity, and three in reserve; each choice is one pass over the candidates."""
    rows = _short(spark, d).filter("station_id is not null").groupBy("station_id").agg(
        F.max("rbd").alias("rbd"), F.coalesce(F.max("pct"), F.lit(0.0)).alias("pct"), F.coalesce(F.min("gap"), F.lit(1e4)).alias("gap"),
        F.coalesce(F.max(F.ln("subcatchment_area_km2")), F.lit(0.0)).alias("area"),
    )
    scored = C.standard_scores(rows, ["pct", "gap", "area"])
    return C.farthest_points(scored, "station_id", ["z_pct", "z_gap", "z_area"], "rbd", "pct", 10, reserve=3)


@add(f"WITH {SHORT} SELECT rbd, count(*) AS n, {near('min(subcatchment_area_km2)')} AS least, {near('max(subcatchment_area_km2)')} AS most, count(DISTINCT catchment_id) AS catchments FROM s GROUP BY 1")
def selection_spread(spark, d):
    return _short(spark, d).groupBy("rbd").agg(
        F.count("*").alias("n"), F.min("subcatchment_area_km2").alias("least"), F.max("subcatchment_area_km2").alias("most"), F.count_distinct("catchment_id").alias("catchments")
    )


# --- pixels and vectors -------------------------------------------------------------------------

DB = "10 * log10(greatest(v, 1e-6))"


@add(f"""WITH {PIXELS} SELECT site, CAST(day AS VARCHAR) AS day, {near('avg(v)')} AS mean, {near('stddev_pop(v)')} AS std, {near(f'avg(CASE WHEN v IS NOT NULL THEN {DB} END)', 4)} AS db_mean,
 {near(f'stddev_pop(CASE WHEN v IS NOT NULL THEN {DB} END)', 4)} AS db_std, {near(f'median(CASE WHEN v IS NOT NULL THEN {DB} END)', 4)} AS db_median, {near('count(v) / count(*)')} AS valid_frac FROM px GROUP BY site, day""")
def zonal_stats(spark, d):
    from tidemark.plans.tidy import tidy

    return tidy(P.zonal(_pixels(spark, d)), db_mean=4, db_std=4, db_median=4)


@add(f"""WITH {PIXELS} SELECT site, CAST(day AS VARCHAR) AS day, row // 4 AS tile_row, col // 4 AS tile_col, {near('count(v) / 16')} AS valid, {near('avg(v)')} AS mean, {near('stddev_pop(v)')} AS std FROM px
GROUP BY site, day, row // 4, col // 4 HAVING count(v) / 16 >= 0.5""")
def tile_valid(spark, d):
    return P.tiles(_pixels(spark, d), 4, WIDTH, WIDTH)


@add(f"""WITH {PIXELS}, n AS (SELECT a.site, a.day, a.row, a.col, avg(b.v) AS m, count(b.v) AS n FROM px a JOIN px b ON a.site = b.site AND a.day = b.day AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)
SELECT site, CAST(day AS VARCHAR) AS day, row, col, {near('CASE WHEN n >= 5 THEN m END')} AS focal, n FROM n""")
def focal_mean(spark, d):
    px = _pixels(spark, d)
    return P.focal_mean(px, px.select("site", "day", "row", "col"))


@add()
def sampled_pixels(spark, d):
    """Sixteen pixels a site by a seeded hash; the draw is Spark's own hash, so SQL elsewhere can't repeat it."""
    return P.sample_pixels(_pixels(spark, d), 16)


@add(f"""WITH {PIXELS}, w AS (SELECT a.site, a.day, a.row, a.col, a.v AS a, b.v AS b FROM px a JOIN px b ON a.site = b.site AND a.day = b.day AND a.row = b.row AND b.col = a.col + 1)
SELECT site, CAST(day AS VARCHAR) AS day, {near('avg((a - b) / nullif(a + b, 0))')} AS ndi, count(*) AS n FROM w GROUP BY site, day""")
def norm_diff_index(spark, d):
    a = _pixels(spark, d)
    b = a.select("site", "day", "row", (F.col("col") - 1).alias("col"), F.col("v").alias("b"))
    both = a.join(b, ["site", "day", "row", "col"])
    return both.groupBy("site", "day").agg(F.avg(P.difference_index(F.col("v"), F.col("b"))).alias("ndi"), F.count("*").alias("n"))


@add(f"""WITH {CELLS}, m AS (SELECT site, CAST(day AS DATE) AS day, pos, x FROM k), t AS (SELECT site, max(day) - n AS target FROM m, unnest([0, 120, 240]) AS u(n) GROUP BY site, n),
q AS (SELECT t.site, t.target, pos AS series, 11 - (target - day) // 30 AS step, x FROM t JOIN m USING (site) WHERE target - day BETWEEN 0 AND 359)
SELECT site, CAST(target AS VARCHAR) AS target_day, series, step, {near('avg(x)')} AS value, count(x) AS n FROM q GROUP BY ALL""")
def temporal_bins(spark, d):
    cells, targets = _series(spark, d)
    return P.temporal_bins(targets, cells)


def _series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scenes = _scenes(spark, d)
    cells = X.long_vectors(scenes, ["site", "day"], "embedding").withColumnsRenamed({"pos": "series", "x": "v"})
    last = scenes.groupBy("site").agg(F.max("day").alias("last"))
    targets = last.select("site", F.explode(F.array(*[F.date_sub("last", n) for n in (0, 120, 240)])).alias("target_day"))
    return cells, targets


@add(f"""WITH {CELLS}, m AS (SELECT site, CAST(day AS DATE) AS day, pos, x FROM k), t AS (SELECT site, max(day) - n AS target FROM m, unnest([0, 120, 240]) AS u(n) GROUP BY site, n),
q AS (SELECT DISTINCT t.site, t.target, pos AS series, 11 - (target - day) // 30 AS step FROM t JOIN m USING (site) WHERE target - day BETWEEN 0 AND 359),
g AS (SELECT site, target, series, CAST(sum(pow(2, step)) AS BIGINT) AS mask, count(*) AS filled FROM q GROUP BY ALL)
SELECT mask, month(target - 345) AS start_month, count(*) AS n, max(filled) AS filled FROM g GROUP BY ALL""")
def missing_patterns(spark, d):
    cells, targets = _series(spark, d)
    return P.missing_patterns(P.temporal_bins(targets, cells))


@add(f"WITH {CELLS}, m AS (SELECT site, pos, avg(x) AS m, count(*) AS n FROM k GROUP BY 1, 2) SELECT site, pos, {near('m')} AS pooled, n AS n_patches FROM m")
def embed_pool(spark, d):
    got = P.vector_mean(_scenes(spark, d), ["site"])
    return got.select("site", "n_patches", F.posexplode("pooled").alias("pos", "pooled"))


@add(f"""WITH {CELLS}, p AS (SELECT *, vec_id % 12 AS ph FROM k), c AS (SELECT *, x - avg(x) OVER (PARTITION BY site, ph, pos) AS c FROM p), q AS (SELECT *, stddev_pop(c) OVER (PARTITION BY site, pos) AS sd FROM c)
SELECT vec_id, pos, {near('c / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END')} AS z FROM q""")
def group_normalise(spark, d):
    cells = X.long_vectors(_scenes(spark, d).withColumn("ph", X.phase(F.col("day"))), ["vec_id", "site", "ph"], "embedding")
    return X.normalise(cells, "site", "ph").select("vec_id", "pos", "z")


@add(f"""WITH {CELLS}, w AS (SELECT *, avg(x) OVER (PARTITION BY site, pos ORDER BY vec_id RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS m FROM k)
SELECT vec_id, pos, {near('coalesce(m, 0)')} AS context, m IS NULL AS no_past FROM w""")
def causal_context(spark, d):
    cells = X.long_vectors(_scenes(spark, d), ["vec_id", "site"], "embedding")
    return X.causal_context(cells, "site", "vec_id", 30).select("vec_id", "pos", "context", "no_past")


@add(f"WITH {SCENES} SELECT vec_id, vec_id % 12 AS phase, list_count(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS usable FROM z")
def usable_and_phase(spark, d):
    return _scenes(spark, d).select("vec_id", X.phase(F.col("day")).alias("phase"), X.usable_vector("embedding").alias("usable"))


@add(f"""WITH {SCENES}, n AS (SELECT vec_id, site, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nm FROM z), m AS (SELECT *, median(nm) OVER (PARTITION BY site) AS md FROM n),
o AS (SELECT *, median(abs(nm - md)) OVER (PARTITION BY site) AS mad FROM m) SELECT vec_id, {near('abs(nm - md) / greatest(1.4826 * mad, 1e-12)', 4)} AS score, abs(nm - md) / greatest(1.4826 * mad, 1e-12) > 6 AS outlier FROM o""")
def mad_outlier(spark, d):
    from tidemark.plans.tidy import tidy

    rows = _scenes(spark, d).withColumn("nm", X.norm("embedding"))
    return tidy(X.mad_outliers(rows, "site", "nm").select("vec_id", "score", "outlier"), score=4)


@add(f"""WITH {SCENES}, a AS (SELECT vec_id, site, embedding AS va, lead(embedding) OVER (PARTITION BY site ORDER BY vec_id) AS vb FROM z)
SELECT vec_id, {near('list_max(list_transform(list_zip(va, vb), lambda p: abs(CAST(p[1] AS DOUBLE) - p[2])))')} AS max_abs_diff,
 {near('list_sum(list_transform(list_zip(va, vb), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(va, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(vb, lambda x: CAST(x AS DOUBLE) * x))))')} AS cosine FROM a WHERE vb IS NOT NULL""")
def cosine_compare(spark, d):
    """Each vector against the next of its site; ids alone are put in order, the vectors meet by id."""
    z = _scenes(spark, d)
    ids = numbered(z.select("site", "vec_id"), ["site", "vec_id"])
    following = ids.select("site", (F.col("place") - 1).alias("place"), F.col("vec_id").alias("next_id"))
    pairs = ids.join(following, ["site", "place"]).select("vec_id", "next_id")
    nxt = pairs.join(z.select(F.col("vec_id").alias("next_id"), "embedding"), "next_id")
    return X.run_agreement(z, nxt, ["vec_id"], "embedding")


@add(f"""WITH {CELLS}, a AS (SELECT a.site, a.pos AS i, b.pos AS j, avg(a.x * b.x) AS p, count(*) AS n FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY ALL) SELECT site, i, j, {near('p')} AS mean_product, n FROM a""")
def gram_matrix(spark, d):
    return X.gram(_scenes(spark, d), ["site"], "embedding")


# --- models -------------------------------------------------------------------------------------

LAB = """y AS (SELECT DISTINCT station_id, label_date AS day, CASE WHEN isfinite(standardized_anomaly) THEN standardized_anomaly END AS z, CASE WHEN isfinite(level_percentile) THEN level_percentile END AS p FROM antecedent_labels)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "antecedent_labels")
    return rows.select("station_id", F.col("label_date").alias("day"), R.finite("standardized_anomaly").alias("z"), R.finite("level_percentile").alias("p")).distinct()


RANKS = "rank() OVER (PARTITION BY station_id ORDER BY {0}) + (count(*) OVER (PARTITION BY station_id, {0}) - 1) / 2.0"


@add(f"""WITH {LAB}, r AS (SELECT station_id, {RANKS.format('z')} AS a, {RANKS.format('p')} AS b FROM y WHERE z IS NOT NULL AND p IS NOT NULL)
SELECT station_id, count(*) AS n, {near('CASE WHEN count(*) >= 5 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END')} AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    return X.spearman(_labels(spark, d), ["station_id"], "z", "p")


@add(f"WITH {LAB} SELECT station_id, count(*) AS n, {near('sqrt(avg((z - p / 100) * (z - p / 100)))', 4)} AS rmse, {near('CASE WHEN var_pop(z) > 0 THEN 1 - avg((z - p / 100) * (z - p / 100)) / var_pop(z) END', 4)} AS r2 FROM y WHERE z IS NOT NULL AND p IS NOT NULL GROUP BY 1")
def r2_rmse(spark, d):
    from tidemark.plans.tidy import tidy

    return tidy(X.fit_quality(_labels(spark, d).withColumn("q", F.col("p") / 100), ["station_id"], "z", "q"), rmse=4, r2=4)


@add(f"""WITH {LAB}, m AS (SELECT station_id, month(day) AS mo, count(*) AS k, avg(p) AS m, var_pop(p) AS v FROM y WHERE p IS NOT NULL GROUP BY 1, 2), g AS (SELECT station_id, sum(k) AS n, sum(k * m) / sum(k) AS gm, sum(k * v) AS w FROM m GROUP BY 1),
b AS (SELECT m.station_id, max(n) AS n, max(w) AS w, sum(k * (m - gm) * (m - gm)) AS b FROM m JOIN g USING (station_id) GROUP BY 1) SELECT station_id, n, {near('CASE WHEN n >= 10 AND b + w > 0 THEN b / (b + w) END', 4)} AS eta2 FROM b""")
def eta2(spark, d):
    from tidemark.plans.tidy import tidy

    return tidy(X.eta_squared(_labels(spark, d).withColumn("mo", F.month("day")), ["station_id"], "mo", "p"), eta2=4)


FOLD = "o AS (SELECT station_id, day, floor((row_number() OVER (PARTITION BY station_id ORDER BY day) - 1) * 5 / count(*) OVER (PARTITION BY station_id)) AS fold FROM (SELECT DISTINCT station_id, label_date AS day FROM antecedent_labels))"


def _folds(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "antecedent_labels").select("station_id", F.col("label_date").alias("day")).distinct()
    return V.blocked_folds(days, "station_id", ["day"], 5)


@add(f"WITH {FOLD} SELECT station_id, CAST(day AS VARCHAR) AS day, CAST(fold AS BIGINT) AS fold FROM o")
def blocked_folds(spark, d):
    return _folds(spark, d)


@add("WITH o AS (SELECT DISTINCT station_id, label_date AS day, year(label_date) AS y FROM antecedent_labels) SELECT y, dense_rank() OVER (ORDER BY y) - 1 AS fold, count(*) AS n FROM o GROUP BY y")
def loyo_folds(spark, d):
    days = table(spark, d, "antecedent_labels").select("station_id", F.col("label_date").alias("day")).distinct().withColumn("y", F.year("day"))
    return V.group_folds(days, "y").groupBy("y", "fold").agg(F.count("*").alias("n"))


@add("WITH o AS (SELECT DISTINCT station_id, label_date AS day FROM antecedent_labels) SELECT station_id, dense_rank() OVER (ORDER BY station_id) - 1 AS fold, count(*) AS n FROM o GROUP BY station_id")
def loso_folds(spark, d):
    days = table(spark, d, "antecedent_labels").select("station_id", F.col("label_date").alias("day")).distinct()
    return V.group_folds(days, "station_id").groupBy("station_id", "fold").agg(F.count("*").alias("n"))


@add(f"""WITH {FOLD}, b AS (SELECT station_id, fold AS f, min(day) AS lo, max(day) AS hi FROM o GROUP BY 1, 2), x AS (SELECT o.station_id, o.fold, g.f, CASE WHEN o.fold = g.f THEN 'test' WHEN o.day BETWEEN b.lo - 30 AND b.hi + 30 THEN 'purged' ELSE 'train' END AS role
 FROM o CROSS JOIN (SELECT DISTINCT fold AS f FROM o) g LEFT JOIN b ON b.station_id = o.station_id AND b.f = g.f) SELECT station_id, CAST(f AS BIGINT) AS f, role, count(*) AS n FROM x GROUP BY ALL""")
def purge_gap(spark, d):
    return V.fold_roles(_folds(spark, d), "station_id", "day", 30).groupBy("station_id", "f", "role").agg(F.count("*").alias("n"))


def _training_rows(spark: SparkSession, d: str, cv: str = "blocked") -> tuple[DataFrame, int]:
    """vec_id, station_id, day, embedding, the target y and the roles in the folds of a scheme: blocked, loyo or loso."""
    y = F.get("embedding", F.lit(63)).cast("double") + F.get("embedding", F.lit(0)).cast("double")
    e = _scenes(spark, d).filter(X.usable_vector("embedding")).select("vec_id", F.col("site").cast("string").alias("station_id"), "day", "embedding", y.alias("sum"))
    if cv == "blocked":
        rows = V.blocked_folds(e, "station_id", ["vec_id"], 5)
    elif cv == "loyo":
        rows = V.group_folds(e.withColumn("y", F.year("day")), "y", 2).drop("y")
    else:
        rows = V.group_folds(e, "station_id", 2)
    return V.role_arrays(rows, "station_id", "day", 12)


SIMPLE = [
    V.Model("season", (V.Block(((0, 2),)),)), V.Model("half", (V.Block(((0, 32),)),), "season"),
    V.Model("all", (V.Block(((0, 63),)),), "half"), V.Model("pca10", (V.Block(((0, 63),), 10),), "all"),
]


def _predictions(spark: SparkSession, d: str, cv: str = "blocked", **how) -> DataFrame:
    rows, k = _training_rows(spark, d, cv)
    rows = rows.withColumn("x", F.slice("embedding", 1, 63))
    return V.ridge_predictions(rows, "vec_id", ["vec_id"], ["sum"], how.pop("models", SIMPLE), k, **how)


@add()
def ridge_cv(spark, d):
    """Out-of-fold predictions of four ridge models with alphas chosen inside the training rows."""
    return _predictions(spark, d)


@add()
def ridge_loo(spark, d):
    """The same with alphas chosen by leaving out one row at a time."""
    return _predictions(spark, d, choose="loo")


@add()
def ridge_loyo(spark, d):
    """Out-of-fold predictions leaving out one year at a time."""
    return _predictions(spark, d, "loyo")


@add()
def ridge_loso(spark, d):
    """Out-of-fold predictions leaving out one site at a time."""
    return _predictions(spark, d, "loso")


PAIR = f"""{SCENES}, u AS (SELECT vec_id, site, CAST(day AS DATE) AS day, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[64] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) AS y,
 floor((row_number() OVER (PARTITION BY site ORDER BY vec_id) - 1) * 5 / count(*) OVER (PARTITION BY site)) AS fold FROM z WHERE list_count(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
sp AS (SELECT site, fold AS f, min(day) AS lo, max(day) AS hi FROM u GROUP BY 1, 2), fs AS (SELECT DISTINCT fold AS f FROM u),
ro AS (SELECT u.*, fs.f, CASE WHEN fold = fs.f THEN 'test' WHEN day BETWEEN lo - 12 AND hi + 12 THEN 'purged' ELSE 'train' END AS role FROM u CROSS JOIN fs LEFT JOIN sp ON sp.site = u.site AND sp.f = fs.f),
mo AS (SELECT f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM ro WHERE role = 'train' GROUP BY 1),
wt AS (SELECT *, ((n + 10) * n * ca - n * r * n * cb) / ((n + 10) * (n + 10) - n * r * n * r) AS wa, ((n + 10) * n * cb - n * r * n * ca) / ((n + 10) * (n + 10) - n * r * n * r) AS wb FROM mo),
pr AS (SELECT vec_id, site, ro.f, y, my + wa * (a - ma) / sa + wb * (b - mb) / sb AS p FROM ro JOIN wt USING (f) WHERE role = 'test')"""


@add(f"WITH {PAIR} SELECT 'sum' AS target, 'season' AS model, CAST(f AS BIGINT) AS f, vec_id AS row_id, {near('y')} AS y, {near('p')} AS p, 10.0::DOUBLE AS alpha FROM pr")
def ridge_fixed(spark, d):
    """Out-of-fold predictions of the smallest model with a given alpha, which SQL can solve too."""
    return _predictions(spark, d, models=SIMPLE[:1], alphas=[10.0])


@add(f"""WITH {PAIR}, sc AS (SELECT f, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM pr GROUP BY 1)
SELECT 'sum' AS target, 'season' AS model, CAST(f AS BIGINT) AS f, n, {near('rmse')} AS rmse, {near('r2')} AS r2 FROM sc""")
def fold_scores(spark, d):
    """Errors of each fold of ridge_fixed."""
    return X.fit_quality(_predictions(spark, d, models=SIMPLE[:1], alphas=[10.0]), ["target", "model", "f"], "y", "p")


@add()
def model_comparison(spark, d):
    scores = X.fit_quality(_predictions(spark, d), ["target", "model"], "y", "p")
    return V.compare_models(scores)


STATS, EMB, CONTEXT = 4, 59, (14, 30, 60)


@add()
def model_registry(spark, d):
    """The whole registry of models on season, statistics, vectors and their causal context, out of fold, with its report.

    The first elements of a vector stand in for zonal statistics, the rest, but the last, for an embedding.
    """
    rows, k = _training_rows(spark, d)
    cells = X.long_vectors(rows.withColumn("ph", X.phase(F.col("day"))), ["vec_id", "station_id", "ph"], "embedding").filter(F.col("pos") < STATS + EMB)
    cells = X.normalise(cells, "station_id", "ph").select("vec_id", "station_id", "pos", F.col("z").alias("x"))
    for w in CONTEXT:
        cells = X.causal_context(cells, "station_id", "vec_id", w).withColumnRenamed("context", f"c{w}").drop("no_past")
    own = F.sort_array(F.collect_list(F.struct("pos", "x", *[f"c{w}" for w in CONTEXT])))
    made = cells.groupBy("vec_id").agg(own.alias("cells"))
    part = lambda lo, n, of: F.transform(F.slice("cells", lo + 1, n), lambda c: c[of])
    turn = 2 * 3.141592653589793 * F.dayofyear("day") / 365.25
    raw = lambda lo, n: F.transform(F.slice("embedding", lo + 1, n), lambda v: v.cast("double"))
    x = F.concat(
        F.array(F.sin(turn), F.cos(turn)), raw(0, STATS), part(0, STATS, "x"), raw(STATS, EMB), part(STATS, EMB, "x"),
        *[part(0, STATS, f"c{w}") for w in CONTEXT], *[part(STATS, EMB, f"c{w}") for w in CONTEXT],
    )
    widths = {"season": 2, "stats": STATS, "stats_n": STATS, "emb": EMB, "emb_n": EMB, "stats_ctx": STATS * len(CONTEXT), "emb_ctx": EMB * len(CONTEXT)}
    models = V.registry(widths)
    found = V.ridge_predictions(rows.join(made, "vec_id").withColumn("x", x), "vec_id", ["vec_id"], ["sum"], models, k)
    return X.comparison_report(found, {m.name: m.matched for m in models if m.matched})


@add("""WITH m AS (SELECT l_returnflag AS flag, l_linestatus AS st, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1, 2),
u AS (UNPIVOT m ON a, b INTO NAME metric VALUE v) SELECT flag, metric, round(max(CASE WHEN st = 'F' THEN v END) + 3e-8, 5) AS "F", round(max(CASE WHEN st = 'O' THEN v END) + 3e-8, 5) AS "O" FROM u GROUP BY 1, 2""")
def pivot_metrics(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return m.unpivot(["flag", "st"], ["a", "b"], "metric", "v").groupBy("flag", "metric").pivot("st", ["F", "O"]).agg(F.max("v"))


# --- jobs ---------------------------------------------------------------------------------------

JOBS = "j AS (SELECT o_orderkey AS job, o_custkey AS unit, year(o_orderdate) AS y, epoch(o_orderdate) AS stamp, CASE o_orderstatus WHEN 'F' THEN 'DOWNLOADED' WHEN 'O' THEN 'queued' ELSE 'SUBMIT_ERROR: busy' END AS status FROM orders)"


def _jobs(spark: SparkSession, d: str, of: str = "true") -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").filter(of).select(
        F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").alias("at"),
        F.when(s == "F", "DOWNLOADED").when(s == "O", "queued").otherwise("SUBMIT_ERROR: busy").alias("status"),
    )


@add(f"WITH {JOBS} SELECT status, count(*) AS n FROM j GROUP BY 1")
def status_breakdown(spark, d):
    return J.status_counts(_jobs(spark, d), "status")


@add(f"WITH {JOBS} SELECT unit, job, status FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY stamp DESC, job DESC) AS k FROM j) WHERE k = 1")
def manifest_latest(spark, d):
    return J.latest_state(_jobs(spark, d), ["unit"], ["at", "job"]).select("unit", "job", "status")


@add(f"""WITH {JOBS}, u AS (SELECT c_custkey AS unit, y FROM customer, (SELECT DISTINCT y FROM j)), s AS (SELECT DISTINCT unit, y FROM j WHERE status = 'DOWNLOADED'), b AS (SELECT DISTINCT unit, y FROM j)
SELECT unit, y, CASE WHEN s.unit IS NOT NULL THEN 'SKIP' WHEN b.unit IS NOT NULL THEN 'RESUME' ELSE 'NEW' END AS state FROM u LEFT JOIN s USING (unit, y) LEFT JOIN b USING (unit, y)""")
def work_units(spark, d):
    j = _jobs(spark, d)
    years = F.array(*[F.lit(y) for (y,) in sorted(j.select("y").distinct().collect())])  # a number a year
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.explode(years).alias("y"))
    return J.classify_units(units, j.filter("status = 'DOWNLOADED'"), j, ["unit", "y"])


@add(f"WITH {JOBS} SELECT c_custkey AS unit FROM customer WHERE c_custkey NOT IN (SELECT unit FROM j WHERE NOT regexp_matches(lower(status), 'error|fail|cancel'))")
def open_work(spark, d):
    return J.open_work(table(spark, d, "customer").select(F.col("c_custkey").alias("unit")), _jobs(spark, d).select("unit", "status"), ["unit"])


@add("""WITH e AS (SELECT user_id, value < 20 OR value IS NULL AS bad, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i, value FROM events),
n AS (SELECT user_id, i, count(*) AS n FROM e WHERE value < 20 GROUP BY 1, 2) SELECT user_id, max(n) AS longest_streak, count(*) AS streaks FROM n GROUP BY 1""")
def consecutive_failures(spark, d):
    return J.failure_streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 20)


@add("""WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, CAST((rn - 1) // greatest(1, n // 5) + 1 AS BIGINT) AS nth FROM n WHERE (rn - 1) % greatest(1, n // 5) = 0 AND (rn - 1) // greatest(1, n // 5) < 5""")
def systematic_sample(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return J.systematic_sample(rows, "l_suppkey", ["l_orderkey", "l_linenumber"], 5)


@add(f"WITH {JOBS}, u AS (SELECT unit, bool_and(status = 'DOWNLOADED') AS ready, count(*) AS jobs FROM j GROUP BY 1) SELECT unit, ready, jobs, concat_ws(',', CASE WHEN NOT ready THEN 'open' END, CASE WHEN jobs < 5 THEN 'few' END) AS reasons, CASE WHEN ready AND jobs >= 5 THEN 'SAFE' ELSE 'BLOCKED' END AS decision FROM u")
def delete_decision(spark, d):
    return J.safe_to_delete(J.raw_ready(_jobs(spark, d), ["unit"]), {"open": F.col("ready"), "few": F.col("jobs") >= 5})
