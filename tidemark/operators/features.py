"""Feature vectors: usability, normalising, causal context, correlation, outliers and agreement of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.places import medians

#: Bytes of sums that a task holds before it passes them on, and partial sums added at once.
HELD_BYTES, MERGED = 128_000_000, 64


def usable_vector(v: str) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def phase(day: Column, anchor: str = "2015-01-01", cycle: int = 12, repeats: bool = True) -> Column:
    """Days since the anchor within the cycle; -1 for a sensor whose track does not repeat with it."""
    return F.pmod(F.datediff(day, F.lit(anchor).cast("date")), F.lit(cycle)) if repeats else F.lit(-1)


def long_vectors(vectors: DataFrame, keys: list[str], v: str) -> DataFrame:
    return vectors.select(*keys, F.posexplode(v).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def normalise(cells: DataFrame, station: str, phase_: str) -> DataFrame:
    """Element less its station and phase mean, over the population deviation of what is left; under 1e-9 counts as 1.

    Where any phase of a station is negative, the station's mean alone is taken off.
    """
    known = F.when(F.min(phase_).over(Window.partitionBy(station, "pos")) >= 0, F.col(phase_)).otherwise(-1)
    phased = cells.withColumn("__ph", known)
    centred = phased.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy(station, "pos", "__ph"))).drop("__ph")
    sd = F.stddev_pop("c").over(Window.partitionBy(station, "pos"))
    return centred.withColumn("z", F.col("c") / F.when(sd < 1e-9, 1.0).otherwise(sd))


def causal_context(cells: DataFrame, station: str, day_no: str, width: int) -> DataFrame:
    """Mean of the rows of the width days before a row, without it and without its day; none gives 0 and is counted."""
    w = Window.partitionBy(station, "pos").orderBy(day_no).rangeBetween(-width, -1)
    mean = F.avg("x").over(w)
    return cells.withColumns({"context": F.coalesce(mean, F.lit(0.0)), "no_past": mean.isNull()})


def average_rank(c: str, group: list[str]) -> Column:
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2


def spearman(pairs: DataFrame, group: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Correlation of average ranks; null under ``least`` pairs or without variance."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumns({"ra": average_rank(a, group), "rb": average_rank(b, group)})
    moments = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), F.covar_pop("ra", "rb").alias("cov"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb")
    )
    return moments.select(*group, "n", F.when((F.col("n") >= least) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("rho"))


def fit_quality(pairs: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """R2 and RMSE; R2 is null where y does not vary."""
    e = F.col(y) - F.col(p)
    facts = pairs.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("vy")
    )
    return facts.select(*group, "n", F.sqrt("mse").alias("rmse"), F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")).alias("r2"))


def eta_squared(rows: DataFrame, group: list[str], part: str, value: str, least: int = 10) -> DataFrame:
    """Share of the variance that lies between the parts of a group."""
    inner = rows.filter(F.col(value).isNotNull()).groupBy(*group, part).agg(F.count("*").alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("k") * F.col("m")) / F.sum("k")
    between = F.sum(F.col("k") * F.col("m") * F.col("m")) - F.sum("k") * grand * grand
    total = between + F.sum(F.col("k") * F.col("v"))
    return inner.groupBy(*group).agg(F.sum("k").alias("n"), F.when((F.sum("k") >= least) & (total > 0), between / total).alias("eta2"))


def mad_outliers(rows: DataFrame, group: str, value: str, limit: float = 6.0) -> DataFrame:
    """Robust distance from the group's median, in scaled median absolute deviations.

    Rows without a group are dropped, those without a value score null. Groups may be of any size.
    """
    off = rows.join(medians(rows, group, value, "med"), group, "left").withColumn("off", F.abs(F.col(value) - F.col("med")))
    score = F.col("off") / F.greatest(1.4826 * F.col("mad"), F.lit(1e-12))
    scored = off.join(medians(off, group, "off", "mad"), group, "left").filter(F.col(group).isNotNull())
    return scored.withColumn("score", score).withColumn("outlier", F.col("score") > limit)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def run_agreement(a: DataFrame, b: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Largest absolute difference and cosine of the vectors of two runs with equal keys."""
    both = a.select(*keys, F.col(v).alias("va")).join(b.select(*keys, F.col(v).alias("vb")), keys)
    worst = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return both.select(*keys, worst.alias("max_abs_diff"), F.try_divide(dot("va", "vb"), norm("va") * norm("vb")).alias("cosine"))


def moments(vectors: DataFrame, group: list[str], v: str) -> DataFrame:
    """group, d and sums (packed: n, x, xx') of the usable vectors of each group.

    Tasks multiply whole batches and hand on one sum a group; sums are added in two steps, so that no group of
    rows grows with the number of vectors.
    """
    types = dict(vectors.dtypes)
    keys = "".join(f"{g} {types[g]}, " for g in group)
    schema = f"{keys}__part int, d int, sums binary"
    rows = vectors.filter(usable_vector(v)).select(*group, F.col(v).alias("__v"), F.spark_partition_id().alias("__part"))

    def packed(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        part = 0

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame([(*k[:-1], part, k[-1], s.tobytes()) for k, s in held.items()], columns=[*group, "__part", "d", "sums"])
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            part = int(pdf["__part"].iloc[0])
            pdf = pdf.assign(d=pdf["__v"].map(len))
            for key, mine in pdf.groupby([*group, "d"], dropna=False, sort=False):
                sums = packed(np.stack(mine["__v"].to_numpy()).astype("float64"))
                held[key] = held[key] + sums if key in held else sums
            if sum(s.nbytes for s in held.values()) > HELD_BYTES:
                yield flushed()
        yield flushed()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(s, "float64") for s in pdf["sums"]), 0.0)
        return pdf.iloc[:1].assign(sums=[total.tobytes()])

    got = rows.mapInPandas(partial, schema)
    for _ in range(2):
        got = got.withColumn("__part", F.floor(F.col("__part") / MERGED).cast("int")).groupBy(*group, "d", "__part").applyInPandas(added, schema)
    return got.withColumn("__part", F.lit(0)).groupBy(*group, "d", "__part").applyInPandas(added, schema).drop("__part")


def _unpacked(raw: bytes, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    s = np.frombuffer(raw, "float64")
    return s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)


def gram(vectors: DataFrame, group: list[str], v: str) -> DataFrame:
    """Mean products of vector elements i <= j per group, and the number of vectors."""
    types = dict(vectors.dtypes)

    def cells(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, _, xx = _unpacked(row["sums"], row["d"])
                i, j = np.triu_indices(row["d"])
                yield pd.DataFrame({**{g: [row[g]] * len(i) for g in group}, "i": i, "j": j, "mean_product": xx[i, j] / n, "n": int(n)})

    schema = "".join(f"{g} {types[g]}, " for g in group) + "i int, j int, mean_product double, n long"
    return moments(vectors, group, v).mapInPandas(cells, schema)


def _covariance(vectors: DataFrame, v: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, means and covariance of the vectors of the commonest length; the driver sees one d x d matrix, whatever the rows."""
    best = max(moments(vectors, [], v).collect(), key=lambda r: np.frombuffer(r["sums"], "float64", 1)[0], default=None)
    if best is None:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    n, x, xx = _unpacked(best["sums"], best["d"])
    return n, x / n, xx / n - np.outer(x / n, x / n)


def principal_components(vectors: DataFrame, v: str, k: int) -> tuple[DataFrame, list[float]]:
    """Scores of the first k components and the variances of all; the components come back as literals of a projection."""
    _, m, cov = _covariance(vectors, v)
    d = len(m)
    rows = vectors.filter(usable_vector(v) & (F.size(v) == d))
    if not d:
        return rows.limit(0).withColumn("scores", F.array().cast("array<double>")), []
    lam, u = np.linalg.eigh(cov)
    centre = F.array(*[F.lit(float(x)) for x in m])
    centred = F.zip_with(v, centre, lambda x, c: x.cast("double") - c)
    axes = [F.array(*[F.lit(float(x)) for x in u[:, d - 1 - i]]) for i in range(min(k, d))]
    scores = [F.aggregate(F.zip_with("__c", a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in axes]
    return rows.withColumn("__c", centred).withColumn("scores", F.array(*scores)).drop("__c"), lam[::-1].tolist()


def vector_health(vectors: DataFrame, v: str, share: float = 0.9) -> DataFrame:
    """One row: vectors, share of dimensions that do not vary, spread over mean length, variance shares of three components, components for ``share``."""
    n, _, cov = _covariance(vectors, v)
    schema = "n long, dead_share double, relative_spread double, pc1 double, pc2 double, pc3 double, components long"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    length = vectors.filter(usable_vector(v) & (F.size(v) == len(cov))).agg(F.avg(norm(v)).alias("m")).first()["m"]
    lam = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    part = lam / lam.sum() if lam.sum() > 0 else np.zeros(len(lam))
    first = [float(x) for x in np.pad(part, (0, 3))[:3]]
    dead = float((np.sqrt(np.maximum(np.diag(cov), 0)) < 1e-6).mean())
    spread = float(np.sqrt(max(np.trace(cov), 0.0)) / length) if length else None
    return vectors.sparkSession.createDataFrame([(int(n), dead, spread, *first, int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1))], schema)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, or that a side has more than once."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.filter((F.col("n_left") != 1) | (F.col("n_right") != 1))


def fold_wins(scores: DataFrame, matched: dict[str, str]) -> DataFrame:
    """scores(target, model, f, rmse): folds in which a model beats its matched one, as 'wins/folds'."""
    pairs = scores.sparkSession.createDataFrame(list(matched.items()), "model string, matched string")
    base = scores.select("target", F.col("model").alias("matched"), "f", F.col("rmse").alias("base"))
    both = scores.join(F.broadcast(pairs), "model").join(base, ["target", "matched", "f"])  # a registry, a row per model
    return both.groupBy("target", "model").agg(F.concat_ws("/", F.count_if(F.col("rmse") < F.col("base")), F.count("*")).alias("wins"))


def comparison_report(predictions: DataFrame, matched: dict[str, str], season: str = "season") -> DataFrame:
    """Per target and model: pooled and per-fold rank correlation, R2, RMSE, its change from the season model, fold wins.

    predictions: target, model, f, y, p. Folds without a correlation (under 5 rows, no variance) do not count in
    its mean and deviation. Wins are null for models that are matched with none.
    """
    key = ["target", "model"]
    pooled = fit_quality(predictions, key, "y", "p").join(spearman(predictions, key, "y", "p").select(*key, F.col("rho").alias("rho_pooled")), key)
    folds = spearman(predictions, [*key, "f"], "y", "p").groupBy(*key).agg(F.avg("rho").alias("rho_fold_mean"), F.stddev_pop("rho").alias("rho_fold_sd"))
    wins = fold_wins(fit_quality(predictions, [*key, "f"], "y", "p"), matched)
    base = F.max(F.when(F.col("model") == season, F.col("rmse"))).over(Window.partitionBy("target"))
    rows = pooled.join(folds, key).withColumn("vs_season_pct", 100 * (F.col("rmse") - base) / base)
    return rows.join(wins, key, "left")
