"""Folds without leaks, and ridge models from summed moments.

A ridge fit needs only sums: n, y, y², x, xy and xx'. Tasks sum them for each target, fold and stretch of the
training rows in one pass over the rows; the sums of a training set less a held-out stretch are a subtraction.
What is solved are d x d systems, one group a target and fold, however many rows there are. Predictions are
dot products of the test rows with the fitted coefficients, inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.places import before_ranges, in_ranges, numbered
from tidemark.session import cut_lineage, small_side

# The penalties tried, the inner blocks and the rows left out beside one, and what counts as too few.
ALPHAS = [10 ** (-2 + 0.25 * k) for k in range(33)]
BLOCKS, BESIDE = 5, 5
LEAST_TRAIN, LEAST_TEST, LEAST_TARGET, LEAST_PREDICTED = 15, 5, 20, 10
LEAST_BLOCK, LEAST_INNER, COLUMNS_A_ROW = 3, 10, 50
#: Bytes of sums that a task holds before it passes them on, partial sums merged at once, rows of a leave-one-out group.
HELD_BYTES, MERGED, CHUNK = 256_000_000, 64, 20_000


def blocked_folds(rows: DataFrame, station: str, order: list[str], k: int) -> DataFrame:
    """Contiguous blocks of each station's rows: floor((position - 1) * k / n)."""
    w = Window.partitionBy(station)
    block = F.floor((F.row_number().over(w.orderBy(*order)) - 1) * k / F.count("*").over(w))
    return rows.withColumn("fold", block.cast("int"))


def group_folds(rows: DataFrame, by: str, least: int = 1) -> DataFrame:
    """One fold for each value of a column (leave one year or one station out), no rows below ``least`` values."""
    folds = small_side(numbered(rows.select(by).distinct(), [by], "fold").withColumn("fold", F.col("fold").cast("int")))
    if least > 1 and folds.limit(least).count() < least:
        return rows.limit(0).withColumn("fold", F.lit(0))
    return rows.join(folds, by)


def role_arrays(rows: DataFrame, station: str, day: str, gap_days: int) -> tuple[DataFrame, int]:
    """Adds ``roles``, the row's role in every fold, and gives the number of folds.

    A role is test, train, or purged within gap_days of the fold's test days of the row's station.
    """
    last = rows.agg(F.max("fold").alias("k")).first()["k"]
    k = 0 if last is None else last + 1
    bounds = rows.groupBy(station, "fold").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    spans = bounds.groupBy(F.col(station).alias("__st")).agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("lo", "hi")))).alias("__spans"))
    each = rows.join(spans, F.col(station).eqNullSafe(F.col("__st")))
    span = lambda f: F.try_element_at("__spans", f)
    near = lambda f: F.col(day).between(F.date_sub(span(f)["lo"], gap_days), F.date_add(span(f)["hi"], gap_days))
    role = lambda f: F.when(F.col("fold") == f, "test").when(F.coalesce(near(f), F.lit(False)), "purged").otherwise("train")
    folds = F.array(*[F.lit(f) for f in range(k)]).cast("array<int>")
    return each.withColumn("roles", F.transform(folds, role)).drop("__st", "__spans"), k


def fold_roles(rows: DataFrame, station: str, day: str, gap_days: int) -> DataFrame:
    """Every row with every fold f and its role in it."""
    held, _ = role_arrays(rows, station, day, gap_days)
    return held.select("*", F.posexplode("roles").alias("f", "role")).drop("roles")


@dataclass(frozen=True)
class Block:
    """Columns lo..hi of x, standardised on the training rows; if pca, their first components; times weight."""

    spans: tuple[tuple[int, int], ...]
    pca: int = 0
    weight: float = 1.0


@dataclass(frozen=True)
class Model:
    name: str
    blocks: tuple[Block, ...]
    matched: str | None = None


@dataclass
class Sums:
    """n, y, y², x, xy and xx' of some rows; they add up."""

    d: int
    n: float = 0.0
    y: float = 0.0
    yy: float = 0.0
    x: np.ndarray = field(default=None)
    xy: np.ndarray = field(default=None)
    xx: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.x is None:
            self.x, self.xy, self.xx = np.zeros(self.d), np.zeros(self.d), np.zeros((self.d, self.d))

    def add_rows(self, x: np.ndarray, y: np.ndarray) -> None:
        self.n, self.y, self.yy = self.n + len(y), self.y + y.sum(), self.yy + y @ y
        self.x, self.xy, self.xx = self.x + x.sum(0), self.xy + x.T @ y, self.xx + x.T @ x

    def plus(self, other: Sums, sign: int = 1) -> Sums:
        return Sums(self.d, *(a + sign * b for a, b in zip(self.parts(), other.parts())))

    def parts(self):
        return self.n, self.y, self.yy, self.x, self.xy, self.xx

    def pack(self) -> bytes:
        return np.concatenate([[self.n, self.y, self.yy], self.x, self.xy, self.xx.ravel()]).tobytes()

    @staticmethod
    def unpack(raw: bytes, d: int) -> Sums:
        v = np.frombuffer(raw, "float64")
        return Sums(d, v[0], v[1], v[2], v[3 : 3 + d], v[3 + d : 3 + 2 * d], v[3 + 2 * d :].reshape(d, d))

    def mapped(self, a: np.ndarray, m: np.ndarray) -> Sums:
        """The sums of u = a'(x - m)."""
        x = self.x - self.n * m
        xx = self.xx - np.outer(self.x, m) - np.outer(m, self.x) + self.n * np.outer(m, m)
        return Sums(a.shape[1], self.n, self.y, self.yy, a.T @ x, a.T @ (self.xy - m * self.y), a.T @ xx @ a)

    def spectrum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of the centred xx', and the centred xy in their basis."""
        lam, v = np.linalg.eigh(self.xx - np.outer(self.x, self.x) / self.n)
        return np.maximum(lam, 0), v, v.T @ (self.xy - self.x * (self.y / self.n))

    def squared_errors(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Sum of (y - c - w'x)² for each column of w and entry of c."""
        quad = np.einsum("da,de,ea->a", w, self.xx, w)
        return self.yy - 2 * c * self.y - 2 * self.xy @ w + self.n * c * c + 2 * c * (self.x @ w) + quad


def feature_map(total: Sums, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """a and m of the model's features u = a'(x - m), from the sums of its training rows."""
    m = total.x / total.n
    cov = total.xx / total.n - np.outer(m, m)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    parts = []
    for block in model.blocks:
        cols = np.concatenate([np.arange(lo, hi) for lo, hi in block.spans])
        a = np.zeros((total.d, len(cols)))
        a[cols, np.arange(len(cols))] = 1 / sd[cols]
        if block.pca:
            _, v = np.linalg.eigh(a.T @ cov @ a)
            a = a @ v[:, ::-1][:, : block.pca]
        parts.append(a * block.weight)
    return np.hstack(parts), m


def blocked_alpha(total: Sums, held_out: list[Sums], left_out: list[Sums], alphas: np.ndarray) -> float:
    """The penalty with the least squared error over the held-out blocks; the median one if no block counts.

    left_out: sums of each block together with the rows beside it, which its fit does not see.
    """
    error, counted = np.zeros(len(alphas)), False
    for val, out in zip(held_out, left_out):
        rest = total.plus(out, -1)
        if val.n < LEAST_BLOCK or rest.n < max(LEAST_INNER, total.d // COLUMNS_A_ROW):
            continue
        lam, v, b = rest.spectrum()
        w = v @ (b[:, None] / (lam[:, None] + alphas))
        error, counted = error + val.squared_errors(w, (rest.y - rest.x @ w) / rest.n), True
    return float(alphas[np.argmin(error)]) if counted else float(np.median(alphas))


def _stretch_sums(ranged: DataFrame, targets: list[str], k: int, before: dict, sizes: dict, centre: np.ndarray) -> DataFrame:
    """target, f, block, beside (the blocks, as bits, that leave the row out) and packed sums; one row a task and stretch."""
    d = len(centre)
    edges = {tf: np.array([n * b // BLOCKS for b in range(BLOCKS + 1)]) for tf, n in sizes.items()}

    def sums(batches):
        held: dict[tuple, Sums] = {}
        seen: dict[tuple, int] = {}
        part = 0

        def flushed():
            rows = [(*key, part, s.pack()) for key, s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["target", "f", "block", "beside", "part", "sums"])

        for pdf in batches:
            if pdf.empty:
                continue
            part = int(pdf["__part"].iloc[0])
            x = np.stack(pdf["x"].to_numpy()).astype("float64") - centre
            roles = np.stack(pdf["roles"].to_numpy())
            for t in targets:
                y = pdf[t].to_numpy("float64")
                for f in range(k):
                    if (t, f) not in edges:
                        continue
                    rows = np.nonzero((roles[:, f] == "train") & ~np.isnan(y))[0]
                    at = seen.setdefault((t, f), before[part][f"{t}|{f}|train"]) + np.arange(len(rows))
                    seen[t, f] += len(rows)
                    e = edges[t, f]
                    block = np.searchsorted(e, at, side="right") - 1
                    beside = sum((((at >= e[b] - BESIDE) & (at < e[b + 1] + BESIDE)).astype("int64") << b for b in range(BLOCKS)), np.zeros(len(at), "int64"))
                    code = block << BLOCKS | beside
                    for c in np.unique(code):
                        mine = rows[code == c]
                        held.setdefault((t, f, int(c >> BLOCKS), int(c & (1 << BLOCKS) - 1)), Sums(d)).add_rows(x[mine], y[mine])
            if len(held) * d * d * 8 > HELD_BYTES:
                yield flushed()
        yield flushed()

    schema = "target string, f int, block int, beside int, part int, sums binary"
    got = ranged.select("__part", "roles", "x", *targets).mapInPandas(sums, schema)
    key = ["target", "f", "block", "beside"]

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(s, "float64") for s in pdf["sums"]), 0.0)
        return pdf.iloc[:1].assign(sums=[total.tobytes()])

    parts = max(max(before), 0) + 1
    while True:  # sums of sums, so that no group grows with the number of tasks
        parts = -(-parts // MERGED)
        got = got.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy(*key, "part").applyInPandas(merged, schema)
        if parts == 1:
            return got


def ridge_predictions(
    rows: DataFrame, key: str, order: list[str], targets: list[str], models: list[Model], folds: int, alphas: list[float] | None = None, choose: str = "blocked"
) -> DataFrame:
    """Out-of-fold predictions: target, model, f, row_id, y, p and alpha.

    rows: key, order columns, targets (doubles, null where unknown), roles (role_arrays) and x (array of double,
    all of one length). choose: 'blocked' holds out contiguous blocks of the training rows in their order,
    'loo' leaves out one row at a time; a single alpha needs no choice.

    Left out: folds with under 15 training or 5 test rows, targets with under 20 known rows or 10 predictions.
    """
    alphas_ = np.array(alphas or ALPHAS)
    spark = rows.sparkSession
    out = f"target string, model string, f int, row_id {dict(rows.dtypes)[key]}, y double, p double, alpha double"
    value = {t: F.when(~F.isnan(t), F.col(t).cast("double")) for t in targets}
    narrow = rows.select(F.col(key).alias("__key"), *order, "roles", "x", *[value[t].alias(t) for t in targets])
    ranged = in_ranges(narrow, order)
    counts = {f"{t}|{f}|{r}": F.count_if((F.col("roles")[f] == r) & F.col(t).isNotNull()) for t in targets for f in range(folds) for r in ("train", "test")}
    before = before_ranges(ranged, counts | {f"{t}||": F.count(t) for t in targets})
    n = before.pop(-1)
    usable = [(t, f) for t in targets if n[f"{t}||"] >= LEAST_TARGET for f in range(folds) if n[f"{t}|{f}|train"] >= LEAST_TRAIN and n[f"{t}|{f}|test"] >= LEAST_TEST]
    enough = {t for t in targets if sum(n[f"{u}|{f}|test"] for u, f in usable if u == t) >= LEAST_PREDICTED}
    usable = [(t, f) for t, f in usable if t in enough]
    if not usable:
        return spark.createDataFrame([], out)
    means = {r["pos"]: r["m"] for r in ranged.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).collect()}
    centre = np.array([means[i] for i in range(len(means))])  # sums about it lose no digits
    d = len(centre)
    sums = _stretch_sums(ranged, targets, folds, before, {(t, f): n[f"{t}|{f}|train"] for t, f in usable}, centre)

    def line(target, f, name, a, m, w, ybar, ubar, alpha):
        coef = a @ w
        return target, f, name, coef.tolist(), float(ybar - ubar @ w - coef @ (m + centre)), float(alpha)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        target, f = pdf["target"].iloc[0], int(pdf["f"].iloc[0])
        stretches = [(int(b), int(o), Sums.unpack(s, d)) for b, o, s in zip(pdf["block"], pdf["beside"], pdf["sums"])]
        add = lambda chosen: sum_of((s for b, o, s in stretches if chosen(b, o)), d)
        total = add(lambda b, o: True)
        val = [add(lambda b, o, k=k: b == k) for k in range(BLOCKS)]
        left = [add(lambda b, o, k=k: o >> k & 1) for k in range(BLOCKS)]
        found = []
        for model in models:
            a, m = feature_map(total, model)
            u = total.mapped(a, m)
            lam, v, b = u.spectrum()
            if choose == "loo" and len(alphas_) > 1:
                found.append((target, f, model.name, (a @ v).tobytes(), (m + centre).tobytes(), lam.tobytes(), b.tobytes(), float(u.y / u.n), float(u.n)))
                continue
            alpha = alphas_[0] if len(alphas_) == 1 else blocked_alpha(u, [s.mapped(a, m) for s in val], [s.mapped(a, m) for s in left], alphas_)
            found.append(line(target, f, model.name, a, m, v @ (b / (lam + alpha)), u.y / u.n, u.x / u.n, alpha))
        names = LOO_COLUMNS if choose == "loo" and len(alphas_) > 1 else LINE_COLUMNS
        return pd.DataFrame(found, columns=[c.split()[0] for c in names.split(", ")])

    if choose == "loo" and len(alphas_) > 1:
        fits = _leave_one_out(ranged, sums.groupBy("target", "f").applyInPandas(solve, LOO_COLUMNS), targets, folds, alphas_)
    else:
        fits = sums.groupBy("target", "f").applyInPandas(solve, LINE_COLUMNS)
    known = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])
    test = ranged.select("__key", "x", F.explode(known).alias("k"), "roles").filter("k.y is not null")
    test = test.select("__key", "x", "k.*", F.posexplode("roles").alias("f", "role")).filter("role = 'test'").drop("role")
    # lines number models x folds x targets, not rows
    both = test.join(small_side(fits), ["target", "f"])
    p = F.aggregate(F.zip_with("x", "coef", lambda a, b: a.cast("double") * b), F.col("intercept"), lambda s, v: s + v)
    return both.select("target", "model", "f", F.col("__key").alias("row_id"), "y", p.alias("p"), "alpha")


LINE_COLUMNS = "target string, f int, model string, coef array<double>, intercept double, alpha double"
LOO_COLUMNS = "target string, f int, model string, basis binary, middle binary, lam binary, b binary, ybar double, n double"


def sum_of(sums, d: int) -> Sums:
    total = Sums(d)
    for s in sums:
        total = total.plus(s)
    return total


def _leave_one_out(ranged: DataFrame, bases: DataFrame, targets: list[str], folds: int, alphas: np.ndarray) -> DataFrame:
    """Lines whose penalty has the least sum of squared leave-one-out errors, e / (1 - h), over all training rows.

    Training rows meet the bases of their target and fold in groups of one range's chunk, and give sums only.
    """
    bases = cut_lineage(bases)
    known = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])
    train = ranged.select("__part", F.floor(F.col("__at") / CHUNK).alias("chunk"), "x", F.explode(known).alias("k"), "roles").filter("k.y is not null")
    train = train.select("__part", "chunk", "x", "k.*", F.posexplode("roles").alias("f", "role")).filter("role = 'train'")
    groups = ["target", "f", "__part", "chunk"]
    places = train.select(*[F.col(g).alias(f"to_{g}") for g in groups]).distinct()
    spread = places.join(bases, (F.col("to_target") == F.col("target")) & (F.col("to_f") == F.col("f")))

    def errors(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(fits):
            x, y = np.stack(rows["x"].to_numpy()).astype("float64"), rows["y"].to_numpy("float64")
            for fit in fits.itertuples(index=False):
                middle, lam, b = (np.frombuffer(v, "float64") for v in (fit.middle, fit.lam, fit.b))
                u = (x - middle) @ np.frombuffer(fit.basis, "float64").reshape(len(middle), -1)
                shrunk = 1 / (lam[:, None] + alphas)
                e = y[:, None] - fit.ybar - u @ (b[:, None] * shrunk)
                h = 1 / fit.n + (u * u) @ shrunk
                out.append((fit.target, fit.f, fit.model, ((e / (1 - h)) ** 2).sum(0).tolist()))
        return pd.DataFrame(out, columns=["target", "f", "model", "sse"])

    sse = train.groupBy(*groups).cogroup(spread.groupBy(*[f"to_{g}" for g in groups])).applyInPandas(errors, "target string, f int, model string, sse array<double>")
    sse = sse.select("target", "f", "model", F.posexplode("sse").alias("at", "v")).groupBy("target", "f", "model", "at").agg(F.sum("v").alias("v"))
    best = sse.groupBy("target", "f", "model").agg(F.min_by("at", F.struct("v", "at")).alias("at"))

    def lines(batches):
        for pdf in batches:
            out = []
            for fit in pdf.itertuples(index=False):
                middle, lam, b = (np.frombuffer(v, "float64") for v in (fit.middle, fit.lam, fit.b))
                coef = np.frombuffer(fit.basis, "float64").reshape(len(middle), -1) @ (b / (lam + alphas[fit.at]))
                out.append((fit.target, fit.f, fit.model, coef.tolist(), float(fit.ybar - coef @ middle), float(alphas[fit.at])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINE_COLUMNS.split(", ")])

    return bases.join(best, ["target", "f", "model"]).mapInPandas(lines, LINE_COLUMNS)


def compare_models(scores: DataFrame) -> DataFrame:
    """Scores(target, model, rmse) against the target's best and its 'season' model, with a verdict at 5 %."""
    w = Window.partitionBy("target")
    best = F.min_by("model", F.struct("rmse", "model")).over(w)
    season = F.max(F.when(F.col("model") == "season", F.col("rmse"))).over(w)
    change = 100 * (F.col("rmse") - season) / season
    verdict = F.when(change < -5, "better").when(change > 5, "worse").otherwise("same")
    return scores.withColumns({"best_model": best, "vs_season_pct": change, "verdict": verdict})


def registry(widths: dict[str, int]) -> list[Model]:
    """The models compared, over a vector whose segments have the given widths, in their order.

    Segments: season, stats, stats_n, emb, emb_n, stats_ctx, emb_ctx; _n is normalised by station and phase, _ctx
    the context of the normalised ones. A wide block gets the total variance of its reference block.
    """
    at, spans = 0, {}
    for name, width in widths.items():
        spans[name] = (at, at + width)
        at += width
    width = lambda *names: sum(widths[s] for s in names)
    of = lambda *names, pca=0, like=None: Block(tuple(spans[s] for s in names), pca, (width(*like) / width(*names)) ** 0.5 if like else 1.0)
    season, stats_c, emb_c = of("season"), ("stats_n", "stats_ctx"), ("emb_n", "emb_ctx")
    # The names of the models and of the one each is matched with.
    table = [
        ("season", [season], None),
        ("stats [raw]", [of("stats")], None),
        ("stats [norm]", [of("stats_n")], None),
        ("emb PCA10 [raw]", [of("emb", pca=10)], "stats [raw]"),
        ("emb PCA10 [norm]", [of("emb_n", pca=10)], "stats [norm]"),
        ("emb ridge [norm]", [of("emb_n")], "stats [norm]"),
        ("season + stats [norm]", [season, of("stats_n")], None),
        ("season + emb PCA10 [norm]", [season, of("emb_n", pca=10)], "season + stats [norm]"),
        ("season + stats + emb PCA10 [norm]", [season, of("stats_n"), of("emb_n", pca=10)], "season + stats [norm]"),
        ("season + emb ridge [norm]", [season, of("emb_n", like=["stats_n"])], "season + stats [norm]"),
        ("season + stats + emb ridge [norm]", [season, of("stats_n"), of("emb_n", like=["stats_n"])], "season + stats [norm]"),
        ("stats + ctx [norm]", [of(*stats_c)], None),
        ("season + stats + ctx [norm]", [season, of(*stats_c)], None),
        ("emb ridge + ctx [norm]", [of(*emb_c)], "stats + ctx [norm]"),
        ("season + emb ridge + ctx [norm]", [season, of(*emb_c, like=stats_c)], "season + stats + ctx [norm]"),
    ]
    return [Model(name, tuple(blocks), matched) for name, blocks, matched in table]
