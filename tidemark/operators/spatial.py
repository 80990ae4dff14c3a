"""Points near other points, and the regions that hold them.

A bounded sample of the points drives a quadtree whose leaves hold like numbers of points; a leaf is never
narrower than a search box at its own latitude. Every point goes to its own leaf and, as a visitor, to each
leaf its search box touches; where the sample says that a smallest leaf holds too many, its own points are
dealt to several parts of it, each with all its visitors. Regions go, clipped, to each leaf they touch: with
the edges in the leaf and what the edges to the right of it add to a ray's crossings. Inside a leaf an R-tree,
bulk-loaded by sort-tile-recursive packing, yields candidates and exact geometry decides. A pair is reported
only in the leaf of its reference point, the smaller location, so replication never duplicates it.

Defined results
---------------
* points with a null, NaN or infinite coordinate, with both coordinates 0, or off the globe take no part;
* points at equal coordinates form one class, so that a spot with a third of all rows is indexed once;
  ``near_classes`` links classes, ``class_links`` counts them, ``near_pairs`` expands them to keys; a key
  never pairs with itself;
* a null key takes no part; repeated rows count once; an empty table gives no rows;
* a region holds the points inside an odd number of its rings (holes do not count), edges excluded on
  the upper side as by the even-odd rule; regions without a ring of three corners hold nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

EARTH_M = 6_371_008.8
#: The quadtree is fitted on about this many points at most; every point is then indexed.
SAMPLE_POINTS = 20_000
ROWS_PER_LEAF = 8_000
MAX_DEPTH = 26
#: Beyond this latitude points visit every leaf of their latitudes.
POLAR = 89.0
FANOUT = 16
#: Degrees by which an edge must clear a leaf to count as beside it, far above any rounding.
NUDGE = 1e-9
CLIPPED = "region string, edges array<double>, turns array<double>, base boolean, x_lo double, y_lo double, x_hi double, y_hi double, leaf long"


def usable(lat: Column, lon: Column) -> Column:
    inside = lat.between(-90, 90) & lon.between(-180, 180)  # also drops NaN, which Spark sorts above all
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def _morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Z-order codes of lon/lat at MAX_DEPTH."""
    code = np.zeros(len(x), "uint64")
    side = 1 << MAX_DEPTH
    ix = np.clip(((x + 180) / 360 * side).astype("int64"), 0, side - 1).astype("uint64")
    iy = np.clip(((y + 90) / 180 * side).astype("int64"), 0, side - 1).astype("uint64")
    for bit in range(MAX_DEPTH):
        one, at = np.uint64(1), np.uint64(bit)
        code |= ((ix >> at) & one) << np.uint64(2 * bit) | ((iy >> at) & one) << np.uint64(2 * bit + 1)
    return code


def build_quadtree(lat: np.ndarray, lon: np.ndarray, leaves: int, least_deg: tuple[float, float]) -> np.ndarray:
    """First z-order code of each leaf, ascending.

    Leaves are no smaller than least_deg: degrees of latitude, and of longitude at the equator, which widen
    with a leaf's own latitude.
    """
    codes = np.sort(_morton(lon, lat))
    cap, out, stack = max(1, len(codes) // max(1, leaves)), [], [(0, 0, -90.0)]
    while stack:
        start, depth, south = stack.pop()
        height = 180 / 2**depth
        size = 1 << (2 * (MAX_DEPTH - depth))
        a, b = np.searchsorted(codes, np.array([start, start + size - 1], "uint64"), side="left")
        farthest = min(max(abs(south), abs(south + height)), POLAR)
        fits = height / 2 >= least_deg[0] and height >= least_deg[1] / math.cos(math.radians(farthest))  # its quarters are as wide as it is high
        if depth < MAX_DEPTH and b - a > cap and fits:
            stack += [(start + k * (size // 4), depth + 1, south + (k >> 1) * height / 2) for k in range(4)]
        else:
            out.append(start)
    return np.array(sorted(out), "uint64")


def leaf_boxes(starts: np.ndarray) -> np.ndarray:
    """lon/lat box of each leaf."""
    sizes = np.diff(np.append(starts.astype(object), 1 << (2 * MAX_DEPTH))).astype("float64")
    steps = np.round(np.log2(sizes) / 2).astype(int)
    ix, iy = np.zeros(len(starts)), np.zeros(len(starts))
    for bit in range(MAX_DEPTH):
        ix += ((starts >> np.uint64(2 * bit)) & np.uint64(1)).astype("float64") * 2.0**bit
        iy += ((starts >> np.uint64(2 * bit + 1)) & np.uint64(1)).astype("float64") * 2.0**bit
    side, w = 2.0**MAX_DEPTH, 2.0**steps
    return np.column_stack([ix / side * 360 - 180, iy / side * 180 - 90, (ix + w) / side * 360 - 180, (iy + w) / side * 180 - 90])


def _leaf_of(starts: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, _morton(lon, lat), side="right") - 1


@dataclass(frozen=True)
class Quadtree:
    """Leaves by their first z-order codes, and the number of parts that each leaf's own points are dealt to."""

    starts: np.ndarray
    parts: np.ndarray

    def leaf_of(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return _leaf_of(self.starts, lon, lat)


def fit_quadtree(points: DataFrame, radius_m: float) -> Quadtree:
    """Quadtree over a sample of points(lat, lon); the driver gets SAMPLE_POINTS rows or so, whatever the input."""
    n = points.count()
    share = min(1.0, SAMPLE_POINTS / max(1, n))
    sample = points.select("lat", "lon")
    sample = sample if share == 1.0 else sample.filter(F.pmod(F.xxhash64("lat", "lon"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = sample.toPandas()
    reach = math.degrees(radius_m / EARTH_M) * 1.01
    lat, lon = got["lat"].to_numpy(), got["lon"].to_numpy()
    starts = build_quadtree(lat, lon, max(16, n // ROWS_PER_LEAF), (4 * reach, 4 * reach))
    held = np.bincount(_leaf_of(starts, lon, lat), minlength=len(starts)) / share
    return Quadtree(starts, np.maximum(1, held // (4 * ROWS_PER_LEAF)).astype("int64"))


class RTree:
    """Sort-tile-recursive R-tree over boxes; probes many boxes at once."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        order = np.argsort((boxes[:, 0] + boxes[:, 2]), kind="stable")
        slices = max(1, math.ceil(math.sqrt(n / FANOUT)))
        per = math.ceil(n / slices) if n else 1
        order = np.concatenate([s[np.argsort(boxes[s, 1] + boxes[s, 3], kind="stable")] for s in np.split(order, range(per, n, per))]) if n else order
        self.order, self.levels = order, [boxes[order]]
        while len(self.levels[-1]) > FANOUT:
            low = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(np.column_stack([
                np.minimum.reduceat(low[:, 0], at), np.minimum.reduceat(low[:, 1], at),
                np.maximum.reduceat(low[:, 2], at), np.maximum.reduceat(low[:, 3], at),
            ]))

    def probe(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) index pairs whose boxes touch."""
        top = len(self.levels[-1])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        for depth in range(len(self.levels) - 1, -1, -1):
            b, w = self.levels[depth][node], queries[q]
            hit = (b[:, 0] <= w[:, 2]) & (b[:, 2] >= w[:, 0]) & (b[:, 1] <= w[:, 3]) & (b[:, 3] >= w[:, 1])
            q, node = q[hit], node[hit]
            if depth:
                below = len(self.levels[depth - 1])
                q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


def sphere_m(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def members_of(rows: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """k, lat and lon of every key at every usable location, each once."""
    return rows.filter(F.col(key).isNotNull() & usable(F.col(lat), F.col(lon))).select(
        F.col(key).alias("k"), (F.col(lat) + 0.0).alias("lat"), (F.col(lon) + 0.0).alias("lon")
    ).distinct()


def point_classes(rows: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """class_key (the smallest key there), lat, lon and n (the number of keys) of every distinct usable location."""
    return members_of(rows, key, lat, lon).groupBy("lat", "lon").agg(F.min("k").alias("class_key"), F.count("*").alias("n"))


def near_classes(classes: DataFrame, tree: Quadtree, radius_m: float) -> DataFrame:
    """class_key, lat and lon of both (_a, _b) and metres of locations less than radius_m apart, each pair once.

    A location is its coordinates: its smallest key may occur at other locations too.
    """
    reach = math.degrees(radius_m / EARTH_M) * 1.001
    key_type = dict(classes.dtypes)["class_key"]
    starts, parts = tree.starts, tree.parts
    boxes = leaf_boxes(starts)

    def spread(batches):
        for pdf in batches:
            lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            wide = np.minimum(180.0, reach / np.maximum(np.cos(np.radians(np.minimum(89.99, np.abs(lat) + reach))), 1e-6))
            home = _leaf_of(starts, lon, lat)
            corners = [
                _leaf_of(starts, (lon + sx * wide + 180) % 360 - 180, np.clip(lat + sy * reach, -90, 90)) for sx in (-1, 1) for sy in (-1, 1)
            ]
            at = np.column_stack([home, *corners])
            at.sort(axis=1)
            new = np.column_stack([np.ones(len(at), bool), np.diff(at, axis=1) != 0])
            row, col = np.nonzero(new)
            leaf = at[row, col]
            if len(polar := np.nonzero(np.abs(lat) + reach > POLAR)[0]):  # there a search box may span every longitude
                r, k = np.nonzero((boxes[None, :, 1] <= lat[polar, None] + reach) & (boxes[None, :, 3] >= lat[polar, None] - reach))
                rest = ~np.isin(row, polar)
                row, leaf = np.concatenate([row[rest], polar[r]]), np.concatenate([leaf[rest], k])
            # in a leaf of several parts a point is native to one of them, by its coordinates, and a visitor to the others
            often = parts[leaf]
            row, leaf = np.repeat(row, often), np.repeat(leaf, often)
            part = np.arange(len(row)) - np.repeat(np.cumsum(often) - often, often)
            mine = np.abs(lat * 1e7 + lon * 1e6).astype("int64")[row] % parts[leaf] == part
            yield pdf.iloc[row].assign(leaf=leaf, part=part, native=(home[row] == leaf) & mine)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, keys = (pdf[c].to_numpy() for c in ("lat", "lon", "class_key"))
        native = np.nonzero(pdf["native"].to_numpy())[0]
        wide = reach / np.maximum(np.cos(np.radians(np.minimum(89.99, np.abs(lat) + reach))), 1e-6)
        wide[np.abs(lat) + reach > POLAR] = 360.0
        base = lon[0] if len(lon) else 0.0
        x = (lon - base + 180) % 360 - 180  # across the date line neighbours stay neighbours
        tree = RTree(np.column_stack([x, lat, x, lat]))
        out = []
        for part in np.array_split(native, max(1, len(native) // 2048)):
            q, e = tree.probe(np.column_stack([x[part] - wide[part], lat[part] - reach, x[part] + wide[part], lat[part] + reach]))
            a = part[q]
            later = (lat[a] < lat[e]) | ((lat[a] == lat[e]) & (lon[a] < lon[e]))
            a, e = a[later], e[later]
            m = sphere_m(lat[a], lon[a], lat[e], lon[e])
            close = m < radius_m
            a, e = a[close], e[close]
            out.append(pd.DataFrame({
                "class_a": keys[a], "lat_a": lat[a], "lon_a": lon[a], "class_b": keys[e], "lat_b": lat[e], "lon_b": lon[e], "metres": m[close]
            }))
        return pd.concat(out)

    spread_out = classes.select("class_key", "lat", "lon").mapInPandas(
        spread, f"class_key {key_type}, lat double, lon double, leaf long, part long, native boolean"
    )
    return spread_out.groupBy("leaf", "part").applyInPandas(
        pairs, f"class_a {key_type}, lat_a double, lon_a double, class_b {key_type}, lat_b double, lon_b double, metres double"
    )


def class_links(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Every location with its keys, the other locations near it, and the keys there: one row a location, no pairs."""
    here, there = classes.select("lat", "lon", "class_key", "n"), classes.select(F.col("lat").alias("lat_o"), F.col("lon").alias("lon_o"), F.col("n").alias("n_o"))
    both = links.select("lat_a", "lon_a", "lat_b", "lon_b").unionByName(links.select(F.col("lat_b").alias("lat_a"), F.col("lon_b").alias("lon_a"), F.col("lat_a").alias("lat_b"), F.col("lon_a").alias("lon_b")))
    counted = both.join(there, (F.col("lat_b") == F.col("lat_o")) & (F.col("lon_b") == F.col("lon_o"))).groupBy("lat_a", "lon_a").agg(F.count("*").alias("links"), F.sum("n_o").alias("keys_linked"))
    joined = here.join(counted, (F.col("lat") == F.col("lat_a")) & (F.col("lon") == F.col("lon_a")), "left")
    return joined.select("lat", "lon", "class_key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("keys_linked", F.lit(0)).alias("keys_linked"))


def near_pairs(rows: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """key_a < key_b of all different keys less than radius_m apart."""
    members = members_of(rows, key, lat, lon)
    classes = cut_lineage(members.groupBy("lat", "lon").agg(F.min("k").alias("class_key"), F.count("*").alias("n")))
    return expand_pairs(members, classes, near_classes(classes, fit_quadtree(classes, radius_m), radius_m))


def expand_pairs(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """key_a < key_b of linked locations and within locations; only locations of several keys are expanded."""
    of = members.join(classes.filter("n > 1"), ["lat", "lon"]).select("lat", "lon", "k")
    a, b = (of.withColumnsRenamed({"lat": f"lat_{x}", "lon": f"lon_{x}", "k": f"k{x}"}) for x in "ab")
    end = lambda c, name: F.coalesce(F.col(name), F.col(c))
    across = links.join(a, ["lat_a", "lon_a"], "left").join(b, ["lat_b", "lon_b"], "left").select(end("class_a", "ka").alias("x"), end("class_b", "kb").alias("y"))
    within = of.withColumnRenamed("k", "x").join(of.withColumnRenamed("k", "y"), ["lat", "lon"]).select("x", "y")
    both = across.unionByName(within).filter(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def clip_region(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """What a leaf needs of a region to tell its points' crossings of a ray to the right: edges, turns and base.

    edges (x0, y0, x1, y1) touch the leaf. The others to its right are crossed or not by latitude alone: base says
    whether a ray at the leaf's foot crosses an odd number of them, turns are the latitudes at which that changes.
    """
    ends = np.cumsum(sizes)
    first = np.ones(len(xs), bool)
    first[ends[ends < len(xs)]] = False  # the step from one ring to the next is no edge
    keep = np.nonzero(first[1:])[0]
    e = np.column_stack([xs[keep], ys[keep], xs[keep + 1], ys[keep + 1]])
    left, foot, right, top = box
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    e = e[(low <= top) & (high >= foot) & (low < high) & (np.maximum(e[:, 0], e[:, 2]) >= left - NUDGE)]
    beyond = np.minimum(e[:, 0], e[:, 2]) > right + NUDGE
    turns, often = np.unique(e[beyond][:, [1, 3]], return_counts=True)
    turns = turns[often % 2 == 1]  # chains cancel but for their ends
    # an edge is crossed at y if just one of its ends lies above y
    base = bool((turns > foot).sum() % 2)
    return e[~beyond], turns[(turns > foot) & (turns <= top)], base


def inside_clip(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray, turns: np.ndarray, base: bool) -> np.ndarray:
    """Which points of a leaf lie inside a region clipped to it."""
    odd = np.full(len(lat), base) ^ (np.searchsorted(turns, lat, side="right") % 2 == 1)
    step = max(1, 2_000_000 // max(1, len(lat)))
    for at in range(0, len(edges), step):
        x0, y0, x1, y1 = edges[at : at + step].T
        y = lat[:, None]
        spans = (y0 > y) != (y1 > y)
        odd ^= (spans & (lon[:, None] < (x1 - x0) * (y - y0) / (y1 - y0) + x0)).sum(1) % 2 == 1
    return odd


def holding_regions(classes: DataFrame, regions: DataFrame, tree: Quadtree, region_key: str, rings: str) -> DataFrame:
    """lat, lon and region of every location inside a region."""
    boxes = leaf_boxes(tree.starts)

    def home(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf_of(pdf["lon"].to_numpy(), pdf["lat"].to_numpy()))

    def touch(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if len(row.xs) < 3:
                    continue
                xs, ys = np.asarray(row.xs, "float64"), np.asarray(row.ys, "float64")
                frame = (xs.min(), ys.min(), xs.max(), ys.max())
                for k in np.nonzero((boxes[:, 0] <= frame[2]) & (boxes[:, 2] >= frame[0]) & (boxes[:, 1] <= frame[3]) & (boxes[:, 3] >= frame[1]))[0]:
                    edges, turns, base = clip_region(xs, ys, np.asarray(row.sizes), boxes[k])
                    if len(edges) or len(turns) or base:
                        out.append((row.region, edges.ravel().tolist(), turns.tolist(), base, *frame, int(k)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CLIPPED.split(", ")])

    def refine(points: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"lat": np.zeros(0), "lon": np.zeros(0), "region": np.array([], dtype=object)})]
        if len(points) and len(shapes):
            lat, lon = points["lat"].to_numpy(), points["lon"].to_numpy()
            index = RTree(np.column_stack([lon, lat, lon, lat]))
            q, e = index.probe(shapes[["x_lo", "y_lo", "x_hi", "y_hi"]].to_numpy("float64"))
            by = np.argsort(q, kind="stable")
            cuts = np.searchsorted(q[by], np.arange(len(shapes) + 1))
            for i, s in enumerate(shapes.itertuples(index=False)):
                at = e[by[cuts[i] : cuts[i + 1]]]
                at = at[inside_clip(lat[at], lon[at], np.asarray(s.edges, "float64").reshape(-1, 4), np.asarray(s.turns, "float64"), s.base)]
                out.append(pd.DataFrame({"lat": lat[at], "lon": lon[at], "region": s.region}))
        return pd.concat(out)

    flat = F.flatten(rings)
    shapes = regions.filter(F.col(region_key).isNotNull() & F.col(rings).isNotNull()).select(
        F.col(region_key).cast("string").alias("region"),
        F.transform(flat, lambda p: p["x"]).alias("xs"), F.transform(flat, lambda p: p["y"]).alias("ys"),
        F.transform(rings, lambda r: F.size(r)).alias("sizes"),
    )
    clipped = shapes.mapInPandas(touch, CLIPPED)
    points = classes.select("lat", "lon").mapInPandas(home, "lat double, lon double, leaf long")
    return points.groupBy("leaf").cogroup(clipped.groupBy("leaf")).applyInPandas(refine, "lat double, lon double, region string")
