"""Mixed timestamp notations to one UTC instant.

``read_texts`` turns text into either an instant (the text names its zone) or a local clock time.
``to_instants`` places local clock times by the clock zone of their file: skipped clock times denote
nothing, repeated ones are resolved by the recording order of the file, and files without a known zone
get the offset history that violates arrival and sequence order least.

Defined results
---------------
* null, empty and unusable text, dates or times that do not exist: null instant, the row stays;
* ``24:00`` is midnight at the end of the day, any other time after it denotes nothing;
* digit runs of up to 11 digits are seconds, of 12 to 14 milliseconds since 1970;
* repeated rows are kept, each gets its own result; extra columns pass through untouched;
* internal columns carry the prefix ``__tm_`` and never clash with the caller's.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import cut_lineage, small_side

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Month names and the zone abbreviations that gauges write, in minutes east of UTC.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "IST": 60, "WEST": 60, "CET": 60,
    "CEST": 120, "EET": 120, "EEST": 180,
}

TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
ZONE = r"(?: *(?P<name>Z|[A-Z]{3,4})| *(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?)?"
# Notations over texts whose digits all read 9, so that equal shapes have their numbers at equal places.
NOTATIONS = [
    rf"(?P<y>9{{4}})(?P<x>[-/.])(?P<mo>9{{1,2}})(?P=x)(?P<d>9{{1,2}})[T ] *{TIME}{ZONE}",
    rf"(?P<a>9{{1,2}})(?P<x>[-/.])(?P<b>9{{1,2}})(?P=x)(?P<c>9{{4}}|99)[T ,] *{TIME}(?: ?(?P<half>[AP]M))?{ZONE}",
    rf"(?P<y>9999)(?P<mo>99)(?P<d>99)T(?P<h>99)(?P<mi>99)(?P<s>99)?{ZONE}",
    rf"(?:[A-Z]{{3,9}},? )?(?P<d>9{{1,2}})[- ](?P<mon>{'|'.join(MONTHS)})[A-Z]*[- ](?P<y>9999),? {TIME}{ZONE}",
    rf"(?P<y>9999)-(?P<doy>999)[T ]{TIME}{ZONE}",
    r"(?P<epoch>9{1,14})",
]
PLAIN = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}\.\d{3}Z| \d{2}:\d{2}:\d{2}\+00:00)$"
NONE = np.iinfo("int64").min


def _epoch_day(y, m, d):
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _read_shape(match, cells: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instant and clock time of all texts of one shape; cells: their bytes as a matrix, order: their date orders."""
    n = len(cells)
    none = np.full(n, NONE)

    def number(name: str, absent: int = 0) -> np.ndarray:
        if name not in match.re.groupindex or match.start(name) < 0:
            return np.full(n, absent, "int64")
        digits = cells[:, match.start(name) : match.end(name)].astype("int64") - 48
        return digits @ (10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype="int64"))

    group = lambda name: match[name] if name in match.re.groupindex else None
    if group("epoch"):
        return number("epoch") * (SECOND if len(match["epoch"]) <= 11 else 1000), none
    known = np.ones(n, bool)
    if group("c"):
        a, b, c = number("a"), number("b"), number("c")
        wide = lambda v: v + np.where(v < 70, 2000, 1900)
        short = len(match["c"]) == 2
        lead = (order == "ymd") & short
        y = np.where(lead, wide(a), wide(c) if short else c)
        m = np.where(lead | (order == "dmy"), b, a)
        d = np.where(lead, c, np.where(order == "dmy", a, b))
        known = lead | (order == "dmy") | (order == "mdy")
    else:
        y, d = number("y"), number("d")
        m = np.full(n, MONTHS.index(group("mon")) + 1, "int64") if group("mon") else number("mo")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    if group("doy"):
        m, d = np.ones(n, "int64"), number("doy")
        length = np.where(leap, 366, 365)
    else:
        length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((m >= 1) & (m <= 12), m, 0)] + (leap & (m == 2))
    h, mi, s = number("h"), number("mi"), number("s")
    fraction = (match["f"] if group("f") else "")[:6]
    us = np.zeros(n, "int64")
    if fraction:
        at = match.start("f")
        us = (cells[:, at : at + len(fraction)].astype("int64") - 48) @ (10 ** np.arange(5, 5 - len(fraction), -1, dtype="int64"))
    if group("half"):
        known = known & (h >= 1) & (h <= 12)
        h = h % 12 + (12 if group("half") == "PM" else 0)
    midnight = (h == 24) & (mi == 0) & (s == 0) & (us == 0)
    known = known & (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (mi <= 59) & (s <= 59) & ((h <= 23) | midnight)
    clock = _epoch_day(y, m, d) * DAY + h * HOUR + mi * MINUTE + s * SECOND + us
    if group("sign"):
        oh, om = number("oh"), number("om")
        known = known & (oh <= 18) & (om <= 59)
        return np.where(known, clock - (oh * HOUR + om * MINUTE) * (1 if match["sign"] == "+" else -1), NONE), none
    if group("name"):
        offset = ABBREVIATIONS.get(match["name"])
        return (none, none) if offset is None else (np.where(known, clock - offset * MINUTE, NONE), none)
    return none, np.where(known, clock, NONE)


_SHAPES: dict[str, object] = {}


def _notation(shape: str):
    if shape in _SHAPES:
        return _SHAPES[shape]
    match = next((m for x in NOTATIONS if (m := re.fullmatch(x, shape))), None)
    if len(shape) <= 128:  # longer ones are read too, but not remembered
        if len(_SHAPES) > 20_000:
            _SHAPES.clear()
        _SHAPES[shape] = match
    return match


def read_texts(text: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants and clock times, in microseconds, of a batch of texts; NONE where there is none."""
    text = pc.utf8_upper(pc.utf8_trim_whitespace(text.cast(pa.string())))
    shapes = pc.replace_substring_regex(text, "[0-9]", "9").dictionary_encode()
    utc, local = np.full(len(text), NONE), np.full(len(text), NONE)
    codes = pc.fill_null(shapes.indices, -1).to_numpy(zero_copy_only=False)
    by = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[by], np.arange(len(shapes.dictionary) + 1))
    for k, shape in enumerate(shapes.dictionary.to_pylist()):
        if not shape.isascii() or (match := _notation(shape)) is None:
            continue
        rows = by[starts[k] : starts[k + 1]]
        cells = np.frombuffer("".join(text.take(pa.array(rows)).to_pylist()).encode(), "uint8").reshape(len(rows), len(shape))
        utc[rows], local[rows] = _read_shape(match, cells, order[rows])
    return utc, local


#: Offsets are looked up from 1800 on; from 2037 on they repeat with the calendar, every 400 years.
HISTORY_FROM, HISTORY_TO, CYCLE = -5_364_662_400, 14_736_988_800, 146_097 * DAY


@lru_cache(64)
def _zone_history(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Instants at which the zone's offset changes, and the offsets before, between and after."""
    z, week = ZoneInfo(zone), 7 * 24 * 3600
    off = lambda t: int(datetime.fromtimestamp(t, z).utcoffset().total_seconds())
    at, offsets = [], [off(HISTORY_FROM)]
    for t in range(HISTORY_FROM, HISTORY_TO, week):
        lo, hi = t, t + week
        if off(hi) == offsets[-1]:
            continue
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if off(mid) == offsets[-1] else (lo, mid)
        at.append(hi)
        offsets.append(off(hi))
    return np.array(at, "int64") * SECOND, np.array(offsets, "int64") * SECOND


def _into_history(us: np.ndarray) -> np.ndarray:
    """What to take off times after the looked-up years to find their like within them."""
    return np.maximum(0, (us - (HISTORY_TO * SECOND - 2 * DAY)) // CYCLE + 1) * CYCLE


def near_change(instant: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """The zone's backward change within six hours of each instant (else NONE), and whether it is past."""
    at, offsets = _zone_history(zone)
    back = np.where(instant == NONE, 0, _into_history(instant))
    u = np.where(instant == NONE, 0, instant - back)
    if not len(at):
        return np.full(len(u), NONE), np.zeros(len(u), bool)
    k = np.searchsorted(at, u + 6 * HOUR, side="right") - 1
    safe = np.clip(k, 0, None)
    near = (instant != NONE) & (k >= 0) & (at[safe] >= u - 6 * HOUR) & (offsets[safe] > offsets[safe + 1])
    change = np.where(near, at[safe] + back, NONE)
    return change, near & (instant >= change)


def place_clock(local: np.ndarray, zone: str):
    """First and second instant of clock times in a zone, the backward change within six hours (else NONE), and whether it is past.

    A skipped clock time has no instant; one that does not repeat has the same instant twice.
    """
    at, offsets = _zone_history(zone)
    off = lambda u: offsets[np.searchsorted(at, u, side="right")]
    back = _into_history(local)
    inside = local - back
    before, after = off(inside - DAY), off(inside + DAY)
    a, b = inside - before, inside - after
    ok_a, ok_b = off(a) == before, off(b) == after
    first = np.where(ok_a, a + back, np.where(ok_b, b + back, NONE))
    second = np.where(ok_b, b + back, first)
    return first, second, *near_change(first, zone)


INSTANT = T.StructType([T.StructField(x, T.BooleanType() if x == "past" else T.LongType()) for x in ("first", "second", "change", "past", "clock")])


@F.arrow_udf(INSTANT)
def instant_of(text: pa.Array, order: pa.Array, zone: pa.Array, fixed: pa.Array) -> pa.Array:
    orders = order.dictionary_encode()
    names = np.array([*(x.strip().lower() for x in orders.dictionary.to_pylist()), ""], dtype=object)
    order = names[pc.fill_null(orders.indices, -1).to_numpy(zero_copy_only=False)]
    utc, local = read_texts(text, order)
    first, second, change, past = utc.copy(), utc.copy(), np.full(len(utc), NONE), np.zeros(len(utc), bool)
    minutes = pc.fill_null(fixed, NONE).to_numpy(zero_copy_only=False)
    rows = np.nonzero((local != NONE) & (minutes != NONE))[0]
    first[rows] = second[rows] = local[rows] - minutes[rows] * MINUTE
    zones = zone.dictionary_encode()
    codes = pc.fill_null(zones.indices, -1).to_numpy(zero_copy_only=False)
    open_ = (local != NONE) & (minutes == NONE)
    stated = (utc != NONE) & (minutes == NONE)
    for k, z in enumerate(zones.dictionary.to_pylist()):
        if len(rows := np.nonzero(open_ & (codes == k))[0]):
            first[rows], second[rows], change[rows], past[rows] = place_clock(local[rows], z)
        if len(rows := np.nonzero(stated & (codes == k))[0]):  # lines with a zone of their own bind the clock times around them
            change[rows], past[rows] = near_change(utc[rows], z)
    longs = [pa.array(x, pa.int64(), mask=x == NONE) for x in (first, second, change, local)]
    return pa.StructArray.from_arrays([*longs[:3], pa.array(past), longs[3]], ["first", "second", "change", "past", "clock"])


def zone_table(files: DataFrame, file_id: str = "file_id", clock_zone: str = "clock_zone", date_order: str = "date_order") -> DataFrame:
    """One row per file: its zone if that is a known one, the offset where the zone has but one, the date order.

    Of repeated file ids one row stays, so that a join never multiplies readings.
    """

    @F.pandas_udf("struct<zone: string, fixed: long>")
    def known(zone: pd.Series) -> pd.DataFrame:
        def one(z):
            if z is None or z != z or not z.strip():
                return None, None
            z = z.strip()
            if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?", z):
                return z, (int(m[2]) * 60 + int(m[3] or 0)) * (1 if m[1] == "+" else -1)
            if z.upper() in ("UTC", "GMT", "Z", "ETC/UTC"):
                return z, 0
            if m := re.fullmatch(r"Etc/GMT([+-])(\d{1,2})", z):  # POSIX: the sign counts west
                return z, int(m[2]) * 60 * (-1 if m[1] == "+" else 1)
            try:
                ZoneInfo(z)
            except Exception:
                return None, None
            return z, None

        seen = {z: one(z) for z in zone.unique()}
        return pd.DataFrame([seen[z] for z in zone], columns=["zone", "fixed"]).astype({"fixed": "Int64"})

    rows = files.filter(F.col(file_id).isNotNull()).groupBy(F.col(file_id).alias("__tm_file")).agg(
        F.max(clock_zone).alias("__tm_raw"), F.max(date_order).alias("__tm_order")
    )
    rows = rows.withColumn("__tm_k", known("__tm_raw"))
    return rows.select("__tm_file", "__tm_order", F.col("__tm_k.zone").alias("__tm_cz"), F.col("__tm_k.fixed").alias("__tm_fixed"))


def _choose_switch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per file and backward change: the switch of offset that violates the recording order least.

    Rows before the switch keep the first instant, rows from it on the second; clock times that occur
    once bind it. Cost: instants that do not increase, then the steps that differ from the usual one.
    """
    pdf = pdf.sort_values(["line", "first", "k"], kind="stable")
    first, second, past = (pdf[c].to_numpy() for c in ("first", "second", "past"))
    n, twice = len(pdf), first != second
    lo = int(np.max(np.nonzero(~twice & ~past)[0], initial=-1)) + 1
    hi = int(np.min(np.nonzero(~twice & past)[0], initial=n))
    if hi < lo:  # lines out of order bind it both ways: the cost alone decides
        lo, hi = 0, n
    steps = np.diff(first)
    usual = float(np.median(steps[steps > 0])) if (steps > 0).any() else 0.0
    # one long hole is likelier than two shorter ones, hence the root
    cost = lambda step: (step <= 0) * 1e6 + np.sqrt(np.abs(step - usual) / HOUR)
    before = np.concatenate([[0.0], np.cumsum(cost(np.diff(first)))])
    after = np.concatenate([np.cumsum(cost(np.diff(second))[::-1])[::-1], [0.0]])
    ks = np.arange(lo, hi + 1)
    inner = (ks > 0) & (ks < n)
    seam = np.where(inner, cost(second[np.clip(ks, 0, n - 1)] - first[np.clip(ks - 1, 0, n - 1)]), 0.0)
    total = np.where(ks > 0, before[np.clip(ks - 1, 0, n - 1)], 0) + seam + np.where(ks < n, after[np.clip(ks, 0, n - 1)], 0)
    k = int(ks[np.argmin(np.round(total, 6))])  # of equal costs the earliest, whatever the order of summation
    return pd.DataFrame({"__tm_key": pdf["k"], "__tm_fold": np.where(np.arange(n) < k, first, second)})[twice]


def to_instants(
    readings: DataFrame,
    files: DataFrame,
    *,
    key: str = "reading_id",
    text: str = "datetime",
    file_id: str = "file_id",
    line_no: str = "line_no",
    ingested_at: str = "ingested_at",
    out: str = "utc_us",
    only: Column | None = None,
    estimate_zones: bool = True,
) -> DataFrame:
    """Adds ``out``: microseconds since 1970 UTC, or null where the text denotes no instant.

    One pass over the files whose zone is unknown or changes its offset keeps the clock times that need
    their neighbours: those within six hours of a backward change, and all of files without a zone. From
    these few, written once, zones are estimated and the switches chosen, by file and change. A second pass
    places every reading by Arrow batches. ``only`` restricts the rows that come out, never the lines that
    decide. Readings without key or line keep the first of two instants.
    """
    zones = small_side(zone_table(files))
    when = instant_of(text, "__tm_order", "__tm_cz", "__tm_fixed")
    unsettled = zones.filter("__tm_fixed is null")
    near = readings.select(
        F.col(key).alias("__tm_k"), F.col(file_id).alias("__tm_f"), F.col(line_no).cast("bigint").alias("__tm_l"),
        F.col(text).alias("__tm_t"), F.unix_micros(ingested_at).alias("__tm_a"),
    )
    near = near.join(unsettled, F.col("__tm_f") == F.col("__tm_file")).withColumn("__tm_i", instant_of("__tm_t", "__tm_order", "__tm_cz", "__tm_fixed"))
    near = cut_lineage(near.filter("__tm_i.change is not null or (__tm_cz is null and __tm_i.clock is not null)"))
    nameless = near.filter("__tm_cz is null")
    if estimate_zones and not nameless.isEmpty():
        guessed = small_side(_estimated_zones(nameless, readings, files, zones, text, file_id))
        zones = small_side(zones.join(guessed, F.col("__tm_file") == F.col("__tm_g"), "left").select(
            "__tm_file", "__tm_order", F.coalesce("__tm_cz", "__tm_gz").alias("__tm_cz"),
            F.when(F.col("__tm_cz").isNotNull(), F.col("__tm_fixed")).otherwise(F.col("__tm_gm")).alias("__tm_fixed"),
        ))
        again = nameless.drop("__tm_file", "__tm_order", "__tm_cz", "__tm_fixed", "__tm_i").join(zones, F.col("__tm_f") == F.col("__tm_file"))
        again = again.withColumn("__tm_i", instant_of("__tm_t", "__tm_order", "__tm_cz", "__tm_fixed"))
        near = near.filter("__tm_cz is not null").unionByName(again.select(near.columns))
    context = near.filter("__tm_i.change is not null and __tm_k is not null and __tm_l is not null").select(
        F.col("__tm_k").alias("k"), F.col("__tm_f").alias("f"), F.col("__tm_l").alias("line"), "__tm_i.*"
    )
    chosen = small_side(context.groupBy("f", "change").applyInPandas(
        _choose_switch, f"__tm_key {dict(readings.dtypes)[key]}, __tm_fold long"
    ))
    kept = readings.columns
    rows = readings if only is None else readings.filter(only)
    placed = rows.join(zones, F.col(file_id) == F.col("__tm_file"), "left").withColumn("__tm_i", when)
    return placed.join(chosen, F.col(key) == F.col("__tm_key"), "left").select(
        *kept, F.coalesce("__tm_fold", "__tm_i.first").alias(out)
    )


def _estimated_zones(nameless: DataFrame, readings: DataFrame, files: DataFrame, zones: DataFrame, text: str, file_id: str) -> DataFrame:
    """__tm_g (file), __tm_gz and __tm_gm: the zone that a file without one is most likely written in.

    Candidates are the zones of all files and the whole hours from -12 to +14. Every clock time of the file is
    placed by each of them and violates it if the zone skips it or if it would lie after its own arrival; lines
    that would overlap the files before and after it in the gauge's order violate it too. The candidate with
    the fewest violations wins; of several that which leaves the smallest holes to its arrival and neighbours.
    Tasks count by file and candidate before anything is shuffled.
    """
    # zone names are bounded by the zone database and the minutes of a day, whatever the number of files
    named = {(r["__tm_cz"], r["__tm_fixed"]) for r in zones.filter("__tm_cz is not null").select("__tm_cz", "__tm_fixed").distinct().collect()}
    candidates = sorted(named | {(f"{'-' if h < 0 else '+'}{abs(h):02d}:00", h * 60) for h in range(-12, 15)}, key=str)
    order = files.filter(F.col("file_id").isNotNull()).groupBy(F.col("file_id").alias("__tm_file")).agg(F.max("station_ref").alias("st"), F.max("seq_no").alias("seq_no"))
    gauges = order.join(nameless.select("__tm_file").distinct(), "__tm_file", "left_semi").select("st").distinct()
    known = readings.select(file_id, text).join(small_side(order.join(gauges, "st", "left_semi").join(zones, "__tm_file")), F.col(file_id) == F.col("__tm_file"))
    known = known.withColumn("i", instant_of(text, "__tm_order", "__tm_cz", "__tm_fixed"))
    spans = known.groupBy("__tm_file", "st", "seq_no").agg(F.min("i.first").alias("u_lo"), F.max("i.first").alias("u_hi"))
    before = Window.partitionBy("st").orderBy("seq_no", "__tm_file")
    # the nearest file with a known instant on either side, past others without a zone
    around = spans.select(
        "__tm_file", F.last("u_hi", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.first("u_lo", ignorenulls=True).over(before.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
    )
    clocks = nameless.select("__tm_file", F.col("__tm_i.clock").alias("clock"), F.col("__tm_a").alias("arrived")).join(small_side(around), "__tm_file", "left")

    def trials(batches):
        for pdf in batches:
            out = []
            for file, part in pdf.groupby("__tm_file", sort=False):
                clock = part["clock"].to_numpy("int64")
                bounds = [pd.to_numeric(part[c]).to_numpy("float64") for c in ("arrived", "left", "right")]
                for k, (zone, minutes) in enumerate(candidates):
                    u = clock - minutes * MINUTE if minutes is not None else place_clock(clock, zone)[0]
                    skipped = u == NONE
                    arrived, left, right = (np.where(skipped, np.nan, b - u) / HOUR for b in bounds)
                    wrong = skipped.sum() + (arrived < 0).sum() + (left > 0).sum() + (right < 0).sum()
                    holes = [np.abs(x[~np.isnan(x)]).min(initial=np.inf) for x in (arrived, left, right)]
                    out.append((file, k, int(wrong), *holes))
            yield pd.DataFrame(out, columns=["f", "k", "wrong", "h1", "h2", "h3"])

    tried = clocks.mapInPandas(trials, f"f {dict(clocks.dtypes)['__tm_file']}, k int, wrong long, h1 double, h2 double, h3 double")
    finite = lambda c: F.when(F.min(c) < float("inf"), F.min(c)).otherwise(0.0)
    tried = tried.groupBy("f", "k").agg(F.sum("wrong").alias("wrong"), (finite("h1") + finite("h2") + finite("h3")).alias("holes"))
    z, m = (F.get(F.array(*[F.lit(c[i]) for c in candidates]), F.col("k")) for i in (0, 1))
    tried = tried.withColumns({"z": z, "m": m.cast("bigint")})
    best = F.min_by(F.struct("z", "m"), F.struct("wrong", F.round("holes", 6), F.abs(F.coalesce("m", F.lit(30))), "z"))
    return tried.groupBy(F.col("f").alias("__tm_g")).agg(best.alias("b")).select("__tm_g", F.col("b.z").alias("__tm_gz"), F.col("b.m").alias("__tm_gm"))


def restated_instants(readings: DataFrame, files: DataFrame) -> DataFrame:
    """reading_id and utc_ms of readings whose text is in neither plain notation but denotes an instant."""
    rows = readings.select("reading_id", "file_id", "line_no", "station_ref", "datetime", "ingested_at")
    restated = F.col("datetime").isNotNull() & ~F.col("datetime").rlike(PLAIN)
    found = to_instants(rows, files, only=restated).filter("utc_us is not null")
    return found.select("reading_id", F.floor(F.col("utc_us") / 1000).cast("bigint").alias("utc_ms"))
