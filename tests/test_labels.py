import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import crossval as V
from tidemark.operators import labels as L

levels = st.lists(st.integers(0, 6), min_size=6, max_size=40)


@settings(max_examples=200, deadline=None)
@given(levels)
def test_peaks_agree_with_a_plain_search(v):
    v, want, n = np.array(v, float), [], len(v)
    a = 0
    while a < n:
        b = a
        while b + 1 < n and v[b + 1] == v[a]:
            b += 1
        if 0 < a and b < n - 1 and v[a - 1] < v[a] > v[b + 1]:
            lows = []
            for step, at in ((-1, a), (1, b)):
                low = v[a]
                while 0 <= at < n and v[at] <= v[a]:
                    low, at = min(low, v[at]), at + step
                lows.append(low)
            if v[a] - max(lows) >= 2:
                want.append((a + b) // 2)
        a = b + 1
    assert L._peaks(v, 2).tolist() == want


def test_base_flow_agrees_with_the_recursion_on_long_records():
    rng = np.random.default_rng(0)
    v = np.abs(np.cumsum(rng.normal(size=20_000))) + 1
    q = np.zeros(len(v))
    for i in range(1, len(v)):
        q[i] = max(0.0, 0.925 * q[i - 1] + 1.925 / 2 * (v[i] - v[i - 1]))
    assert np.abs(L._base(v, 0.925) - np.clip(v - q, 0, v)).max() < 1e-9


def test_interpolation_limit(spark):
    from datetime import date, timedelta

    v = [None, 1.0, None, None, None, None, 6.0, None, None, None, None]
    df = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(days=k), x) for k, x in enumerate(v)], "station_id string, day date, value double")
    assert [r.filled for r in L.interpolate(df).orderBy("day").collect()] == [None, 1, 2, 3, 4, None, 6, 6, 6, 6, None]


def test_folds_are_disjoint_and_purged(spark):
    from datetime import date, timedelta

    df = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(days=k)) for k in range(23)], "s string, d date")
    folds = V.blocked_folds(df, "s", ["d"], 5)
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [5, 5, 4, 5, 4]
    roles = V.fold_roles(folds, "s", "d", 2).collect()
    for f in range(5):
        test = [r.d for r in roles if r.f == f and r.role == "test"]
        train = [r.d for r in roles if r.f == f and r.role == "train"]
        assert min(abs((a - b).days) for a in test for b in train) > 2
