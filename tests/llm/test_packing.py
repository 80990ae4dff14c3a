import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200))
def test_items_never_overlap_or_overflow(sizes):
    sizes = np.array(sizes, "int64")
    container, offset, tier = P.pack_tiers(sizes, 64)
    for c in set(container.tolist()):
        mine = np.nonzero(container == c)[0]
        spans = sorted((int(offset[i]), int(offset[i] + sizes[i])) for i in mine)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 64
    n = int(container.max()) + 1 if len(sizes) else 0
    if n > 1:  # any fit: at most one container is half empty
        used = np.bincount(container, weights=sizes, minlength=n)
        assert (used <= 32).sum() <= 1


def test_step_groups_are_alike_over_all_containers(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int((rng.integers(1, 600, 3) ** 2).sum())) for k in range(640)]
    got = P.deal_groups(spark.createDataFrame(rows, "container_id long, cost long").repartition(5), 64).collect()
    cost = np.bincount([r.step_group for r in got], weights=[r.cost for r in got])
    assert len(cost) == 10 and cost.max() / cost.min() < 1.1 and np.bincount([r.step_group for r in got]).tolist() == [64] * 10
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {r[0]: k % 10 if k // 10 % 2 == 0 else 9 - k % 10 for k, r in enumerate(ranked)}
    assert {r.container_id: r.step_group for r in got} == want


def test_tiers_change_the_packing_and_leave_little():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 2048, 6000), rng.integers(5, 220, 20_000), np.minimum(2048, rng.lognormal(4.5, 1.2, 20_000).astype("int64"))):
        four, one = P.pack_tiers(sizes, 2048, 4), P.pack_tiers(sizes, 2048, 1)
        assert (four[0] != one[0]).any() and set(four[2]) > {0, 1} or sizes.max() <= 256
        assert sizes.sum() / (2048 * (four[0].max() + 1)) > 0.99
        # a tier's windows stay together: items of the shortest tier lie beside each other within one context size of its own
        assert four[2].tolist() == [next(k for k in (3, 2, 1, 0) if s <= 2048 >> k) for s in sizes]


def test_containers_do_not_depend_on_the_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(30))
    key = ["container_id", "doc_id", "part_no", "n_tokens", "place", "tier", "step_group"]
    a, b = (sorted(map(tuple, P.pack_documents(x).select(key).collect())) for x in (docs.coalesce(1), docs.orderBy("text").repartition(7)))
    assert a == b


def test_texts_come_out_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ITEMS", 50)
    texts = ["", None] + ["word " * n for n in (1, 10, 2047, 2048, 2049, 5000, 100, 100)] + ["some words here"] * 100
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    rows = P.pack_documents(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    from tidemark.llm.tokens import encoding

    for i, t in enumerate(texts):
        n = len(encoding().encode_ordinary(t)) if t else 0
        parts = sorted(by[i], key=lambda r: r.part_no)
        assert sum(p.n_tokens for p in parts) == n and len(parts) == max(1, -(-n // 2048))
        assert [p.start_token for p in parts] == [2048 * k for k in range(len(parts))]
    used = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 2048


def test_little_is_left_unused(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    use = P.container_use(P.pack_documents(docs)).selectExpr("sum(used) / (2048 * count(*)) AS share").first()
    assert use["share"] > 0.98


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
