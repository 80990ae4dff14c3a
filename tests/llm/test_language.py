import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as L


@pytest.fixture(scope="module")
def net(spark):
    return L.train_network(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, net):
    """Texts of another table, by their labels; labels are wrong in places, so agreement has a ceiling."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("l", L.label_of(F.col("lang"))).filter("l is not null and length(text) > 60").select("text", "l").limit(1500).toPandas()
    segs = L.segments_of(docs["text"].tolist(), net)
    agree = np.mean([s[0][1] == l for s, l in zip(segs, docs["l"]) if len(s) == 1])
    assert agree > 0.85


def test_mixed_texts_are_cut_where_the_language_changes(net):
    en, ru, de = "The miller sees the old clock every morning. ", "Мельник ищет цену дров в первый раз. ", "Der Müller sieht die alte Uhr jeden Morgen. "
    segs = L.segments_of([en * 3 + ru * 2 + de * 3], net)[0]
    assert [s[1] for s in segs] == ["en", "ru", "de"] and [s[0] for s in segs] == [1, 2, 3]
    text = en * 3 + ru * 2 + de * 3
    assert text[segs[1][3] : segs[1][4]].strip() == (ru * 2).strip()
    assert all(0 < s[2] <= 1 for s in segs)


def test_wordless_texts_have_no_segment(net):
    texts = [None, "", "   ", "12.4; 12.51", "🌊🌊🌊", "0xf310 0x05c0", "━━━━", "<seg id=\"4\">12</seg>", "2021-03-04 06:15 | 254 | 1.203"]
    assert L.segments_of(texts, net) == [[]] * len(texts)


def test_quotes_markup_and_broken_encoding_do_not_vote(net):
    a = "The miller sees the old clock every morning («потихоньку»)."
    b = '<seg id="7">The miller sees the old clock every morning.</seg>&nbsp;'
    c = "De las notas del dÃ\xada: Nuestro alcalde protege una cesta con ciruelas por primera vez."
    assert [[s[1] for s in x] for x in L.segments_of([a, b, c], net)] == [["en"], ["en"], ["es"]]


def test_labels(spark):
    names = ["EN", " eng ", "en-US", "fr_CA", "German", "dut", "nld", "pt_BR", "unknown", "", None, "xx", "-", "und", "entirely"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, lang string")
    got = [r.l for r in df.orderBy("i").select(L.label_of(F.col("lang")).alias("l")).collect()]
    assert got == ["en", "en", "en", "fr", "de", "nl", "nl", "pt", *[None] * 7]


def test_best_path_is_the_best_of_all(net):
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(0, 2, (5, 3))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert np.isclose(value(L.best_path(s, 1.5)), max(value(p) for p in itertools.product(range(3), repeat=5)))


def test_found_rows_nulls_and_empty(spark, net):
    en, pl = "The miller sees the old clock every morning.", "Młynarz widzi stary zegar każdego ranka bez słowa."
    rows = [(1, en, "English", 0), (2, en, "pl", 0), (3, en, None, 0), (4, f"{en} {en}\n{pl} {pl}", "en", 0), (5, None, "en", 0), (6, "", None, 0), (2, en, "pl", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    got = sorted(tuple(r) for r in L.mislabelled(L.language_segments(df, net=net)).collect())
    assert got == [(2, 1, "en"), (2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "pl")]
    assert L.language_segments(df.limit(0)).count() == 0


def test_long_white_space_and_long_texts(net):
    segs = L.segments_of([" " * 200_000 + "The miller sees the old clock. " * 2000], net)[0]
    assert [s[1] for s in segs] == ["en"]


def test_windows_in_any_order_score_alike(net):
    texts = ["a", "The miller sees the old clock every morning.", "ż" * 300, "Мельник ищет цену дров в первый раз. " * 9, ""]
    x, _ = L.windows(texts)
    assert np.allclose(net.log_shares(x), net.forward(x), atol=1e-4)
    assert np.allclose(net.log_shares(x[::-1]), net.log_shares(x)[::-1], atol=1e-4)


def test_a_sample_is_trained_on_once(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = L.train_network(docs, folder=str(tmp_path))
    monkeypatch.setattr(L, "fit", lambda got: pytest.fail("trained again"))
    again = L.train_network(docs.repartition(3), folder=str(tmp_path))
    assert all((first.p[k] == again.p[k]).all() for k in first.p)


def test_what_fits_no_language_is_other(spark, net):
    rows = [(1, "The miller sees the old clock every morning.", "en"), (2, "Qwzx vbnh jklp trwq zxcv mnbv.", None)]
    got = {r.doc_id: (r.lang, r.outcome, r.confidence) for r in L.language_segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net=net).collect()}
    assert got[1][:2] == ("en", "en")
    assert all((outcome == "other") == (p < L.SURE) for _, outcome, p in got.values())
