import json

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import tokens as T

TEXTS = [
    "", None, " ", "Hello world", "don't we've  x\n\n y ", "Привет, мир!", "🌊🌊🌊 <|endoftext|> end", "a" * 3000, "12ab34 cd-56", "\t\r\n  \xa0​", "naïve café — «тест»",
    "x y" * 60_000, "word1234 " * 20_000, "é" * 70_000, " " * 70_000 + "end", "ends in spaces   ",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_ids_equal_those_of_the_whole_text_and_of_the_other_library(df):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    enc = T.encoding()
    for i, t in enumerate(TEXTS):
        assert got[i] == ([] if not t else enc.encode_ordinary(t))
        if t and len(t) < 5000:
            assert got[i] == other.encode(t, add_special_tokens=False).ids


def test_round_trip(df):
    back = {r.doc_id: r.back for r in df.select("doc_id", T.decode(T.encode("text")).alias("back")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_bytes_that_are_no_text_decode_to_null(spark):
    half = T.encoding().encode_ordinary("я")[:1] if len(T.encoding().encode_ordinary("🌊")) == 1 else T.encoding().encode_ordinary("🌊")[:1]
    df = spark.createDataFrame([(half,), ([99999999],), (None,)], "ids array<int>")
    assert [r.t for r in df.select(T.decode("ids").alias("t")).collect()] == [None, None, None]


def test_pieces_join_to_the_text():
    for t in TEXTS:
        if t:
            assert "".join(T.safe_pieces(t, 50)) == t
            assert [i for p in T.safe_pieces(t, 50) for i in T.encoding().encode_ordinary(p)] == T.encoding().encode_ordinary(t)


def test_counts_and_empty(df):
    n = {r.doc_id: r.n for r in df.select("doc_id", T.count_tokens("text").alias("n")).collect()}
    assert n[0] == n[1] == 0 and n[3] == 2
    assert T.encode_corpus(df.limit(0)).count() == 0
