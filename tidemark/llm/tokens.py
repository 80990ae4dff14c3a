"""Encoding of a corpus with a public byte-level tokenizer, by tiktoken and a local rank file.

A worker loads the rank file once, from a path that every executor must see. Texts are encoded whole;
a long text is first cut where the tokenizer's own pattern always cuts (before white space that follows
something else, and between letters and digits), so its pieces encode to exactly the ids of the whole.

Defined results
---------------
* null and empty texts give an empty list of ids; special markers are ordinary text;
* repeated rows are encoded each; extra columns are not read; an empty table gives no rows;
* a stretch without any safe boundary is encoded in one go, whatever its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut at safe boundaries into pieces of about this size.
PIECE_CHARS = 65_536
SAFE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"


@lru_cache(4)
def encoding(ranks: str = RANKS):
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of a text whose ids, one after the other, are the ids of the text."""
    if len(text) <= size:
        return [text]
    import regex

    out, start = [], 0
    for m in regex.finditer(SAFE, text):
        if m.start() - start >= size:
            out.append(text[start : m.start()])
            start = m.start()
    return [*out, text[start:]]


def encode_texts(texts: pa.Array, ranks: str = RANKS) -> list[np.ndarray]:
    """ids of each text as an array of its own; no list of Python integers is held for a batch."""
    enc = encoding(ranks)
    none = np.zeros(0, "int32")

    def one(t: str) -> np.ndarray:
        parts = [enc.encode_to_numpy(p, disallowed_special=()).astype("int32") for p in safe_pieces(t)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return [one(t.as_py()) if t.is_valid and len(t.as_py()) else none for t in texts]


def encode(text: str | Column, ranks: str = RANKS) -> Column:
    """ids (array of int) of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        lists = encode_texts(texts, ranks)
        ends = np.cumsum([0, *map(len, lists)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, "int32")))

    return ids(text)


def count_tokens(text: str | Column, ranks: str = RANKS) -> Column:
    """Number of ids of a text column; the ids stay in the worker."""

    @F.arrow_udf(T.LongType())
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([len(x) for x in encode_texts(texts, ranks)], pa.int64())

    return size(text)


def decode(ids: str | Column, ranks: str = RANKS) -> Column:
    """Text of a list of ids, joined as raw bytes before they are read as UTF-8; null where they are no UTF-8."""

    @F.arrow_udf(T.StringType())
    def text(lists: pa.Array) -> pa.Array:
        enc = encoding(ranks)

        def one(x):
            if x is None:
                return None
            try:
                return b"".join(map(enc.decode_single_token_bytes, x)).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                return None

        return pa.array([one(x) for x in lists.to_pylist()], pa.string())

    return text(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """key and ids of every row."""
    return documents.select(key, encode(text, ranks).alias("ids"))
