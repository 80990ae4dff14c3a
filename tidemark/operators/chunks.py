"""Column chunks of Parquet files, read inside tasks: footers, dictionary pages, and whole chunks where those do not suffice.

A chunk is one column of one row group. Its footer gives rows, nulls and, but for floats, exact extrema. If
all its data pages point into a dictionary, the dictionary page alone holds its distinct values; page headers
tell, and no data page is read. Whatever is left is scanned, chunk by chunk.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

# Fixed values of the file format: page types and the two names of the dictionary encoding.
DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
BY_DICTIONARY = (2, 8)
WIDTHS = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}
SCAN_ROWS = 65_536


@lru_cache(8)
def opened(uri: str) -> tuple[pq.ParquetFile, pa.NativeFile]:
    """A file and its footer, kept for the chunks of it that a task reads one after another."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri).replace("s3a://", "s3://", 1))
    handle = system.open_input_file(name)
    return pq.ParquetFile(handle), handle


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes, i: int) -> tuple[dict[int, object], int]:
    """The fields of one structure in the format's compact notation, by their numbers; raises IndexError if cut off."""
    out, number = {}, 0
    while b[i]:
        kind, step, i = b[i] & 15, b[i] >> 4, i + 1
        if step:
            number += step
        else:
            z, i = _varint(b, i)
            number = (z >> 1) ^ -(z & 1)
        if kind in (1, 2):
            out[number] = kind == 1
        elif kind in (3, 4, 5, 6):
            z, i = _varint(b, i)
            out[number] = (z >> 1) ^ -(z & 1)
        elif kind == 7:
            i += 8
        elif kind == 8:
            n, i = _varint(b, i)
            i += n
        elif kind == 12:
            out[number], i = _fields(b, i)
        else:
            raise ValueError(f"page header with a field of kind {kind}")
        if i > len(b):
            raise IndexError
    return out, i + 1


def _page(handle: pa.NativeFile, at: int, end: int) -> tuple[dict, int]:
    """Header of the page at a position, and where its body begins."""
    size = 256
    while True:
        handle.seek(at)
        raw = handle.read(min(size, end - at))
        try:
            header, n = _fields(raw, 0)
            return header, at + n
        except IndexError:
            if size >= end - at:
                raise ValueError("page header cut off") from None
            size *= 8


def dictionary_of(uri: str, group: int, column: str) -> pa.Array | None:
    """The dictionary's values if every data page of the chunk points into it, else None. Reads headers and that one page."""
    file, handle = opened(uri)
    at = file.schema.names.index(column)
    chunk = file.metadata.row_group(group).column(at)
    if not chunk.has_dictionary_page or chunk.dictionary_page_offset is None or chunk.physical_type not in (*WIDTHS, "BYTE_ARRAY"):
        return None
    kind = file.schema_arrow.field(column).type
    if pa.types.is_decimal(kind) or pa.types.is_nested(kind):
        return None
    pos, end = chunk.dictionary_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size
    body = None
    while pos < end:
        header, start = _page(handle, pos, end)
        if header[1] == DICTIONARY_PAGE:
            handle.seek(start)
            body, n, size = handle.read(header[3]), header[7][1], header[2]
        elif header[1] in (DATA_PAGE, DATA_PAGE_V2):
            encoding = header[5][2] if header[1] == DATA_PAGE else header[8][4]
            if encoding not in BY_DICTIONARY:
                return None
        pos = start + header[3]
    if body is None:
        return None
    if chunk.compression != "UNCOMPRESSED":
        body = pa.Codec(chunk.compression.lower()).decompress(body, size, asbytes=True)
    if chunk.physical_type in WIDTHS:
        values = pa.array(np.frombuffer(body, WIDTHS[chunk.physical_type], n))
        return values if pa.types.is_floating(kind) else values.cast(pa.int32() if pa.types.is_date32(kind) else values.type).cast(kind)
    out, i = [], 0
    for _ in range(n):
        size = int.from_bytes(body[i : i + 4], "little")
        out.append(body[i + 4 : i + 4 + size])
        i += 4 + size
    return pa.array(out, pa.binary()).cast(pa.string()) if pa.types.is_string(kind) or pa.types.is_large_string(kind) else None


def scanned(uri: str, group: int, columns: list[str]):
    """Batches of some columns of a row group; a column that the file lacks is null."""
    file, _ = opened(uri)
    have = [c for c in columns if c in file.schema_arrow.names]
    rows = file.metadata.row_group(group).num_rows
    if not have:
        yield pa.table({c: pa.nulls(rows) for c in columns})
        return
    for batch in file.iter_batches(SCAN_ROWS, row_groups=[group], columns=have):
        yield pa.table({c: batch[c] if c in have else pa.nulls(batch.num_rows) for c in columns})


def typed(values: pa.Array) -> tuple[str, pa.Array]:
    """Whole numbers and booleans as 'whole' (int64), floats and decimals as 'real' (double), the rest as 'text', ordered as their own type is."""
    kind = values.type
    if pa.types.is_dictionary(kind):
        return typed(values.cast(kind.value_type))
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        return "whole", values.cast(pa.int64())
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        real = values.cast(pa.float64())
        return "real", pc.add(real, pa.scalar(0.0))  # one zero
    if pa.types.is_timestamp(kind):
        values = values.cast(pa.timestamp("us", kind.tz))
    return "text", values.cast(pa.string())
