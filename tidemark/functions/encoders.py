"""Encoders of image patches as a plug-in: a matrix of patches in, a matrix of vectors out, a batch at a time.

A patch is an array of its bands' pixels, one band after another; what is null or NaN is invalid. An encoder
is a class with ``width(bands)`` and ``encode_batch(patches)``, patches of the shape (n, bands, pixels).
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    def width(self, bands: int) -> int: ...

    def encode_batch(self, patches: np.ndarray) -> np.ndarray: ...


class BandMoments:
    """Mean and deviation of each band's valid pixels: a stand-in that needs no weights."""

    def width(self, bands: int) -> int:
        return 2 * bands

    def encode_batch(self, patches: np.ndarray) -> np.ndarray:
        valid = ~np.isnan(patches)
        n = valid.sum(2)
        n = np.where(n > 0, n, np.nan)  # a band without a valid pixel has neither
        mean = np.where(valid, patches, 0).sum(2) / n
        off = np.where(valid, patches - mean[:, :, None], 0)
        return np.hstack([mean, np.sqrt((off * off).sum(2) / n)])


ENCODERS: dict[str, type] = {"dummy": BandMoments}


def encode(patch: str | Column, bands: int, encoder: str = "dummy") -> Column:
    """array<double> of each patch by a registered encoder, made once a worker; null for a null patch or one of no whole bands."""
    made: dict[str, Encoder] = {}

    @F.pandas_udf("array<double>")
    def run(patches: pd.Series) -> pd.Series:
        model = made.setdefault(encoder, ENCODERS[encoder]())
        out = pd.Series([None] * len(patches), dtype=object)
        sizes = patches.map(lambda p: -1 if p is None else len(p))
        for size in sizes[(sizes > 0) & (sizes % bands == 0)].unique():
            at = np.nonzero((sizes == size).to_numpy())[0]
            x = np.stack([np.asarray(patches.iloc[i], "float64") for i in at]).reshape(len(at), bands, -1)
            for i, v in zip(at, model.encode_batch(x)):
                out.iloc[i] = [None if np.isnan(w) else float(w) for w in v]
        return out

    return run(patch)
