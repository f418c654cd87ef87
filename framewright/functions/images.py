"""Image measures: each image is decoded once and all measures come from its one grey matrix.

Pixels have no built-in functions, so this is the one place with vectorised Python on a main path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK, BLUR, EDGE_LOW, EDGE_HIGH = 15.0, 100.0, 100.0, 200.0
MEASURES = "mean_luma double, lap_var double, edge_density double, phash bigint"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """The grey matrix of an ``image`` struct's bytes (blue, green, red); None if it could not be decoded."""
    if height <= 0 or width <= 0 or data is None:
        return None
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0].astype(np.float64)
    b, g, r = (px[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)


def _around(m: np.ndarray) -> np.ndarray:
    """The matrix with a border that mirrors what lies inside the edge; a single row or column repeats itself."""
    return np.pad(m, [(1, 1) if n > 1 else (0, 0) for n in m.shape], "reflect") if min(m.shape) > 1 else np.pad(m, 1, "edge")


def laplacian_variance(m: np.ndarray) -> float:
    p = _around(m)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * m).var())


def edges(m: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Edge pixels: gradients, thinned across the edge, kept if strong or linked to a strong one."""
    p = np.pad(m, 1, "edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    s = np.pad(size, 1)
    c = s[1:-1, 1:-1]
    flat, steep = np.abs(gy) < 0.41421356 * np.abs(gx), np.abs(gy) > 2.41421356 * np.abs(gx)
    same = (gx * gy) >= 0
    pairs = [(s[1:-1, :-2], s[1:-1, 2:]), (s[:-2, 1:-1], s[2:, 1:-1]), (s[:-2, :-2], s[2:, 2:]), (s[:-2, 2:], s[2:, :-2])]
    top = np.select([flat, steep, same], [(c > a) & (c >= b) for a, b in pairs[:3]], (c > pairs[3][0]) & (c > pairs[3][1]))
    weak, strong = top & (size > low), top & (size > high)
    while True:  # strong edges grow along weak ones until nothing is added
        g = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for i in range(3):
            for j in range(3):
                near |= g[i : i + m.shape[0], j : j + m.shape[1]]
        new = weak & near
        if (new | strong).sum() == strong.sum():
            return strong
        strong |= new


def _areas(n: int, size: int) -> np.ndarray:
    """How much of each of ``n`` cells over ``size`` pixels every pixel makes up."""
    e = np.linspace(0, size, n + 1)
    lo, hi = np.arange(size), np.arange(1, size + 1)
    return np.clip(np.minimum(e[1:, None], hi) - np.maximum(e[:-1, None], lo), 0, None) * n / size


def shrunk(m: np.ndarray, n: int) -> np.ndarray:
    """The matrix at n by n: each cell is the mean of the area it covers."""
    return _areas(n, m.shape[0]) @ m @ _areas(n, m.shape[1]).T


@cache
def _basis(size: int) -> np.ndarray:
    """The lowest 8 cosines over ``size`` pixels that are stretched to 32; a row for each pixel."""
    weights = _areas(32, size).T if size < 32 else np.eye(32)
    return np.array([[sum(math.cos(math.pi * (2 * i + 1) * u / 64) * w[i] for i in range(32)) for u in range(8)] for w in weights.tolist()])


def perceptual_hash(m: np.ndarray) -> int:
    """64 bits: which of the lowest 8 by 8 cosine frequencies of the image, at 32 by 32, lie above their median.

    Frequencies that are equal in theory differ in their last digits, and these say which lie above the median.  So the
    order is fixed: each is summed over the pixels as they are read, value by vertical by horizontal cosine, as SQL does.
    """
    if max(m.shape) > 32:
        m = shrunk(m, 32)
    terms = m[:, :, None, None] * _basis(m.shape[0])[:, None, :, None] * _basis(m.shape[1])[None, :, None, :]
    low = np.add.accumulate(terms.reshape(-1, 64))[-1]
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def measured(m: np.ndarray | None) -> tuple[float | None, float | None, float, int | None]:
    if m is None or not m.size:
        return None, None, 0.0, None
    return float(m.mean()), laplacian_variance(m), float(edges(m).mean()), perceptual_hash(m)


def _measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, height, width, channels in batches:
        rows = [measured(grey(*x)) for x in zip(data, height, width, channels)]
        yield pd.DataFrame(rows, columns=["mean_luma", "lap_var", "edge_density", "phash"]).astype({"phash": "Int64", "mean_luma": "float64", "lap_var": "float64", "edge_density": "float64"})


def image_measures(image: str = "image") -> Column:
    """struct(mean_luma, lap_var, edge_density, phash) of an ``image`` struct; nulls where it could not be decoded."""
    return F.pandas_udf(_measure, MEASURES)(F.col(f"{image}.data"), F.col(f"{image}.height"), F.col(f"{image}.width"), F.col(f"{image}.nChannels"))


def is_black(mean_luma: Column, threshold: float = BLACK) -> Column:
    """Darker than the threshold; an image that can't be read counts as black."""
    return F.coalesce(mean_luma < threshold, F.lit(True))


def is_blurry(lap_var: Column, threshold: float = BLUR) -> Column:
    """Less varied than the threshold; an image that can't be read counts as blurry."""
    return F.coalesce(lap_var < threshold, F.lit(True))


def is_slide_like(ocr_text: Column, edge_density: Column, length: int = 80, density: float = 0.08) -> Column:
    """Much recognised text, or many edges; either will do."""
    from .scalars import stripped

    return (F.length(stripped(F.coalesce(ocr_text, F.lit("")))) >= length) | (F.coalesce(edge_density, F.lit(0.0)) >= density)
