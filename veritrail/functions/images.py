"""Kernels on the bytes of images, for tables that hold raw pictures.

Everything else works on the columns these give, so they are needed only where pictures have not
been measured yet. Portable grey and colour maps are decoded here; other forms need OpenCV.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import cv2
except ImportError:
    cv2 = None

_METRICS = "width int, height int, channels int, mean_gray double, std_gray double, laplacian_variance double, underexposed_ratio double, overexposed_ratio double, phash bigint, readable boolean"
#: Grey levels up to which, and from which, a pixel counts as dark or bright.
DARK, BRIGHT = 20, 235


def decode(content: bytes | None) -> np.ndarray | None:
    """Pixels as height, width, channels; None if they cannot be read."""
    if not content:
        return None
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            if end > at:
                fields.append(content[at:end])
            if end >= len(content):
                return None
            at = end + 1
        try:
            width, height, most = map(int, fields)
        except ValueError:
            return None
        channels = 1 if content[:2] == b"P5" else 3
        pixels = np.frombuffer(content[at:], dtype=np.uint8)
        return pixels[: width * height * channels].reshape(height, width, channels) if most < 256 and len(pixels) >= width * height * channels > 0 else None
    if cv2 is None:
        return None
    found = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)
    return None if found is None else found[:, :, ::-1]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey levels by the usual weights of red, green and blue."""
    return pixels[:, :, 0].astype(float) if pixels.shape[2] == 1 else pixels.astype(float) @ np.array([0.299, 0.587, 0.114])


def shrink(levels: np.ndarray, size: int) -> np.ndarray:
    """Means over a grid of ``size`` by ``size`` areas."""
    rows = np.linspace(0, levels.shape[0], size + 1)
    columns = np.linspace(0, levels.shape[1], size + 1)
    whole = np.pad(levels.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    y, x = np.minimum(rows.astype(int), levels.shape[0]), np.minimum(columns.astype(int), levels.shape[1])
    y1, x1 = np.maximum(y[1:], y[:-1] + 1).clip(max=levels.shape[0]), np.maximum(x[1:], x[:-1] + 1).clip(max=levels.shape[1])
    y0, x0 = np.minimum(y[:-1], y1 - 1), np.minimum(x[:-1], x1 - 1)
    total = whole[np.ix_(y1, x1)] - whole[np.ix_(y0, x1)] - whole[np.ix_(y1, x0)] + whole[np.ix_(y0, x0)]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def perceptual_hash(levels: np.ndarray) -> int:
    """63 bits: which of the lowest cosine coefficients but the constant exceed their median."""
    size = 32
    n = np.arange(size)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / (2 * size))
    low = (basis @ shrink(levels, size) @ basis.T)[:8, :8].ravel()[1:]
    return int("".join("1" if v > np.median(low) else "0" for v in low), 2)


def measure(content: bytes | None) -> tuple:
    """The measurements of one image, in the order of the columns."""
    pixels = decode(content)
    if pixels is None:
        return (None,) * 9 + (False,)
    levels = grey(pixels)
    inner = -4 * levels[1:-1, 1:-1] + levels[:-2, 1:-1] + levels[2:, 1:-1] + levels[1:-1, :-2] + levels[1:-1, 2:] if min(levels.shape) > 2 else np.zeros((1, 1))
    height, width, channels = pixels.shape
    return (width, height, channels, levels.mean(), levels.std(), inner.var(), (levels <= DARK).mean(), (levels >= BRIGHT).mean(), perceptual_hash(levels), True)


def image_metrics(content: Column) -> Column:
    """Size, grey levels, sharpness, exposure and perceptual hash of an image; nulls if it is unreadable."""

    @F.pandas_udf(_METRICS)
    def measured(contents: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([measure(c) for c in contents], columns=[c.split()[0] for c in _METRICS.split(", ")])
        return rows.astype({"width": "Int32", "height": "Int32", "channels": "Int32", "phash": "Int64", "readable": bool})

    return measured(content)
