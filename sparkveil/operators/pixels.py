"""Pixel operators over frames held as bytes: Arrow UDFs around numpy, whole frames at a time.

A frame is (height, width, pixels) with three bytes a pixel; only rows that get covered need
their pixels. Geometry (boxes, kernels, orientation) stays in column expressions.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _box_mean(x: np.ndarray, k: int, axis: int) -> np.ndarray:
    pad = [(0, 0)] * x.ndim
    pad[axis] = (k // 2 + 1, k // 2)
    total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
    total = np.moveaxis(total, axis, 0)
    return np.moveaxis((total[k:] - total[:-k]) / k, 0, axis)


#: Longest side up to which the three means of a side are one matrix.
SMALL = 256


@lru_cache(maxsize=64)
def _means(n: int, k: int) -> np.ndarray:
    """Three box means over n places, as weights."""
    x = np.eye(n)
    for _ in range(3):
        x = _box_mean(x, k, 0)
    return np.ascontiguousarray(x)


def blur(frame: np.ndarray, kernel: int) -> np.ndarray:
    """Three box means, close to a Gaussian of the same width."""
    x, k = frame.astype(np.float64), max(1, kernel // 2) | 1
    h, w = x.shape[:2]
    if 0 < h <= SMALL and 0 < w <= SMALL:
        x = np.matmul(_means(w, k), (_means(h, k) @ x.reshape(h, -1)).reshape(x.shape))
        return np.rint(np.clip(x, 0, 255)).astype(np.uint8)
    for _ in range(3):
        x = _box_mean(_box_mean(x, k, 0), k, 1)
    return np.rint(np.clip(x, 0, 255)).astype(np.uint8)


def pixelate(frame: np.ndarray, block: int) -> np.ndarray:
    """Mean colour of each block, at least two pixels wide."""
    block = max(2, block)
    h, w = frame.shape[:2]
    ys, xs = np.arange(0, h, block), np.arange(0, w, block)
    total = np.add.reduceat(np.add.reduceat(frame.astype(np.float64), ys, 0), xs, 1)
    size = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None, :]
    mean = np.rint(total / size[..., None]).astype(np.uint8)
    return mean.repeat(block, 0)[:h].repeat(block, 1)[:, :w]


def avatar(frame: np.ndarray, x1: int, y1: int, x2: int, y2: int, key: str) -> None:
    """A head and shoulders in colours that the key picks, drawn into the frame over a flat ground."""
    shade = np.frombuffer(hashlib.sha256(key.encode()).digest()[:6], np.uint8).astype(int) % 40
    h, w = y2 - y1, x2 - x1
    y, x = np.mgrid[0:h, 0:w] + 0.5
    part = np.full((h, w, 3), 235, np.uint8)
    part[((x - w / 2) / (0.46 * w)) ** 2 + ((y - 1.15 * h) / (0.45 * h)) ** 2 <= 1] = shade[:3] + 80
    part[((x - w / 2) / (0.3 * w)) ** 2 + ((y - 0.42 * h) / (0.36 * h)) ** 2 <= 1] = shade[3:] + 170
    frame[y1:y2, x1:x2] = part


def surround(frame: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """Mean colour of the ring of pixels around a box; grey if the box is the whole picture."""
    h, w = frame.shape[:2]
    a, b, c, d = max(0, x1 - 1), max(0, y1 - 1), min(w, x2 + 1), min(h, y2 + 1)
    ring = np.ones((d - b, c - a), bool)
    ring[y1 - b : y2 - b, x1 - a : x2 - a] = False
    return np.rint(frame[b:d, a:c][ring].mean(axis=0)).astype(np.uint8) if ring.any() else np.full(3, 128, np.uint8)


def replace(frame: np.ndarray, boxes, actions, key: str = "") -> np.ndarray:
    """Boxes replaced by their action: avatar, patch (a plain label; its text is drawn by whatever
    encodes the frame) or fill with the colour around the box."""
    out = frame.copy()
    h, w = frame.shape[:2]
    for i, (b, action) in enumerate(zip(boxes, actions, strict=True)):
        x1, y1, x2, y2 = max(0, b["x1"]), max(0, b["y1"]), min(w, b["x2"]), min(h, b["y2"])
        if x2 <= x1 or y2 <= y1:
            continue
        if action == "avatar":
            avatar(out, x1, y1, x2, y2, f"{key}:{i}")
        else:
            out[y1:y2, x1:x2] = 245 if action == "patch" else surround(frame, x1, y1, x2, y2)
    return out


def contact_sheet(frames: list[np.ndarray], columns: int = 3, width: int = 320) -> np.ndarray:
    """Thumbnails of one width in rows of three; the nearest pixel stands for each."""
    if not frames:
        return np.zeros((0, 0, 3), np.uint8)
    h, w = frames[0].shape[:2]
    height = max(1, round(h * width / w))
    sheet = np.zeros((-(-len(frames) // columns) * height, columns * width, 3), np.uint8)
    for i, f in enumerate(frames):
        small = f[np.arange(height) * f.shape[0] // height][:, np.arange(width) * f.shape[1] // width]
        y, x = i // columns * height, i % columns * width
        sheet[y : y + height, x : x + width] = small
    return sheet


def cover(frame: np.ndarray, boxes, mode: str, strength: int) -> np.ndarray:
    """The frame with its boxes blurred, pixelated, filled (black) or replaced by the colour around
    them; nothing outside the boxes changes."""
    if not len(boxes):
        return frame
    if mode == "replace":
        return replace(frame, boxes, ["fill"] * len(boxes))
    changed = np.zeros_like(frame) if mode == "fill" else pixelate(frame, strength) if mode == "pixelate" else blur(frame, strength)
    out = frame.copy()
    for b in boxes:
        out[b["y1"] : b["y2"], b["x1"] : b["x2"]] = changed[b["y1"] : b["y2"], b["x1"] : b["x2"]]
    return out


def cover_frames(frames: DataFrame, mode: str, strength: int) -> DataFrame:
    """(height, width, pixels, boxes) -> pixels covered inside the boxes. Boxes in a column
    ``secure`` are filled first, so that blurring them gives no pattern to read."""

    @F.pandas_udf("binary")
    def run(height: pd.Series, width: pd.Series, pixels: pd.Series, boxes: pd.Series, secure: pd.Series) -> pd.Series:
        out = []
        for h, w, p, b, s in zip(height, width, pixels, boxes, secure, strict=True):
            frame = cover(np.frombuffer(p, np.uint8).reshape(h, w, 3), s if s is not None else [], "fill", strength)
            out.append(cover(frame, b, mode, strength).tobytes())
        return pd.Series(out)

    secure = F.col("secure") if "secure" in frames.columns else F.slice("boxes", 1, 0)
    return frames.withColumn("pixels", run("height", "width", "pixels", "boxes", secure))


def sharpness(gray: np.ndarray) -> float:
    """Mean absolute Laplacian: how much fine detail a region holds."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.float64)
    return float(np.abs(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).mean())


def _detail(height: pd.Series, width: pd.Series, gray: pd.Series) -> pd.Series:
    return pd.Series([sharpness(np.frombuffer(p, np.uint8).reshape(h, w)) for h, w, p in zip(height, width, gray, strict=True)])


def detail(height: Column, width: Column, gray: Column) -> Column:
    return F.pandas_udf(_detail, "double")(height, width, gray)


def leakage(before: Column, after: Column) -> Column:
    """Share of the detail that is left; 0 where there was none."""
    return F.when(before <= 0, F.lit(0.0)).otherwise(F.round(after / before, 4))


def orient_box(box: Column, orientation: Column, width: Column, height: Column) -> Column:
    """A box of the stored picture (width by height) in the upright one, for orientations 1 to 8."""
    x1, y1, x2, y2 = (box[n] for n in ("x1", "y1", "x2", "y2"))
    of = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    w, h = width, height
    cases = {2: of(w - x2, y1, w - x1, y2), 3: of(w - x2, h - y2, w - x1, h - y1), 4: of(x1, h - y2, x2, h - y1), 5: of(y1, x1, y2, x2), 6: of(h - y2, x1, h - y1, x2), 7: of(h - y2, w - x2, h - y1, w - x1), 8: of(y1, w - x2, y2, w - x1)}
    out = None
    for k, v in cases.items():
        out = F.when(orientation == k, v) if out is None else out.when(orientation == k, v)
    return out.otherwise(of(x1, y1, x2, y2))
