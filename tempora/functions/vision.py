"""Numpy kernels over decoded pictures, and their Arrow UDFs. Decoding itself is a plug-in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.sequences import MotionConfig

# Fixed values of the motion gates.
DIFF_LEVEL, SLOW_FRAMES, LEAST_REGION, GATE_REGION = 25, 4, 0.001, 0.003


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell of a picture of one or more channels."""
    x = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        size = x.shape[axis]
        edge = np.linspace(0, size, n + 1)
        total = np.concatenate((np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)), axis)
        low = np.floor(edge).astype(int)
        part = edge - low
        at = total.take(low, axis)
        more = x.take(np.minimum(low, size - 1), axis)
        shape = [1] * x.ndim
        shape[axis] = -1
        at = at + more * part.reshape(shape)
        x = np.diff(at, axis=axis) / (size / n)
    return x


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR picture."""
    return image.astype(float) if image.ndim == 2 else image @ np.array([0.114, 0.587, 0.299])


def downsample(image: np.ndarray, scale: float, least: int = 8) -> np.ndarray:
    h, w = image.shape[:2]
    return area_resize(gray(image), max(least, int(h * scale)), max(least, int(w * scale)))


def _window(mask: np.ndarray, op) -> np.ndarray:
    padded = np.pad(mask, 1, constant_values=op is np.logical_and)
    h, w = mask.shape
    out = padded[1:-1, 1:-1]
    for dy in range(3):
        for dx in range(3):
            out = op(out, padded[dy : dy + h, dx : dx + w])
    return out


def opened(mask: np.ndarray) -> np.ndarray:
    """Erosion and dilation by 3 x 3, then one more dilation."""
    return _window(_window(_window(mask, np.logical_and), np.logical_or), np.logical_or)


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of 8-connected regions: labels spread by the least neighbour until they settle."""
    big = mask.size
    label = np.where(mask, np.arange(big).reshape(mask.shape), big)
    while True:
        padded = np.pad(label, 1, constant_values=big)
        low = label
        for dy in range(3):
            for dx in range(3):
                low = np.minimum(low, padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]])
        low = np.where(mask, low, big)
        flat = np.append(low.ravel(), big)
        low = np.where(mask, flat[low], big)  # jump to the label's own label
        if (low == label).all():
            break
        label = low
    out = []
    for x in np.unique(label[mask]):
        ys, xs = np.nonzero(label == x)
        out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, len(xs)))
    return out


def motion_mask(now: np.ndarray, before: np.ndarray, earlier: np.ndarray | None = None) -> np.ndarray:
    mask = np.abs(now - before) > DIFF_LEVEL
    return mask if earlier is None else mask | (np.abs(now - earlier) > DIFF_LEVEL)


def boxes_of(mask: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], float, bool]:
    """(boxes, share of the picture they cover, whether the largest passes the gate)."""
    kept = [r for r in regions(opened(mask)) if r[4] >= LEAST_REGION * mask.size]
    return kept, sum(r[4] for r in kept) / mask.size, bool(kept) and max(r[4] for r in kept) >= GATE_REGION * mask.size


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: the low 8 x 8 of a 32 x 32 cosine transform against the mean of its rows but the first."""
    x = area_resize(gray(image), 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.where(k == 0, np.sqrt(1 / 32), 0.25)[:, None]
    low = (basis @ x @ basis.T)[:8, :8]
    value = 0
    for bit in (low > low[1:].mean()).ravel():
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >> 63 else value


def color_histogram(image: np.ndarray) -> np.ndarray:
    """8 x 8 x 8 histogram over hue, saturation and value, as shares."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(high > low, high - low, 1)
    hue = np.select([high == r, high == g], [(g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
    hue = np.where(high > low, hue, 0)
    sat = np.where(high > 0, (high - low) / np.where(high > 0, high, 1), 0)
    cells = [np.minimum((8 * c).astype(int), 7) for c in (hue, sat, high / 256)]
    return np.bincount((cells[0] * 64 + cells[1] * 8 + cells[2]).ravel(), minlength=512) / high.size


def pixel_percent(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(area_resize(a, 64, 64) - area_resize(b, 64, 64)).mean() / 255 * 100)


def embed_input(image: np.ndarray, mean: list[float], std: list[float], side: int = 224) -> np.ndarray:
    """Short side to ``side``, centre crop, normalised, channels first (RGB)."""
    h, w = image.shape[:2]
    k = side / min(h, w)
    x = area_resize(image, max(side, round(h * k)), max(side, round(w * k)))
    top, left = (x.shape[0] - side) // 2, (x.shape[1] - side) // 2
    x = x[top : top + side, left : left + side, ::-1] / 255
    return ((x - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def features(frames: DataFrame) -> DataFrame:
    """(video_id, seq, t, phash, hist) of frames (…, image, h, w: BGR bytes): batches of pictures, no state."""

    def run(batches):
        for pdf in batches:
            pics = [np.frombuffer(i, np.uint8).reshape(h, w, 3) for i, h, w in zip(pdf["image"], pdf["h"], pdf["w"], strict=True)]
            yield pd.DataFrame({
                "video_id": pdf["video_id"], "seq": pdf["seq"], "t": pdf["t"], "phash": [perceptual_hash(p) for p in pics], "hist": [color_histogram(p).tolist() for p in pics],
            })

    return frames.select("video_id", "seq", "t", "image", "h", "w").mapInPandas(run, "video_id long, seq long, t double, phash long, hist array<double>")


def motion_frames(frames: DataFrame, scale: float = 0.25) -> DataFrame:
    """(video_id, seq, t, boxes, gated, ratio) against the frame before and the one SLOW_FRAMES back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        for r in pdf.sort_values(["t", "seq"]).itertuples(index=False):
            now = downsample(np.frombuffer(r.image, np.uint8).reshape(r.h, r.w, 3), scale)
            if held:
                kept, ratio, gated = boxes_of(motion_mask(now, held[-1], held[0] if len(held) == SLOW_FRAMES else None))
                out.append((r.video_id, r.seq, r.t, len(kept), gated, ratio))
            held = [*held, now][-SLOW_FRAMES:]
        return pd.DataFrame(out, columns=["video_id", "seq", "t", "boxes", "gated", "ratio"])

    return frames.groupBy("video_id").applyInPandas(run, "video_id long, seq long, t double, boxes int, gated boolean, ratio double")


def thumbnails(frames: DataFrame) -> DataFrame:
    """64 x 64 thumbnails as arrays, for pixel distances in columns."""

    @F.pandas_udf("array<double>")
    def small(image: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([area_resize(np.frombuffer(i, np.uint8).reshape(a, b, 3), 64, 64).ravel().tolist() for i, a, b in zip(image, h, w, strict=True)])

    return frames.withColumn("thumb", small("image", "h", "w"))


__all__ = ["MotionConfig", "accepts", "area_resize", "boxes_of", "color_histogram", "features", "motion_frames", "perceptual_hash", "pixel_percent", "thumbnails"]


def accepts(score: float, phash_dist: int, hist_corr: float, config: MotionConfig) -> bool:
    """Whether a change is a scene change by level and by kind."""
    return score > config.change_threshold and (phash_dist > config.phash_distance or hist_corr < config.hist_correlation)
