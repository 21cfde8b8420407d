"""Image measurements in numpy, and the Arrow UDF that applies them to a column of rasters.

A raster is (width, height, luma values by row). Regions are (x, y, w, h). All measures leave out one pixel at the
border of the picture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

Region = tuple[int, int, int, int]
# Gains of white noise through the two kernels, working size, least variance of a textured region, bins.
LAPLACE_GAIN, SOBEL_GAIN = 20.0, 4.3403
LONG_EDGE, LEAST_VARIANCE = 1024, 1.0
BINS, CLIP_TOLERANCE = 1024, 0.004
_EPS = np.finfo(np.float64).eps


def luma(rgb: np.ndarray) -> np.ndarray:
    """BT.709 luma of an (h, w, 3) picture; (h, w) pictures are luma already."""
    return rgb.astype(np.float32) if rgb.ndim == 2 else (rgb.astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])).astype(np.float32)


def box_downscale(img: np.ndarray, factor: int) -> np.ndarray:
    h, w = max(1, img.shape[0] // factor), max(1, img.shape[1] // factor)
    out = np.zeros((h * factor, w * factor), np.float64)
    part = img[: h * factor, : w * factor]
    out[: part.shape[0], : part.shape[1]] = part
    return (out.reshape(h, factor, w, factor).sum((1, 3)) / factor**2).astype(np.float32)


def working_copy(img: np.ndarray, target: int = LONG_EDGE) -> np.ndarray:
    factor = math.ceil(max(img.shape) / target)
    return box_downscale(img, factor) if factor >= 2 else img


def resize_area(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Means over the source pixels of each target pixel."""
    sums = np.zeros((img.shape[0] + 1, img.shape[1] + 1))
    sums[1:, 1:] = img.astype(np.float64).cumsum(0).cumsum(1)

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(n) * size // n
        return a, np.minimum(np.maximum((np.arange(n) + 1) * size // n, a + 1), size)

    (y0, y1), (x0, x1) = edges(h, img.shape[0]), edges(w, img.shape[1])
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return (total / np.outer(y1 - y0, x1 - x0)).astype(np.float32)


def difference_hash(img: np.ndarray) -> int:
    """64 bits, row by row: whether a pixel of the 9 x 8 picture is darker than its right neighbour; as a signed long."""
    small = resize_area(img, 9, 8)
    bits = np.packbits(small[:, :-1] < small[:, 1:], axis=None, bitorder="little")
    return int(bits.view("<i8")[0])


def _inner(img: np.ndarray, r: Region) -> tuple[int, int, int, int] | None:
    """The region without border pixels as (y0, y1, x0, x1), or None."""
    x0, y0 = max(r[0], 1), max(r[1], 1)
    x1, y1 = min(r[0] + r[2], img.shape[1] - 1), min(r[1] + r[3], img.shape[0] - 1)
    return (y0, y1, x0, x1) if x1 > x0 and y1 > y0 else None


def _around(img: np.ndarray, r: Region, least: int = 3) -> list[list[np.ndarray]] | None:
    """The nine shifted views of the region."""
    at = _inner(img, r)
    if at is None or at[1] - at[0] < least or at[3] - at[2] < least:
        return None
    y0, y1, x0, x1 = at
    d = img.astype(np.float64)
    return [[d[y0 + dy : y1 + dy, x0 + dx : x1 + dx] for dx in (-1, 0, 1)] for dy in (-1, 0, 1)]


def full(img: np.ndarray) -> Region:
    return 0, 0, img.shape[1], img.shape[0]


def laplacian_variance(img: np.ndarray, r: Region) -> float:
    v = _around(img, r)
    if v is None:
        return 0.0
    return float((v[0][1] + v[2][1] + v[1][0] + v[1][2] - 4 * v[1][1]).var())


def _sobel(img: np.ndarray, r: Region) -> tuple[np.ndarray, np.ndarray] | None:
    v = _around(img, r)
    if v is None:
        return None
    gx = (v[0][2] + 2 * v[1][2] + v[2][2]) - (v[0][0] + 2 * v[1][0] + v[2][0])
    gy = (v[2][0] + 2 * v[2][1] + v[2][2]) - (v[0][0] + 2 * v[0][1] + v[0][2])
    return gx, gy


def gradient_mean(img: np.ndarray, r: Region) -> float:
    g = _sobel(img, r)
    return 0.0 if g is None else float(np.hypot(*g).mean())


def contrast(img: np.ndarray, r: Region, sigma: float) -> float:
    """The mean gradient beyond that of noise."""
    return max(gradient_mean(img, r) - SOBEL_GAIN * sigma, 0.0)


def directional_energy(img: np.ndarray, r: Region) -> tuple[float, float]:
    g = _sobel(img, r)
    return (0.0, 0.0) if g is None else (float((g[0] ** 2).sum()), float((g[1] ** 2).sum()))


def luma_variance(img: np.ndarray, r: Region) -> float:
    at = _inner(img, r)
    return 0.0 if at is None else float(img[at[0] : at[1], at[2] : at[3]].astype(np.float64).var())


def noise_sigma(img: np.ndarray, r: Region) -> float:
    v = _around(img, r)
    if v is None:
        return 0.0
    m = v[0][0] + v[0][2] + v[2][0] + v[2][2] - 2 * (v[0][1] + v[1][0] + v[1][2] + v[2][1]) + 4 * v[1][1]
    return float(math.sqrt(math.pi / 2) * np.abs(m).mean() / 6)


def tile_variation(img: np.ndarray, r: Region, tiles: int = 4) -> float:
    at = _inner(img, r)
    if at is None or tiles < 2 or at[3] - at[2] < 3 * tiles or at[1] - at[0] < 3 * tiles:
        return 0.0
    w, h = (at[3] - at[2]) // tiles, (at[1] - at[0]) // tiles
    v = np.array([laplacian_variance(img, (at[2] + i * w, at[0] + j * h, w, h)) for j in range(tiles) for i in range(tiles)])
    return 0.0 if v.mean() <= _EPS else float(v.std() / v.mean())


def salient_region(img: np.ndarray, nx: int = 16, ny: int = 12, share: float = 0.25) -> Region | None:
    """The box around tiles of much detail, a tile wider; None if that is about everything or nothing."""
    size = np.array([img.shape[1] // nx, img.shape[0] // ny])
    if size.min() < 3:
        return None
    w, h = size.tolist()
    detail = np.array([laplacian_variance(img, (x * w, y * h, w, h)) for y in range(ny) for x in range(nx)]).reshape(ny, nx)
    strong = (detail >= detail.max() * share) & (detail > 0)
    if not strong.any() or strong.sum() * 10 >= strong.size * 9:
        return None
    tiles = np.argwhere(strong)[:, ::-1]
    low = np.maximum(tiles.min(0) - 1, 0) * size
    box = np.maximum(np.minimum((tiles.max(0) + 2) * size, [img.shape[1], img.shape[0]]) - low, 1)
    return None if box.prod() * 10 >= img.size * 9 else (*low.tolist(), *box.tolist())


def choose_region(img: np.ndarray, faces: list[Region] | None = None) -> tuple[Region, str]:
    h, w = img.shape
    if faces:
        x0, y0 = min(f[0] for f in faces), min(f[1] for f in faces)
        x1, y1 = max(f[0] + f[2] for f in faces), max(f[1] + f[3] for f in faces)
        mx, my = (x1 - x0) * 3 // 10, (y1 - y0) * 3 // 10
        rx, ry = max(x0 - mx, 0), max(y0 - my, 0)
        return (rx, ry, max(min(x1 + mx, w) - rx, 1), max(min(y1 + my, h) - ry, 1)), "faces"
    if (r := salient_region(img)) is not None:
        return r, "saliency"
    cw, ch = max(int(w * 0.6), 1), max(int(h * 0.6), 1)
    return ((w - cw) // 2, (h - ch) // 2, cw, ch), "centre"


#: What ``focus`` gives.
SHARPNESS = ("focus", "signal_variance", "anisotropy", "noise_sigma")


def _sharpness(pic: np.ndarray, r: Region, sigma: float, fine: float) -> tuple[float, ...]:
    """The measures of a region at one scale; what noise alone would give is taken off, and a signal no stronger than the
    picture's ``fine`` noise counts for little."""
    signal = max(laplacian_variance(pic, r) - LAPLACE_GAIN * sigma**2, 0.0)
    spread = max(luma_variance(pic, r) - sigma**2, 0.0)
    weak, strong = sorted(directional_energy(pic, r))
    sure = signal / (signal + max(LAPLACE_GAIN * fine**2, 1e-9))
    return signal / spread * sure if spread > LEAST_VARIANCE else 0.0, signal, max(strong / weak, 1.0) if weak > _EPS else 1.0, sigma


def focus(img: np.ndarray, faces: list[Region] | None = None) -> dict[str, float]:
    """Sharpness of the subject at the better of two scales."""
    work = working_copy(img)
    roi, _ = choose_region(work, faces)
    fine = noise_sigma(work, full(work))
    half = box_downscale(work, 2)
    scales = [(work, roi, fine), (half, (roi[0] // 2, roi[1] // 2, max(roi[2] // 2, 3), max(roi[3] // 2, 3)), noise_sigma(half, full(half)))]
    found = [_sharpness(pic, r, sigma, fine) for pic, r, sigma in scales if min(r[2:]) >= 3]
    return dict(zip(SHARPNESS, max(found, key=lambda x: x[0], default=(0.0, 0.0, 1.0, fine)), strict=True))


def exposure(img: np.ndarray, r: Region, black: float = 0.0, white: float = 255.0) -> dict[str, float]:
    """Level, clipping and range of a region, from a histogram."""
    zero = dict.fromkeys(("clipped_high", "clipped_low", "mean", "p01", "p50", "p99", "range"), 0.0)
    at = _inner(img, r)
    if at is None or white <= black:
        return zero
    v = np.clip((img[at[0] : at[1], at[2] : at[3]].astype(np.float64) - black) / (white - black), 0, 1).ravel()
    hist = np.bincount(np.minimum(np.floor(v * (BINS - 1) + 0.5).astype(int), BINS - 1), minlength=BINS)
    acc = hist.cumsum()
    edge = math.ceil(CLIP_TOLERANCE * (BINS - 1))

    def at_share(p: float) -> float:
        target = max(math.floor(p * len(v) + 0.5), 1)
        i = int(np.searchsorted(acc, target))
        return min((i + (target - (acc[i] - hist[i])) / hist[i]) / (BINS - 1), 1.0)

    p01, p50, p99 = map(at_share, (0.01, 0.5, 0.99))
    return {"clipped_high": hist[-edge:].sum() / len(v), "clipped_low": hist[:edge].sum() / len(v), "mean": float(v.mean()), "p01": p01, "p50": p50, "p99": p99, "range": max(p99 - p01, 0.0)}


def measure(img: np.ndarray, faces: list[Region] | None = None) -> tuple[float, ...]:
    """The eight metrics of a picture and its hash."""
    f = focus(img, faces)
    e = exposure(img, full(img))
    return f["focus"], f["signal_variance"], f["anisotropy"], e["mean"], e["range"], e["clipped_high"], e["clipped_low"], f["noise_sigma"], difference_hash(img)


@F.pandas_udf(StructType([*(StructField(f"m{i}", DoubleType()) for i in range(8)), StructField("hash", LongType())]))
def measured(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """Measures rasters given as bytes of luma; null where the size doesn't fit."""
    rows = []
    for w, h, p in zip(width, height, pixels, strict=True):
        ok = p is not None and w * h == len(p) and w * h > 0
        rows.append(measure(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) if ok else (None,) * 9)
    return pd.DataFrame(rows, columns=[*(f"m{i}" for i in range(8)), "hash"])


# Where eyes, nose and mouth corners lie in an aligned face of 112 x 112.
FACE_TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def similarity_transform(points: np.ndarray, target: np.ndarray = FACE_TEMPLATE) -> np.ndarray:
    """The 2 x 3 rotation, scale and shift that maps points onto a target best (least squares)."""
    a, b = points - points.mean(0), target - target.mean(0)
    spread = (a**2).sum()
    if spread <= 1e-12:
        raise ValueError("points coincide")
    c = (a * b).sum() / spread
    s = (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / spread
    m = np.array([[c, -s], [s, c]])
    return np.hstack([m, (target.mean(0) - m @ points.mean(0))[:, None]])


def warp(img: np.ndarray, m: np.ndarray, size: int = 112) -> np.ndarray:
    """The picture under a transform, bilinear, black outside."""
    inverse = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    y, x = np.mgrid[0:size, 0:size]
    sx, sy = (inverse[i, 0] * x + inverse[i, 1] * y + inverse[i, 2] for i in (0, 1))
    padded = np.pad(img.astype(np.float64), [(1, 2), (1, 2)] + [(0, 0)] * (img.ndim - 2))
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    tx, ty = sx - fx, sy - fy
    if img.ndim == 3:
        tx, ty = tx[..., None], ty[..., None]
    ix, iy = np.clip(fx + 1, 0, img.shape[1] + 1), np.clip(fy + 1, 0, img.shape[0] + 1)
    top = padded[iy, ix] * (1 - tx) + padded[iy, ix + 1] * tx
    low = padded[iy + 1, ix] * (1 - tx) + padded[iy + 1, ix + 1] * tx
    return top * (1 - ty) + low * ty


def letterbox(w: int, h: int, side: int = 640) -> tuple[float, float, float]:
    """(scale, left, top) that fits a picture into a square."""
    scale = min(side / w, side / h)
    return scale, (side - w * scale) / 2, (side - h * scale) / 2


def decode_faces(cls: np.ndarray, obj: np.ndarray, box: np.ndarray, points: np.ndarray, stride: int, columns: int, least: float = 0.6) -> list[dict]:
    """Faces from one stride of an anchor-free detector's outputs: centre offsets and log sizes in strides."""
    score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1)).ravel()
    out = []
    for i in np.flatnonzero(score >= least):
        gx, gy = i % columns, i // columns
        cx, cy = (gx + box[i, 0]) * stride, (gy + box[i, 1]) * stride
        w, h = np.exp(box[i, 2]) * stride, np.exp(box[i, 3]) * stride
        marks = (points[i].reshape(-1, 2) + [gx, gy]) * stride
        out.append({"x": cx - w / 2, "y": cy - h / 2, "w": w, "h": h, "confidence": float(score[i]), "landmarks": marks.ravel().tolist()})
    return out


def clip_input(rgb: np.ndarray, mean: np.ndarray, std: np.ndarray, side: int = 224) -> np.ndarray:
    """Centre square, nearest neighbour to ``side``, normalised by channel."""
    n = min(rgb.shape[:2])
    y, x = (rgb.shape[0] - n) // 2, (rgb.shape[1] - n) // 2
    at = np.minimum(np.arange(side) * n // side, n - 1)
    return ((rgb[y : y + n, x : x + n][np.ix_(at, at)] / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-9 else v
