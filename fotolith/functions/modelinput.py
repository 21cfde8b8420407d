"""What models are given, as numpy arrays: a detector's square, an aligned face, a smaller picture; and what they answer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fotolith.functions.imaging import clip_input, letterbox, similarity_transform, unit, warp

FACE, FACE_DIMENSIONS, SENT_EDGE = 112, 128, 768


def detector_input(rgb: np.ndarray, side: int = 640) -> tuple[np.ndarray, float, float, float]:
    """(planes, scale, left, top): blue, green and red planes of the picture fitted into a square, nearest pixel, black
    around it."""
    h, w = rgb.shape[:2]
    scale, left, top = letterbox(w, h, side)
    x, y = (np.floor((np.arange(side) - shift) / scale + 0.5).astype(int) for shift in (left, top))
    inside = ((y >= 0) & (y < h))[:, None] & ((x >= 0) & (x < w))[None, :]
    fitted = rgb[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)]
    return np.where(inside[..., None], fitted, 0)[..., ::-1].transpose(2, 0, 1).astype(np.float32), scale, left, top


def outputs(found: dict[str, np.ndarray], name: str) -> np.ndarray:
    """One output of a model, flat."""
    if name not in found:
        raise ValueError(f"the model has no output {name}")
    return np.asarray(found[name], np.float32).ravel()


def embed_aligned(aligned: np.ndarray, model: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A face's vector from its aligned picture: red, green and blue planes, values as they are."""
    if aligned.shape != (FACE, FACE, 3):
        raise ValueError(f"an aligned face has {FACE} x {FACE} pixels of three channels")
    v = np.asarray(model(aligned.transpose(2, 0, 1).astype(np.float32)[None]), np.float32).ravel()
    if len(v) != FACE_DIMENSIONS:
        raise ValueError(f"{len(v)} numbers instead of {FACE_DIMENSIONS}")
    return v


def embed_face(rgb: np.ndarray, landmarks: np.ndarray, model: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A face's vector from its picture and five landmarks."""
    return embed_aligned(warp(rgb, similarity_transform(np.asarray(landmarks, np.float64).reshape(5, 2)), FACE), model)


def embed_picture(rgb: np.ndarray, model: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """A picture's vector, of length one."""
    return unit(np.asarray(model(clip_input(rgb, mean, std)[None]), np.float32).ravel())


def _weights(n: int, to: int, lobes: int = 3) -> np.ndarray:
    """The share of each of n pixels in each of ``to`` pixels, by a windowed sinc that widens when shrinking."""
    wide = max(n / to, 1.0)
    x = (np.arange(n)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * n / to) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def sent_picture(rgb: np.ndarray, edge: int = SENT_EDGE) -> np.ndarray:
    """The picture at the size an endpoint is sent: its long edge is ``edge``, its metadata gone. An encoder is the caller's."""
    h, w = rgb.shape[:2]
    scale = edge / max(w, h)
    nw, nh = max(round(w * scale), 1), max(round(h * scale), 1)
    out = np.einsum("yh,hwc->ywc", _weights(h, nh), rgb.astype(np.float64), optimize=True)
    out = np.einsum("xw,ywc->yxc", _weights(w, nw), out, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
