"""Pixel kernels on NumPy arrays (height, width, channels), for use inside Arrow batches."""

from __future__ import annotations

import numpy as np


def rotate(img: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by 90, 180 or 270 degrees; any other angle leaves the image as it is."""
    return np.rot90(img, -(degrees // 90)) if degrees in (90, 180, 270) else img


def crop(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return img[y : y + h, x : x + w]


def center_crop(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """The middle h by w; a smaller image is first padded with zeros, the odd pixel at the right and bottom."""
    need_h, need_w = max(h - img.shape[0], 0), max(w - img.shape[1], 0)
    if need_h or need_w:
        img = np.pad(img, ((need_h // 2, (need_h + 1) // 2), (need_w // 2, (need_w + 1) // 2), (0, 0)))
    y, x = (img.shape[0] - h) // 2, (img.shape[1] - w) // 2
    return img[y : y + h, x : x + w]


def stack(crops: list[np.ndarray], x_off: list[int], canvas_w: int) -> np.ndarray:
    """The crops below each other on a white canvas."""
    out = np.full((sum(c.shape[0] for c in crops), canvas_w, 3), 255, np.uint8)
    y = 0
    for c, x in zip(crops, x_off):
        out[y : y + c.shape[0], x : x + c.shape[1]] = c
        y += c.shape[0]
    return out


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _catmull_rom(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))


FILTERS = {"triangle": (_triangle, 1.0), "catmull_rom": (_catmull_rom, 2.0)}


def _weights(size: int, out: int, name: str) -> np.ndarray:
    """A row of weights over the input for each output pixel; the filter widens when shrinking."""
    f, support = FILTERS[name]
    ratio = size / out
    scale = max(ratio, 1.0)
    centre = (np.arange(out) + 0.5) * ratio - 0.5
    w = f((np.arange(size)[None, :] - centre[:, None]) / scale)
    w[np.abs(np.arange(size)[None, :] - centre[:, None]) > support * scale] = 0
    return w / w.sum(1, keepdims=True)


def resize(img: np.ndarray, h: int, w: int, name: str = "triangle") -> np.ndarray:
    """Separable convolution resize with rounding to bytes for byte images."""
    if img.shape[:2] == (h, w):
        return img
    out = np.einsum("yh,hwc->ywc", _weights(img.shape[0], h, name), img.astype("float64"))
    out = np.einsum("xw,ywc->yxc", _weights(img.shape[1], w, name), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def normalize(img: np.ndarray, mean, std, scale: float = 1 / 255, bgr: bool = False) -> np.ndarray:
    """Channels first: scaled, less the mean, over the deviation; optionally in reverse channel order."""
    x = (img.astype("float32") * scale - np.asarray(mean, "float32")) / np.asarray(std, "float32")
    return np.ascontiguousarray((x[..., ::-1] if bgr else x).transpose(2, 0, 1))


def to_bytes(planes: np.ndarray) -> np.ndarray:
    """BGR planes of shares to RGB bytes, clamped and truncated."""
    return (np.clip(planes[::-1].transpose(1, 2, 0), 0, 1) * 255).astype(np.uint8)


def upsample(planes: np.ndarray, h: int, w: int, align_corners: bool) -> np.ndarray:
    """Bilinear resize of planes (channels, height, width)."""
    if planes.shape[1:] == (h, w):
        return planes

    def axis(size: int, out: int):
        if align_corners:
            x = np.linspace(0, size - 1, out) if out > 1 else np.zeros(1)
        else:
            x = np.maximum((np.arange(out) + 0.5) * size / out - 0.5, 0)
        lo = np.minimum(x.astype(int), size - 1)
        return lo, np.minimum(lo + 1, size - 1), x - lo

    y0, y1, fy = axis(planes.shape[1], h)
    x0, x1, fx = axis(planes.shape[2], w)
    rows = planes[:, y0] * (1 - fy)[None, :, None] + planes[:, y1] * fy[None, :, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def grid_sample(planes: np.ndarray, flow: np.ndarray, align_corners: bool = True) -> np.ndarray:
    """Bilinear samples of planes at flow (2, h, w: x and y in -1 … 1); beyond the border the border is repeated."""
    _, h, w = planes.shape
    place = lambda v, n: (v + 1) / 2 * (n - 1) if align_corners else ((v + 1) * n - 1) / 2
    x, y = np.clip(place(flow[0], w), 0, w - 1), np.clip(place(flow[1], h), 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    top = planes[:, y0, x0] * (1 - fx) + planes[:, y0, x1] * fx
    low = planes[:, y1, x0] * (1 - fx) + planes[:, y1, x1] * fx
    return top * (1 - fy) + low * fy


def rectify(planes: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """The planes sampled along a coarse flow field."""
    return grid_sample(planes, upsample(flow, *planes.shape[1:], align_corners=True))


def reflect_pad(planes: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.pad(planes, ((0, 0), (h, h), (w, w)), mode="reflect")


def zero_pad(planes: np.ndarray, bottom: int, right: int) -> np.ndarray:
    return np.pad(planes, ((0, 0), (0, bottom), (0, right)))


def max_pool(planes: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Largest value of each window; a partial window at the edge is left out."""
    view = np.lib.stride_tricks.sliding_window_view(planes, (size, size), (1, 2))
    return view[:, ::stride, ::stride].max((3, 4))


def merge_patches(x: np.ndarray, t: int, h: int, w: int, m: int = 2) -> np.ndarray:
    """(t·h·m·w·m, d) patches in raster order to (t·h·w, m·m·d) merged ones; h and w count merged patches."""
    d = x.shape[-1]
    return x.reshape(t, h, m, w, m, d).transpose(0, 1, 3, 2, 4, 5).reshape(t * h * w, m * m * d)


def activation(x: np.ndarray, name: str) -> np.ndarray:
    """relu, silu, gelu, hardswish, hardsigmoid, sigmoid; an unknown name leaves the input as it is."""
    if name == "relu":
        return np.maximum(x, 0)
    if name in ("silu", "swish"):
        return x / (1 + np.exp(-x))
    if name == "gelu":
        return 0.5 * x * (1 + np.vectorize(__import__("math").erf)(x / np.sqrt(2)))
    if name == "hardswish":
        return x * np.clip(x + 3, 0, 6) / 6
    if name == "hardsigmoid":
        return np.clip(x + 3, 0, 6) / 6
    return 1 / (1 + np.exp(-x)) if name == "sigmoid" else x
