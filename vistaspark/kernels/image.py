"""Per-image kernels: resizing, tone normalisation, masks, gradients, edges and the coarse descriptor."""

from __future__ import annotations

import numpy as np


def _area_weights(n: int, m: int) -> np.ndarray:
    """(m, n) matrix that averages n cells into m by overlap (n >= m), or interpolates linearly (n < m)."""
    out = np.zeros((m, n))
    if m > n:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        np.add.at(out, (np.arange(m), lo), 1 - (at - lo))
        np.add.at(out, (np.arange(m), hi), at - lo)
        return out
    edges = np.arange(m + 1) * n / m
    for k in range(m):
        a, b = edges[k], edges[k + 1]
        cells = np.arange(int(np.floor(a)), min(n, int(np.ceil(b))))
        out[k, cells] = np.minimum(cells + 1, b) - np.maximum(cells, a)
    return out / out.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average; whole numbers are rounded back to their type."""
    rows, cols = _area_weights(image.shape[0], height), _area_weights(image.shape[1], width)
    x = image.astype(np.float64)
    out = np.einsum("ah,hwc->awc", rows, x) if x.ndim == 3 else rows @ x
    out = np.einsum("bw,awc->abc", cols, out) if x.ndim == 3 else out @ cols.T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)


def resize_max_side(image: np.ndarray, most: int) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    scale = most / max(h, w)
    return resize(image, max(1, round(h * scale)), max(1, round(w * scale)))


def to_gray(bgr: np.ndarray) -> np.ndarray:
    if bgr.ndim == 2:
        return bgr
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    return np.rint(bgr[:, :, :3].astype(np.float64) @ [0.114, 0.587, 0.299]).astype(np.uint8)


def gamma_lut(gamma: float) -> np.ndarray:
    return np.array([((v / 255.0) ** gamma) * 255.0 for v in range(256)]).astype(np.uint8)


def equalize(gray: np.ndarray) -> np.ndarray:
    counts = np.bincount(gray.ravel(), minlength=256)
    first = np.flatnonzero(counts)[0]
    rest = gray.size - counts[first]
    if rest == 0:
        return np.full_like(gray, first)
    lut = np.clip(np.rint((np.cumsum(counts) - counts[first]) * (255.0 / rest)), 0, 255)
    return lut.astype(np.uint8)[gray]


def clahe(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast limited adaptive histogram equalisation over tiles, bilinear between their mappings."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    pad = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    cells = pad.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, area)
    counts = np.stack([np.bincount(c, minlength=256) for c in cells])
    over = np.maximum(counts - limit, 0).sum(axis=1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None]
    for k, left in enumerate(over % 256):
        if left:
            counts[k, np.arange(0, 256, max(1, 256 // left))[:left]] += 1
    luts = np.clip(np.rint(np.cumsum(counts, axis=1) * (255.0 / area)), 0, 255).reshape(tiles, tiles, 256)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    pick = lambda a, b: luts[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], gray]
    out = (pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx) * (1 - fy) + (pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def normalize_variants(gray: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Five tone variants, so that brackets of one view come to look alike."""
    log = np.log1p(gray.astype(np.float32))
    spread = float(log.max() - log.min())
    log = ((log - log.min()) * (255.0 / spread) if spread > 0 else np.zeros_like(log)).astype(np.uint8)
    return [
        ("clahe", clahe(gray)), ("equalized", equalize(gray)), ("bright_clahe", clahe(gamma_lut(0.55)[gray])),
        ("dark_clahe", clahe(gamma_lut(1.8)[gray])), ("log_clahe", clahe(log)),
    ]


def _window(image: np.ndarray, size: int, pick, fill) -> np.ndarray:
    r = size // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(image, pad, constant_values=fill)
        n = image.shape[axis]
        parts = [np.take(p, np.arange(k, k + n), axis=axis) for k in range(size)]
        image = pick.reduce(parts)
    return image


def dilate(image: np.ndarray, size: int) -> np.ndarray:
    return _window(image, size, np.maximum, 0)


def erode(image: np.ndarray, size: int) -> np.ndarray:
    return _window(image, size, np.minimum, 255)


def feature_mask(gray: np.ndarray) -> tuple[np.ndarray, float]:
    """Where pixels are neither black nor blown out, and the share of those that are."""
    valid = ((gray > 8) & (gray < 247)).astype(np.uint8) * 255
    clipped = 1.0 - np.count_nonzero(valid) / valid.size
    valid = dilate(dilate(erode(valid, 5), 5), 5)
    if np.count_nonzero(valid) < valid.size * 0.05:
        valid[:] = 255
    return valid, clipped


def filter2(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Separable correlation, mirrored at the borders without repeating the border pixel."""
    out = image.astype(np.float32)
    for axis, kernel in ((0, rows), (1, cols)):
        r, n = len(kernel) // 2, out.shape[axis]
        at = np.arange(-r, n + r)
        period = max(1, 2 * (n - 1))
        at = np.abs(at) % period
        at = np.where(at >= n, period - at, at)
        p = np.take(out, at, axis=axis)
        out = sum(np.float32(k) * np.take(p, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return out


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = np.array([-1, 0, 1]), np.array([1, 2, 1])
    return filter2(gray, s, d), filter2(gray, d, s)


def gradient_image(gray: np.ndarray) -> np.ndarray:
    gx, gy = sobel(gray)
    m = np.hypot(gx, gy)
    spread = float(m.max() - m.min())
    return ((m - m.min()) / spread if spread > 1e-12 else np.zeros_like(m)).astype(np.float32)


def canny(gray: np.ndarray, lower: int, upper: int) -> np.ndarray:
    gx, gy = sobel(gray)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    h, w = m.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * 0.41421356, ay > ax * 2.41421356
    down = (gx * gy) >= 0
    keep = np.where(
        flat, (m > at(0, -1)) & (m >= at(0, 1)),
        np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(down, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))))
    weak = keep & (m > lower)
    out = keep & (m > upper)
    while True:
        grown = (dilate(out.astype(np.uint8), 3) > 0) & weak
        if (grown == out).all():
            return out.astype(np.uint8) * 255
        out = grown


def edge_image(gray: np.ndarray) -> np.ndarray:
    median = float(np.median(gray))
    lower, upper = int(max(20, 0.66 * median)), int(min(240, 1.33 * median + 30))
    if upper <= lower:
        lower, upper = 50, 150
    edges = canny(gray, lower, upper)
    return canny(gray, 30, 100) if np.count_nonzero(edges) < edges.size * 0.005 else edges


def gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    r = max(1, int(np.ceil(4 * sigma))) if radius is None else radius
    x = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return x / x.sum()


def coarse_descriptor(normalized: np.ndarray, edges: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """1408 numbers of mean 0 and length 1, so that a dot product is a correlation."""
    blur = gaussian(1.1, 2)
    soft = filter2((edges > 0).astype(np.float32), blur, blur)
    v = np.concatenate([
        resize(gradient.astype(np.float32), 24, 24).ravel(), resize(soft, 24, 24).ravel(), resize(normalized, 16, 16).astype(np.float32).ravel() / 255.0])
    v = v - v.mean()
    norm = float(np.linalg.norm(v))
    return (v / norm if norm > 1e-8 else v).astype(np.float32)


def compact_features(bgr: np.ndarray, max_size: int) -> dict:
    """What the plan for large sets needs: resized size and coarse descriptor."""
    gray = equalize(resize_max_side(to_gray(bgr), max_size))
    return {"width": gray.shape[1], "height": gray.shape[0], "descriptor": coarse_descriptor(gray, edge_image(gray), gradient_image(gray))}
