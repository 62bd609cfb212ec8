"""Scale-space keypoints with gradient histograms (Lowe 2004), and their square-root normalisation (Arandjelovic & Zisserman 2012)."""

from __future__ import annotations

import numpy as np

from vistaspark.kernels.image import filter2, gaussian, resize

LAYERS, SIGMA = 3, 1.6


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian(sigma)
    return filter2(image, k, k)


def _pyramid(gray: np.ndarray) -> list[list[np.ndarray]]:
    base = resize(gray.astype(np.float32), gray.shape[0] * 2, gray.shape[1] * 2)
    base = _blur(base, np.sqrt(max(SIGMA**2 - 1.0, 0.01)))
    octaves = []
    while min(base.shape) >= 16:
        images = [base]
        for k in range(1, LAYERS + 3):
            before = SIGMA * 2 ** ((k - 1) / LAYERS)
            images.append(_blur(images[-1], before * np.sqrt(2 ** (2 / LAYERS) - 1)))
        octaves.append(images)
        base = images[LAYERS][::2, ::2]
    return octaves


def _extrema(dog: np.ndarray, contrast: float) -> np.ndarray:
    """(layer, y, x) of local extremes away from borders and edges."""
    mid = dog[1:-1, 1:-1, 1:-1]
    high = np.abs(mid) > 0.5 * contrast / LAYERS * 255
    top, bottom = high & (mid > 0), high & (mid < 0)
    s, h, w = mid.shape
    for a in range(3):
        for b in range(3):
            for c in range(3):
                if (a, b, c) != (1, 1, 1):
                    other = dog[a : a + s, b : b + h, c : c + w]
                    top &= mid >= other
                    bottom &= mid <= other
    at = np.argwhere(top | bottom) + 1
    border = 5
    return at[(at[:, 1] >= border) & (at[:, 2] >= border) & (at[:, 1] < dog.shape[1] - border) & (at[:, 2] < dog.shape[2] - border)]


def _refine(dog: np.ndarray, at: np.ndarray, contrast: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One quadratic step: offsets and contrast; drops flat and edge-like points."""
    if not at.size:
        return at, np.zeros((0, 3)), np.zeros(0)
    l, y, x = at.T
    v = lambda a, b, c: dog[l + a, y + b, x + c]
    g = np.stack([(v(1, 0, 0) - v(-1, 0, 0)) / 2, (v(0, 1, 0) - v(0, -1, 0)) / 2, (v(0, 0, 1) - v(0, 0, -1)) / 2], 1)
    c = v(0, 0, 0)
    h = np.empty((len(at), 3, 3))
    h[:, 0, 0], h[:, 1, 1], h[:, 2, 2] = v(1, 0, 0) + v(-1, 0, 0) - 2 * c, v(0, 1, 0) + v(0, -1, 0) - 2 * c, v(0, 0, 1) + v(0, 0, -1) - 2 * c
    h[:, 0, 1] = h[:, 1, 0] = (v(1, 1, 0) - v(1, -1, 0) - v(-1, 1, 0) + v(-1, -1, 0)) / 4
    h[:, 0, 2] = h[:, 2, 0] = (v(1, 0, 1) - v(1, 0, -1) - v(-1, 0, 1) + v(-1, 0, -1)) / 4
    h[:, 1, 2] = h[:, 2, 1] = (v(0, 1, 1) - v(0, 1, -1) - v(0, -1, 1) + v(0, -1, -1)) / 4
    step = -np.einsum("nij,nj->ni", np.linalg.pinv(h), g)
    value = c + 0.5 * (g * step).sum(1)
    trace, det = h[:, 1, 1] + h[:, 2, 2], h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2
    ok = (np.abs(step) < 1.0).all(1) & (np.abs(value) * LAYERS >= contrast * 255) & (det > 0) & (trace**2 * 10 < 121 * det)
    return at[ok], step[ok], np.abs(value[ok])


def _gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = np.zeros_like(image), np.zeros_like(image)
    dx[:, 1:-1], dy[1:-1] = image[:, 2:] - image[:, :-2], image[2:] - image[:-2]
    return np.hypot(dx, dy), np.arctan2(dy, dx)


def _orientations(mag: np.ndarray, ang: np.ndarray, y: np.ndarray, x: np.ndarray, scale: np.ndarray) -> list[tuple[int, float]]:
    """(point, angle): peaks of the smoothed gradient histogram around each point."""
    out = []
    h, w = mag.shape
    for k in range(len(y)):
        r = int(round(4.5 * scale[k]))
        y0, x0 = int(round(y[k])), int(round(x[k]))
        ys, xs = slice(max(0, y0 - r), min(h, y0 + r + 1)), slice(max(0, x0 - r), min(w, x0 + r + 1))
        yy, xx = np.ogrid[ys, xs]
        weight = np.exp(-((yy - y0) ** 2 + (xx - x0) ** 2) / (2 * (1.5 * scale[k]) ** 2)) * mag[ys, xs]
        bins = np.rint(ang[ys, xs] * (36 / (2 * np.pi))).astype(int) % 36
        hist = np.bincount(bins.ravel(), weight.ravel(), 36)
        hist = (np.roll(hist, 2) + np.roll(hist, -2) + 4 * (np.roll(hist, 1) + np.roll(hist, -1)) + 6 * hist) / 16
        a, b = np.roll(hist, 1), np.roll(hist, -1)
        for p in np.flatnonzero((hist > a) & (hist > b) & (hist >= 0.8 * hist.max())):
            shift = 0.5 * (a[p] - b[p]) / (a[p] - 2 * hist[p] + b[p])
            out.append((k, (p + shift) % 36 * (2 * np.pi / 36)))
    return out


def _describe(mag: np.ndarray, ang: np.ndarray, y: np.ndarray, x: np.ndarray, scale: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """128 numbers a point: 4 x 4 cells of 8 directions over a rotated, scaled 16 x 16 grid."""
    n = len(y)
    grid = (np.arange(16) - 7.5) / 4
    u, v = np.meshgrid(grid, grid)
    u, v = u.ravel()[None], v.ravel()[None]
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    width = 3 * scale[:, None]
    px, py = np.rint(x[:, None] + (c * u - s * v) * width).astype(int), np.rint(y[:, None] + (s * u + c * v) * width).astype(int)
    inside = (px >= 0) & (py >= 0) & (px < mag.shape[1]) & (py < mag.shape[0])
    px, py = np.clip(px, 0, mag.shape[1] - 1), np.clip(py, 0, mag.shape[0] - 1)
    weight = mag[py, px] * inside * np.exp(-(u**2 + v**2) / 8)
    bin_o = ((ang[py, px] - angle[:, None]) % (2 * np.pi)) * (8 / (2 * np.pi))
    out = np.zeros((n, 6, 6, 8))
    bx, by = np.broadcast_to(u + 2.5, bin_o.shape), np.broadcast_to(v + 2.5, bin_o.shape)
    x0, y0, o0 = np.floor(bx).astype(int), np.floor(by).astype(int), np.floor(bin_o).astype(int)
    row = np.broadcast_to(np.arange(n)[:, None], bin_o.shape)
    for dx in (0, 1):
        for dy in (0, 1):
            for do in (0, 1):
                part = weight * np.abs(1 - dx - (bx - x0)) * np.abs(1 - dy - (by - y0)) * np.abs(1 - do - (bin_o - o0))
                np.add.at(out, (row, np.clip(y0 + dy, 0, 5), np.clip(x0 + dx, 0, 5), (o0 + do) % 8), part)
    d = out[:, 1:5, 1:5].reshape(n, 128)
    norm = np.linalg.norm(d, axis=1, keepdims=True)
    d = np.minimum(d, 0.2 * norm)
    return (d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12) * 512).clip(0, 255).astype(np.float32)


def detect(gray: np.ndarray, most: int, mask: np.ndarray | None = None, contrast: float = 0.025) -> tuple[np.ndarray, np.ndarray]:
    """(points x, y in the image's pixels; 128-number descriptors), the ``most`` strongest."""
    xy, desc, strength = [], [], []
    for o, images in enumerate(_pyramid(gray)):
        stack = np.stack(images)
        dog = stack[1:] - stack[:-1]
        at, step, value = _refine(dog, _extrema(dog, contrast), contrast)
        step_scale = 2.0**o / 2
        if mask is not None and len(at):
            cx = np.clip(np.rint(at[:, 2] * step_scale).astype(int), 0, mask.shape[1] - 1)
            cy = np.clip(np.rint(at[:, 1] * step_scale).astype(int), 0, mask.shape[0] - 1)
            ok = mask[cy, cx] > 0
            at, step, value = at[ok], step[ok], value[ok]
        best = np.argsort(-value, kind="stable")[:most]
        at, step, value = at[best], step[best], value[best]
        for layer in np.unique(at[:, 0]) if len(at) else ():
            some = np.flatnonzero(at[:, 0] == layer)
            mag, ang = _gradients(images[layer])
            y, x = at[some, 1] + step[some, 1], at[some, 2] + step[some, 2]
            scale = SIGMA * 2 ** ((layer + step[some, 0]) / LAYERS)
            turned = _orientations(mag, ang, y, x, scale)
            if not turned:
                continue
            k = np.array([p for p, _ in turned])
            desc.append(_describe(mag, ang, y[k], x[k], scale[k], np.array([a for _, a in turned])))
            xy.append(np.stack([x[k], y[k]], 1) * step_scale)
            strength.append(value[some][k])
    if not xy:
        return np.zeros((0, 2), np.float32), np.zeros((0, 128), np.float32)
    order = np.argsort(-np.concatenate(strength), kind="stable")[:most]
    return np.concatenate(xy)[order].astype(np.float32), np.concatenate(desc)[order]


def root_normalize(desc: np.ndarray | None) -> np.ndarray | None:
    if desc is None or not len(desc):
        return None
    d = np.sqrt(desc / (desc.sum(axis=1, keepdims=True) + 1e-7))
    return (d / (np.linalg.norm(d, axis=1, keepdims=True) + 1e-7)).astype(np.float32)
