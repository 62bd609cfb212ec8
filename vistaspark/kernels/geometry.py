"""Per-pair kernels: matching, homography, motion of the corners, structural agreement, small-motion alignment."""

from __future__ import annotations

import numpy as np

from vistaspark.kernels.image import dilate, filter2, gaussian, resize, sobel

INF = float("inf")


def match(a: np.ndarray | None, b: np.ndarray | None, ratio: float, rows: int = 1024) -> np.ndarray:
    """(k, 2) of positions: nearest neighbours of a in b that beat the second by ``ratio``; none if a side has under 4."""
    if a is None or b is None or len(a) < 4 or len(b) < 4:
        return np.zeros((0, 2), int)
    out = []
    bb = (b * b).sum(1)
    for lo in range(0, len(a), rows):
        part = a[lo : lo + rows]
        d = np.maximum((part * part).sum(1)[:, None] + bb - 2 * part @ b.T, 0)
        two = np.argpartition(d, 1, axis=1)[:, :2]
        first, second = np.take_along_axis(d, two, 1).T
        good = np.sqrt(first) <= ratio * np.sqrt(second)
        out.append(np.stack([np.flatnonzero(good) + lo, two[good, 0]], 1))
    return np.concatenate(out)


def project(h: np.ndarray, xy: np.ndarray) -> np.ndarray:
    p = np.concatenate([xy, np.ones((len(xy), 1))], 1) @ h.T
    w = np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])
    return p[:, :2] / w


def _scaling(xy: np.ndarray) -> np.ndarray:
    c = xy.mean(0)
    s = np.sqrt(2) / max(1e-9, np.linalg.norm(xy - c, axis=1).mean())
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform on scaled points."""
    ta, tb = _scaling(src), _scaling(dst)
    a, b = project(ta, src), project(tb, dst)
    one, zero = np.ones(len(a)), np.zeros(len(a))
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    try:
        h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    except np.linalg.LinAlgError:
        return None
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def four_point_homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """(k, 3, 3) from (k, 4, 2) points and their images, scaled to unit norm; not finite where three of four lie on a line.

    Both quadruples are images of the projective frame e1, e2, e3, e1 + e2 + e3:
    three points times the determinants that make them sum to the fourth.  The
    one frame's matrix times the other's adjugate is the homography, so no system
    is solved and no sample can stop the others.
    """
    def frame(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.concatenate([p, np.ones((*p.shape[:2], 1))], 2)
        a, b, c, d = p.transpose(1, 0, 2)
        det = lambda x, y, z: (np.cross(x, y) * z).sum(1)
        factors = np.stack([det(d, b, c), det(a, d, c), det(a, b, d)], 1)
        return p[:, :3].transpose(0, 2, 1) * factors[:, None, :], (np.abs(factors).min(1) > 1e-9) & (np.abs(det(a, b, c)) > 1e-9)

    (m, one), (n, other) = frame(src), frame(dst)
    a, b, c = m.transpose(2, 0, 1)
    adjugate = np.stack([np.cross(b, c), np.cross(c, a), np.cross(a, b)], 1)
    h = n @ adjugate
    norm = np.linalg.norm(h, axis=(1, 2), keepdims=True)
    return np.where((one & other)[:, None, None] & (norm > 0), h / np.where(norm > 0, norm, 1), np.nan)


def four_of(rng: np.random.Generator, n: int, k: int) -> np.ndarray:
    """(k, 4) of distinct places below n, every choice as likely."""
    out = rng.integers(0, [n, n - 1, n - 2, n - 3], (k, 4))
    for c in range(1, 4):
        for taken in np.sort(out[:, :c], axis=1).T:
            out[:, c] += out[:, c] >= taken
    return out


def most_agreed(src: np.ndarray, dst: np.ndarray, seed: int, threshold: float, most: int, batch: int = 64) -> np.ndarray:
    """Inliers of the best four-point sample, the first of equals; samples are solved and judged a batch at a time.

    Sampling ends after as many tries as find a clean sample of the best share
    of inliers with 99.5 % certainty, counted try by try, so the batch's size
    does not matter.
    """
    n = len(src)
    rng = np.random.default_rng(seed)
    ta, tb = _scaling(src), _scaling(dst)
    a, b = project(ta, src), project(tb, dst)
    ones = np.concatenate([a, np.ones((n, 1))], 1).T
    reach = (threshold * tb[0, 0]) ** 2
    best, found, need, tries = np.zeros(n, bool), 0, most, 0
    while tries < min(need, most):
        some = four_of(rng, n, batch)
        at = four_point_homographies(a[some], b[some]) @ ones
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (at[:, :2] / at[:, 2:] - b.T) ** 2
        hit = off.sum(1) <= reach
        for mask, agreed in zip(hit, hit.sum(1)):
            if tries >= min(need, most):
                break
            tries += 1
            if agreed > found:
                best, found = mask, int(agreed)
                good = (found / n) ** 4
                need = 1 if good >= 1 else np.log(0.005) / np.log(1 - max(good, 1e-12))
    return best


def estimate_homography(src: np.ndarray, dst: np.ndarray, seed: int, threshold: float = 5.0, most: int = 2000) -> tuple[np.ndarray | None, np.ndarray, float]:
    """Homography, inlier mask and median inlier error by random samples; inf without inliers.  Seeded by the pair."""
    n = len(src)
    if n < 4:
        return None, np.zeros(0, bool), INF
    src, dst = src.astype(np.float64), dst.astype(np.float64)
    best = most_agreed(src, dst, seed, threshold, most)
    if best.sum() < 4:
        return None, np.zeros(n, bool), INF
    h = None
    for _ in range(3):
        h = fit_homography(src[best], dst[best])
        if h is None:
            return None, np.zeros(n, bool), INF
        hit = np.linalg.norm(project(h, src) - dst, axis=1) <= threshold
        if hit.sum() < 4 or (hit == best).all():
            break
        best = hit
    error = np.linalg.norm(project(h, src[best]) - dst[best], axis=1)
    return h, best, float(np.median(error))


def _corners(w: float, h: float) -> np.ndarray:
    return np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)


def corner_shift(a: dict, b: dict, h: np.ndarray) -> tuple[float, float, float, float]:
    """Mean and largest motion of the corners: as a share of the diagonal, and in the originals' pixels."""
    def moved(h: np.ndarray, wa: float, ha: float, wb: float, hb: float) -> np.ndarray:
        c = _corners(wa, ha)
        return np.linalg.norm(project(h, c) - c * [wb / max(1.0, wa), hb / max(1.0, ha)], axis=1)

    small = moved(h, a["width"], a["height"], b["width"], b["height"])
    diagonal = max(np.hypot(a["width"], a["height"]), np.hypot(b["width"], b["height"]), 1.0)
    sa = np.diag([a["width"] / max(1.0, a["original_width"]), a["height"] / max(1.0, a["original_height"]), 1.0])
    sb = np.diag([b["original_width"] / max(1e-8, b["width"]), b["original_height"] / max(1e-8, b["height"]), 1.0])
    large = moved(sb @ h @ sa, a["original_width"], a["original_height"], b["original_width"], b["original_height"])
    return float(small.mean() / diagonal), float(small.max() / diagonal), float(large.mean()), float(large.max())


def warp(image: np.ndarray, h: np.ndarray, height: int, width: int, nearest: bool) -> np.ndarray:
    """The image moved by h, zeros outside."""
    try:
        back = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return np.zeros((height, width), image.dtype)
    yy, xx = np.mgrid[:height, :width]
    at = project(back, np.stack([xx.ravel(), yy.ravel()], 1).astype(float))
    if nearest:
        x, y = np.rint(np.clip(at, -2, 1 << 20)).astype(int).T
        ok = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
        out = np.zeros(height * width, image.dtype)
        out[ok] = image[y[ok], x[ok]]
        return out.reshape(height, width)
    p = np.pad(image.astype(np.float32), 1)
    x, y = np.clip(at[:, 0] + 1, 0, p.shape[1] - 1.001), np.clip(at[:, 1] + 1, 0, p.shape[0] - 1.001)
    x0, y0 = x.astype(int), y.astype(int)
    fx, fy = x - x0, y - y0
    out = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    return out.astype(np.float32).reshape(height, width)


def edge_overlap(one: np.ndarray, other: np.ndarray) -> float:
    """Dice coefficient of two edge images, each thickened by a pixel; 0 if neither has an edge."""
    thick = [dilate((x > 0).astype(np.uint8), 3).astype(bool) for x in (one, other)]
    marked = sum(map(np.count_nonzero, thick))
    return 2.0 * np.count_nonzero(np.logical_and(*thick)) / marked if marked else 0.0


def gradient_correlation(one: np.ndarray, other: np.ndarray, least: int = 50) -> float:
    """Pearson correlation, 0 at least, over pixels where either is positive; 0 with fewer than ``least`` of them or no variation."""
    either = np.stack([one, other])[:, (one > 0) | (other > 0)].astype(np.float64)
    if either.shape[1] < least:
        return 0.0
    either -= either.mean(axis=1, keepdims=True)
    lengths = np.sqrt((either * either).sum(axis=1)).prod()
    return float(np.clip((either[0] * either[1]).sum() / lengths, 0.0, 1.0)) if lengths > 1e-8 else 0.0


def structural_alignment(a: dict, b: dict, h: np.ndarray) -> tuple[float, float]:
    """(edge score, gradient score) of a moved onto b; the first is 65 % overlap and 35 % correlation."""
    onto = lambda kind, nearest: warp(a[kind], h, b["height"], b["width"], nearest)
    gradient = gradient_correlation(onto("gradient", False), b["gradient"])
    return 0.65 * edge_overlap(onto("edges", True), b["edges"]) + 0.35 * gradient, gradient


def small_motion(a: dict, b: dict, iterations: int = 80, eps: float = 1e-5) -> tuple[np.ndarray | None, str]:
    """Rotation and shift that maximise the correlation of the gradient images, as a homography from a to b."""
    source, target = a["gradient"].astype(np.float32), b["gradient"].astype(np.float32)
    scale = np.diag([b["width"] / a["width"], b["height"] / a["height"], 1.0])
    if source.shape != target.shape:
        source = resize(source, b["height"], b["width"])
    k = gaussian(1.1, 2)
    source, target = filter2(source, k, k), filter2(target, k, k)
    gx, gy = (g / 8 for g in sobel(source))
    height, width = target.shape
    yy, xx = np.mgrid[:height, :width].astype(np.float64)
    angle, tx, ty, last = 0.0, 0.0, 0.0, -1.0
    for _ in range(iterations):
        c, s = np.cos(angle), np.sin(angle)
        # From the target's pixels to the source's.
        back = np.array([[c, -s, tx], [s, c, ty], [0, 0, 1]])
        try:
            to = np.linalg.inv(back)
        except np.linalg.LinAlgError:
            return None, "ecc_failed:singular"
        w, wx, wy = (warp(x, to, height, width, False) for x in (source, gx, gy))
        inside = warp(np.ones_like(source), to, height, width, True) > 0
        if inside.sum() < 16:
            return None, "ecc_failed:outside"
        t, i = target[inside].astype(np.float64), w[inside].astype(np.float64)
        t, i = t - t.mean(), i - i.mean()
        nt, ni = np.linalg.norm(t), np.linalg.norm(i)
        if nt < 1e-8 or ni < 1e-8:
            return None, "ecc_failed:flat"
        rho = float(t @ i / (nt * ni))
        if rho - last < eps and last > -1:
            break
        last = rho
        x, y, dx, dy = xx[inside], yy[inside], wx[inside].astype(np.float64), wy[inside].astype(np.float64)
        j = np.stack([dx * (-s * x - c * y) + dy * (c * x - s * y), dx, dy], 1)
        hess = j.T @ j
        try:
            inv = np.linalg.inv(hess)
        except np.linalg.LinAlgError:
            return None, "ecc_failed:hessian"
        ji, jt = j.T @ i, j.T @ t
        num, den = ni**2 - ji @ inv @ ji, t @ i - jt @ inv @ ji
        if den <= 0:
            return None, "ecc_failed:diverged"
        step = inv @ (j.T @ (num / den * t - i))
        angle, tx, ty = angle + step[0], tx + step[1], ty + step[2]
    c, s = np.cos(angle), np.sin(angle)
    return np.linalg.inv(np.array([[c, -s, tx], [s, c, ty], [0, 0, 1]])) @ scale, "ecc_euclidean"
