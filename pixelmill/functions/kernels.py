"""Vectorised image kernels: NumPy only, one image in, one out.

They run inside Arrow batches for whole-size images; ``operators.arrays`` states the
same operators as column expressions, and tests hold one against the other. Where a
public library defines an operator, its documented definition is followed; agreement
to the last bit with any build of it is not claimed.
"""

from __future__ import annotations

import numpy as np

from pixelmill.operators.arrays import GRADIENTS, bilateral_taps, disc, gaussian_kernel


def index(n: int, radius: int, border: str) -> np.ndarray:
    """Source index of places -radius .. n-1+radius; -1 where the border is zero."""
    p = np.arange(-radius, n + radius)
    if border == "nearest":
        return np.clip(p, 0, n - 1)
    if border == "zero":
        return np.where((p >= 0) & (p < n), p, -1)
    if border == "mirror":
        m = np.mod(p, max(1, 2 * n - 2))
        return np.where(m < n, m, 2 * n - 2 - m)
    m = np.mod(p, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def padded(a: np.ndarray, radius: int, border: str) -> np.ndarray:
    rows, cols = (index(n, radius, border) for n in a.shape[:2])
    out = a[np.maximum(rows, 0)][:, np.maximum(cols, 0)]
    if border == "zero":
        out = out.copy()
        out[rows < 0] = 0
        out[:, cols < 0] = 0
    return out


def shifted(a: np.ndarray, dy: int, dx: int, border: str = "reflect") -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``."""
    r = max(abs(dy), abs(dx))
    h, w = a.shape[:2]
    return padded(a, r, border)[r + dy : r + dy + h, r + dx : r + dx + w]


def correlated(a: np.ndarray, kernel, axis: int, border: str) -> np.ndarray:
    r = len(kernel) // 2
    big = np.moveaxis(a, axis, 0)
    at = index(big.shape[0], r, border)
    big = np.where((at >= 0).reshape(-1, *[1] * (a.ndim - 1)), big[np.maximum(at, 0)], 0.0)
    n = a.shape[axis]
    return np.moveaxis(sum(k * big[i : i + n] for i, k in enumerate(kernel)), 0, axis)


def gaussian(a, sigma, border="reflect"):
    k = gaussian_kernel(sigma)
    return correlated(correlated(a, k, 0, border), k, 1, border)


def unit_range(a):
    return (a - a.min()) / (a.max() - a.min() + 1e-10)


def gray_of(rgb: np.ndarray) -> np.ndarray:
    """8-bit gray, rounded; in whole numbers, so that halves round alike everywhere."""
    return ((rgb.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


# -- colour -----------------------------------------------------------------------

# Linear sRGB to XYZ under D65, and the white point.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """8-bit Lab as unrounded doubles (l * 255 / 100, a + 128, b + 128)."""
    c = rgb.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    x, y, z = np.moveaxis(c @ XYZ.T / WHITE, -1, 0)
    f = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.stack([light * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128], -1)


def lab8_of(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(lab_of(rgb) + 0.5), 0, 255).astype(np.uint8)


def rgb_of_lab8(lab: np.ndarray) -> np.ndarray:
    light, a, b = np.moveaxis(lab.astype(np.float64), -1, 0) * np.array([100 / 255, 1, 1]).reshape(3, *[1] * (lab.ndim - 1)) - np.array([0, 128, 128]).reshape(3, *[1] * (lab.ndim - 1))
    fy = np.where(light > 903.3 * 0.008856, (light + 16) / 116, 7.787 * (light / 903.3) + 16 / 116)
    y = np.where(light > 903.3 * 0.008856, fy**3, light / 903.3)
    back = lambda t: np.where(t > 0.206893, t**3, (t - 16 / 116) / 7.787)
    xyz = np.stack([back(fy + a / 500), y, back(fy - b / 200)], -1) * WHITE
    c = np.clip(xyz @ np.linalg.inv(XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.floor(c * 255 + 0.5), 0, 255).astype(np.uint8)


def lab_stats(rgb):
    """Mean and population deviation of each Lab channel."""
    lab = lab8_of(rgb).reshape(-1, 3).astype(np.float64)
    return lab.mean(axis=0), lab.std(axis=0)


def stain_normalised(rgb, mean, std):
    """Match an image's Lab mean and deviation to a reference; cut off to bytes, not rounded."""
    lab = lab8_of(rgb).astype(np.float64)
    mine, spread = lab_stats(rgb)
    out = (lab - mine) / (spread + 1e-8) * np.asarray(std) + np.asarray(mean)
    return rgb_of_lab8(np.clip(out, 0, 255).astype(np.uint8))


# -- denoising --------------------------------------------------------------------


def bilateral(rgb: np.ndarray, diameter=9, sigma_colour=75.0, sigma_space=75.0) -> np.ndarray:
    """Edge-preserving mean over a disc; colours differ by the sum over channels."""
    v = rgb.astype(np.float64)
    flat = v if v.ndim == 3 else v[..., None]
    r = diameter // 2
    big = padded(flat, r, "mirror")
    h, w = flat.shape[:2]
    total, weight = np.zeros_like(flat), np.zeros((h, w, 1))
    for dy, dx, space in bilateral_taps(diameter, sigma_space):
        other = big[r + dy : r + dy + h, r + dx : r + dx + w]
        k = space * np.exp(-0.5 * (np.abs(other - flat).sum(axis=2, keepdims=True) / sigma_colour) ** 2)
        total += k * other
        weight += k
    out = (total / weight).reshape(v.shape)
    return np.floor(out + 0.5).astype(np.uint8) if rgb.dtype == np.uint8 else out


def hds(noisy: np.ndarray, iterations=200, lam=0.05, dt=0.15, g=1.3, h=1.0, eps=1e-8) -> np.ndarray:
    """Hybrid diffusion of one channel in 0..1; stops at the last finite state."""
    first = noisy.astype(np.float64)
    u = first.copy()
    for _ in range(iterations):
        change = np.zeros_like(u)
        for axis in (0, 1):
            n = u.shape[axis]
            for edge in (np.r_[0, 0 : n - 1], np.r_[1:n, n - 1]):
                d = u - np.take(u, edge, axis) if edge[0] == 0 and (n == 1 or edge[1] == 0) else np.take(u, edge, axis) - u
                change += g * (1 / (1 + d * d / (h * h)) + 1 / (np.abs(d) + eps)) * d
        with np.errstate(all="ignore"):
            new = u + dt * (change - lam * (u / (first + eps) - 1) / (u + eps))
        if not np.isfinite(new).all():
            return np.clip(u, 0, 1)
        u = np.clip(new, 0, 1)
    return u


def denoised(rgb, method: str, params) -> np.ndarray:
    if method == "bilateral":
        return bilateral(rgb, *params.bilateral)
    if method == "hds":
        return np.stack([(hds(rgb[..., c] / 255.0, *params.hds) * 255).astype(np.uint8) for c in range(3)], -1)
    if method == "none":
        return rgb
    raise ValueError(f"unknown denoise method {method!r}")


# -- responses --------------------------------------------------------------------


def hessian_eigenvalues(gray, sigma):
    smooth = gaussian(gray, sigma, "zero")
    grad = lambda a, axis: np.gradient(a, axis=axis) if a.shape[axis] > 1 else np.zeros_like(a)
    gy, gx = grad(smooth, 0), grad(smooth, 1)
    rr, rc, cc = grad(gy, 0), grad(gy, 1), grad(gx, 1)
    mid, half = (rr + cc) / 2, np.sqrt(((rr - cc) / 2) ** 2 + rc * rc)
    return mid + half, mid - half


def apc_response(gray, sigma=2.5, alpha=0.6, lenient=False):
    l1, l2 = (np.abs(x) for x in hessian_eigenvalues(gray, sigma))
    return unit_range(l1 + alpha * l2 if lenient else alpha * l2 + (1 - alpha) * l1)


def laplacian(a):
    return 4 * a - sum(shifted(a, dy, dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))


def log_response(gray, sigma=4.0):
    return unit_range(np.abs(laplacian(gaussian(gray, sigma))))


def gradient(gray, method):
    if method == "roberts":
        a, b = gray - shifted(gray, -1, -1), shifted(gray, 0, -1) - shifted(gray, -1, 0)
    else:
        smooth, total = GRADIENTS[method]
        k, d = np.array(smooth) / total, np.array([1.0, 0.0, -1.0]) / 2
        a = correlated(correlated(gray, d, 0, "reflect"), k, 1, "reflect")
        b = correlated(correlated(gray, k, 0, "reflect"), d, 1, "reflect")
    return np.sqrt((a * a + b * b) / 2)


def central_difference(gray):
    gx, gy = np.zeros_like(gray), np.zeros_like(gray)
    gx[:, 1:-1] = (gray[:, 2:] - gray[:, :-2]) / 2
    gy[1:-1] = (gray[2:] - gray[:-2]) / 2
    return np.hypot(gx, gy)


def _thinned(size, gx, gy):
    """Local maxima of a gradient along its direction, in four sectors."""
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * 0.41421356, ay > ax * 2.41421356
    same = (gx * gy) >= 0
    before, after = np.zeros_like(size), np.zeros_like(size)
    for on, (dy, dx) in ((flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & same, (1, 1)), (~flat & ~steep & ~same, (1, -1))):
        before = np.where(on, shifted(size, -dy, -dx, "zero"), before)
        after = np.where(on, shifted(size, dy, dx, "zero"), after)
    return (size > before) & (size >= after)


def _followed(weak, strong):
    """Components of the weak edges that hold a strong one."""
    marks, n = labelled(weak, 8)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(marks[strong & weak])] = True
    keep[0] = False
    return keep[marks]


def canny(gray, low=0.1, high=0.25):
    """Edges of an 8-bit image: 3x3 derivative, sum of absolutes, thinning, hysteresis."""
    v = (gray * 255).astype(np.uint8).astype(np.float64)
    s, d = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx = correlated(correlated(v, s, 0, "nearest"), d, 1, "nearest")
    gy = correlated(correlated(v, d, 0, "nearest"), s, 1, "nearest")
    size = np.abs(gx) + np.abs(gy)
    thin = _thinned(size, gx, gy)
    return _followed(thin & (size > int(low * 255)), thin & (size > int(high * 255)))


def canny_smooth(gray, sigma=1.0, low=0.1, high=0.2):
    """Edges of a float image: Gaussian, derivative, thinning, hysteresis on its own units."""
    v = gaussian(gray, sigma)
    s, d = np.array([1.0, 2.0, 1.0]) / 4, np.array([-1.0, 0.0, 1.0]) / 2
    gx = correlated(correlated(v, s, 0, "reflect"), d, 1, "reflect")
    gy = correlated(correlated(v, d, 0, "reflect"), s, 1, "reflect")
    size = np.hypot(gx, gy) * 2
    thin = _thinned(size, gx, gy)
    thin[[0, -1]] = False
    thin[:, [0, -1]] = False
    return _followed(thin & (size >= low), thin & (size >= high))


# -- segmentation -----------------------------------------------------------------


def otsu(levels: np.ndarray) -> int:
    n = np.bincount(levels.ravel(), minlength=256).astype(np.float64)
    w0, m0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(all="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), (m0 * w0[-1] - m0[-1] * w0) ** 2 / (w0 * w1), 0.0)
    held = np.flatnonzero(n)
    return int(held[np.argmax(between[held])]) if len(held) else 0


def closed(mask, radius):
    """Dilation, then erosion, by a disc; what lies outside the frame is ignored."""
    grown = np.zeros_like(mask)
    for dy, dx in disc(radius):
        grown |= shifted(mask, dy, dx, "zero")
    out = np.ones_like(mask)
    for dy, dx in disc(radius):
        out &= ~shifted(~grown, dy, dx, "zero")
    return out


def labelled(mask: np.ndarray, connectivity: int = 8):
    """Component numbers in order of first pixel, and how many there are."""
    h, w = mask.shape
    at = np.flatnonzero(mask)
    name = np.arange(h * w)
    links = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    a, b = [], []
    for dy, dx in links:
        lo, hi = max(0, -dx), w - max(0, dx)
        on = mask[: h - dy, lo:hi] & mask[dy:, lo + dx : hi + dx]
        y, x = np.nonzero(on)
        a.append(y * w + x + lo)
        b.append((y + dy) * w + x + lo + dx)
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        low = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, name[a], low)
        np.minimum.at(new, name[b], low)
        new = new[new]
        if (new == name).all():
            break
        name = new
    out = np.zeros(h * w, np.int64)
    first, number = np.unique(name[at], return_inverse=True)
    out[at] = number + 1
    return out.reshape(h, w), len(first)


def without_small(mask, most: int, connectivity: int = 4):
    """Drops components of ``most`` pixels or fewer."""
    marks, n = labelled(mask, connectivity)
    big = np.bincount(marks.ravel(), minlength=n + 1) > most
    big[0] = False
    return big[marks]


def cell_mask(gray8, radius=5, most=100):
    return without_small(closed(gray8 <= otsu(gray8), radius), most)


def nucleus_mask(gray8, cells, radius=3, most=100):
    if not cells.any():
        return np.zeros_like(cells)
    return without_small(closed((gray8 < otsu(gray8[cells])) & cells, radius), most)


# -- regions and texture ----------------------------------------------------------


def _perimeter(mask):
    """Border pixels weighed by how they turn: 1, root 2, or the mean of both."""
    big = np.pad(mask, 1)
    inner = big & shifted(big, -1, 0, "zero") & shifted(big, 1, 0, "zero") & shifted(big, 0, -1, "zero") & shifted(big, 0, 1, "zero")
    edge = (big & ~inner).astype(np.int64)
    code = 10 * sum(shifted(edge, dy, dx, "zero") for dy in (-1, 1) for dx in (-1, 1)) + 2 * sum(shifted(edge, dy, dx, "zero") for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))) + edge
    # Neighbour codes and their weights.
    weight = np.zeros(51)
    weight[[5, 7, 15, 17, 25, 27]] = 1.0
    weight[[21, 33]] = np.sqrt(2)
    weight[[13, 23]] = (1 + np.sqrt(2)) / 2
    return float(np.bincount(code[edge > 0].ravel(), minlength=51)[:51] @ weight)


def _hull_area(mask):
    """Pixels inside the convex hull of the midpoints of the mask's pixel edges."""
    y, x = np.nonzero(mask)
    points = np.unique(np.concatenate([np.stack([y + dy, x + dx], 1) for dy, dx in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]), axis=0)

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points.tolist()) + chain(points[::-1].tolist())
    gy, gx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (ay, ax), (by, bx) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (by - ay) * (gx - ax) - (bx - ax) * (gy - ay) >= -1e-10
    return int(inside.sum())


def regions(mask: np.ndarray) -> list[dict]:
    """Area, perimeter, eccentricity and solidity of every 8-connected component."""
    marks, n = labelled(mask, 8)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(marks == k)
        part = marks[y.min() : y.max() + 1, x.min() : x.max() + 1] == k
        a, c = np.var(y), np.var(x)
        b = np.mean((y - y.mean()) * (x - x.mean()))
        mid, half = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b * b)
        l1, l2 = mid + half, mid - half
        out.append({"label": k, "area": float(len(y)), "perimeter": _perimeter(part), "eccentricity": float(np.sqrt(min(1.0, max(0.0, 1 - l2 / l1)))) if l1 else 0.0, "solidity": len(y) / _hull_area(part)})
    return out


def morphology(mask):
    """Sum of areas and perimeters, mean eccentricity and solidity; NaN where nothing is set."""
    found = regions(mask)
    if not found:
        return (float("nan"),) * 4
    col = lambda k: [r[k] for r in found]
    return float(sum(col("area"))), float(sum(col("perimeter"))), float(np.mean(col("eccentricity"))), float(np.mean(col("solidity")))


def glcm(gray8, mask=None) -> np.ndarray:
    """Symmetric shares of horizontally adjacent levels, pixels off the mask counting as 0."""
    v = np.where(mask, gray8, 0).astype(np.int64) if mask is not None else gray8.astype(np.int64)
    n = np.bincount((v[:, :-1] * 256 + v[:, 1:]).ravel(), minlength=65536).reshape(256, 256).astype(np.float64)
    n += n.T
    return n / n.sum() if n.sum() else n


def texture(gray8, mask=None):
    """Contrast, energy, homogeneity and correlation of the co-occurrences."""
    p = glcm(gray8, mask)
    i, j = np.mgrid[:256, :256]
    d = (i - j) ** 2
    mean = (p * i).sum()
    variance = (p * (i - mean) ** 2).sum()
    correlation = 1.0 if variance < 1e-15 else float((p * (i - mean) * (j - mean)).sum() / variance)
    return float((p * d).sum()), float(np.sqrt((p * p).sum())), float((p / (1 + d)).sum()), correlation


def layers_and_features(rgb: np.ndarray, params, reference=None):
    """All layers of one image, and its sixteen numbers in schema order."""
    if reference is not None:
        rgb = stain_normalised(rgb, *reference)
    rgb = denoised(rgb, params.denoise, params)
    gray8 = gray_of(rgb)
    gray = gray8 / 255.0
    cells = cell_mask(gray8, params.cell_close, params.min_area)
    nuclei = nucleus_mask(gray8, cells, params.nucleus_close, params.min_area)
    layers = {"rgb": rgb, "apc": apc_response(gray, *params.apc).astype(np.float32), "log": log_response(gray, params.log_sigma).astype(np.float32), "canny": canny(gray, *params.canny), "nucleus_mask": nuclei, "cell_mask": cells}
    area, perimeter, eccentricity, solidity = morphology(nuclei)
    cell = float(cells.sum()) if cells.any() else float("nan")
    flat = rgb.reshape(-1, 3).astype(np.float64)
    return layers, (area, perimeter, eccentricity, solidity, cell, area / cell if cell > 0 else float("nan"), *texture(gray8, cells if cells.any() else None), *flat.mean(axis=0).tolist(), *flat.std(axis=0).tolist())
