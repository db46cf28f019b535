"""Image operators as column expressions: one row per image, pixels in an array.

Nothing here shuffles or leaves the JVM; an image is a column of ``height * width``
doubles in row-major order. Histograms and co-occurrences, where a reduction by value
is wanted, are in ``operators.reductions``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class Frame:
    """Size of the images of a column; ints, or columns where it differs by row."""

    def __init__(self, height, width):
        self._size = height, width

    @property
    def h(self) -> Column:
        return F.lit(self._size[0]) if isinstance(self._size[0], int) else self._size[0]

    @property
    def w(self) -> Column:
        return F.lit(self._size[1]) if isinstance(self._size[1], int) else self._size[1]

    def places(self) -> Column:
        return F.sequence(F.lit(0), self.h * self.w - 1)

    def row(self, i) -> Column:
        return F.floor(i / self.w).cast("int")

    def col(self, i) -> Column:
        return (i % self.w).cast("int")


def let(value, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bound(operator):
    """An operator whose image is computed once, however often its pixels are read."""

    def run(v, *rest, **named):
        return let(v, lambda x: operator(x, *rest, **named))

    run.__name__, run.__doc__ = operator.__name__, operator.__doc__
    return run


def _at(v: Column, i: Column) -> Column:
    return v[i]


def folded(p: Column, n: Column, border: str) -> Column:
    """Index of a place outside 0..n-1: the edge sample repeated, mirrored with or without it."""
    if border == "nearest":
        return F.greatest(F.lit(0), F.least(n - 1, p))
    if border == "mirror":  # the edge sample isn't repeated
        period = F.greatest(F.lit(1), 2 * n - 2)
        m = F.pmod(p, period)
        return F.when(m < n, m).otherwise(period - m)
    m = F.pmod(p, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def pixel(v: Column, f: Frame, y: Column, x: Column, border: str = "reflect") -> Column:
    if border == "zero":
        inside = (y >= 0) & (y < f.h) & (x >= 0) & (x < f.w)
        return F.when(inside, _at(v, (y * f.w + x).cast("int"))).otherwise(F.lit(0.0))
    return _at(v, (folded(y, f.h, border) * f.w + folded(x, f.w, border)).cast("int"))


@bound
def stencil(v: Column, f: Frame, taps, border: str = "reflect") -> Column:
    """Sum of ``weight * v[y + dy, x + dx]`` over taps (dy, dx, weight)."""

    def one(i):
        total = F.lit(0.0)
        for dy, dx, weight in taps:
            total = total + F.lit(float(weight)) * pixel(v, f, f.row(i) + dy, f.col(i) + dx, border)
        return total

    return F.transform(f.places(), one)


@bound
def along(v: Column, f: Frame, kernel, axis: int, border: str) -> Column:
    """One separable pass of an odd kernel along rows (axis 1) or columns (axis 0)."""
    r = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)])

    def one(i):
        at = lambda t: (f.row(i) + (t["k"] if axis == 0 else 0), f.col(i) + (t["k"] if axis == 1 else 0))
        return F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["w"] * pixel(v, f, *at(t), border))

    return F.transform(f.places(), one)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian(v: Column, f: Frame, sigma: float, border: str = "reflect") -> Column:
    k = gaussian_kernel(sigma)
    return along(along(v, f, k, 0, border), f, k, 1, border)


def unit_range(v: Column) -> Column:
    """(v - min) / (max - min + 1e-10); a constant image becomes 0."""
    return let(F.struct(v.alias("v"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda s: F.transform(s["v"], lambda x: (x - s["lo"]) / (s["hi"] - s["lo"] + F.lit(1e-10))))


def bytes_of(v: Column) -> Column:
    """Scaled to 0..255 and cut off, not rounded."""
    return F.transform(v, lambda x: F.floor(x * 255.0).cast("int"))


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray, rounded; whole numbers until the division, so that halves round alike everywhere."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def both(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


# The public gradient kernels, as smoothing taps and their divisor.
GRADIENTS = {"sobel": ((1, 2, 1), 4), "prewitt": ((1, 1, 1), 3), "scharr": ((3, 10, 3), 16)}
LAPLACE = [(0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0)]


def gradient_taps(method: str):
    """Vertical and horizontal taps; magnitude is the root of half the sum of squares."""
    if method == "roberts":
        return [(0, 0, 1.0), (-1, -1, -1.0)], [(0, -1, 1.0), (-1, 0, -1.0)]
    smooth, total = GRADIENTS[method]
    down = [(dy, dx - 1, s * w / (2 * total)) for dx, s in enumerate(smooth) for dy, w in ((-1, 1.0), (1, -1.0))]
    return down, [(dx, dy, w) for dy, dx, w in down]


def gradient(v: Column, f: Frame, method: str) -> Column:
    a, b = (stencil(v, f, taps) for taps in gradient_taps(method))
    return both(a, b, lambda p, q: F.sqrt((p * p + q * q) / 2))


@bound
def central_difference(v: Column, f: Frame) -> Column:
    """Half the difference of both neighbours, 0 on the border, as a length."""

    def one(i):
        y, x = f.row(i), f.col(i)
        side = lambda inside, a, b: F.when(inside, (_at(v, (i + a).cast("int")) - _at(v, (i - b).cast("int"))) / 2).otherwise(F.lit(0.0))
        gx, gy = side((x > 0) & (x < f.w - 1), 1, 1), side((y > 0) & (y < f.h - 1), f.w, f.w)
        return F.sqrt(gx * gx + gy * gy)

    return F.transform(f.places(), one)


def log_response(v: Column, f: Frame, sigma: float) -> Column:
    return unit_range(F.transform(stencil(gaussian(v, f, sigma), f, LAPLACE), F.abs))


@bound
def _slope(v: Column, f: Frame, axis: int) -> Column:
    """Central differences inside, one-sided ones on the border."""

    def one(i):
        p, n, step = (f.row(i), f.h, f.w) if axis == 0 else (f.col(i), f.w, F.lit(1))
        at = lambda j: _at(v, j.cast("int"))
        return F.when(n == 1, F.lit(0.0)).when(p == 0, at(i + step) - at(i + 0)).when(p == n - 1, at(i + 0) - at(i - step)).otherwise((at(i + step) - at(i - step)) / 2)

    return F.transform(f.places(), one)


def hessian_eigenvalues(v: Column, f: Frame, sigma: float) -> Column:
    """Array of structs (l1, l2), l1 >= l2, of the Hessian of the smoothed image."""
    smooth = gaussian(v, f, sigma, "zero")

    def from_slopes(s):
        rr, rc, cc = _slope(s["y"], f, 0), _slope(s["y"], f, 1), _slope(s["x"], f, 1)
        return F.transform(
            F.arrays_zip(rr.alias("a"), rc.alias("b"), cc.alias("c")),
            lambda h: let((h["a"] + h["c"]) / 2, lambda m: let(F.sqrt(((h["a"] - h["c"]) / 2) * ((h["a"] - h["c"]) / 2) + h["b"] * h["b"]), lambda d: F.struct((m + d).alias("l1"), (m - d).alias("l2")))),
        )

    return let(smooth, lambda s: let(F.struct(_slope(s, f, 0).alias("y"), _slope(s, f, 1).alias("x")), from_slopes))


def apc_response(v: Column, f: Frame, sigma: float, alpha: float, lenient: bool = False) -> Column:
    weight = (lambda e: F.abs(e["l1"]) + alpha * F.abs(e["l2"])) if lenient else (lambda e: alpha * F.abs(e["l2"]) + (1 - alpha) * F.abs(e["l1"]))
    return unit_range(F.transform(hessian_eigenvalues(v, f, sigma), weight))


@bound
def hds_step(u: Column, first: Column, f: Frame, lam: float, dt: float, g: float, h: float, eps: float) -> Column:
    """One diffusion step from ``u`` towards the noisy image ``first``, clipped to 0..1."""
    c = lambda d: g * (1 / (1 + d * d / (h * h)) + 1 / (F.abs(d) + eps)) * d

    def one(i):
        y, x = f.row(i), f.col(i)
        me = _at(u, i.cast("int"))
        at = lambda dy, dx: pixel(u, f, y + dy, x + dx, "nearest")
        flow = c(me - at(-1, 0)) + c(at(1, 0) - me) + c(me - at(0, -1)) + c(at(0, 1) - me)
        prior = lam * (me / (_at(first, i.cast("int")) + eps) - 1) * (1 / (me + eps))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), me + dt * (flow - prior)))

    return F.transform(f.places(), one)


def bilateral_taps(diameter: int, sigma_space: float):
    r = diameter // 2
    return [(dy, dx, math.exp(-0.5 * (dy * dy + dx * dx) / sigma_space**2)) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


@bound
def bilateral(v: Column, f: Frame, diameter: int, sigma_colour: float, sigma_space: float) -> Column:
    """Edge-preserving mean of one channel over a disc, mirrored at the border."""
    taps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in bilateral_taps(diameter, sigma_space)])
    scale = -0.5 / sigma_colour**2

    def one(i):
        me = _at(v, i.cast("int"))
        each = F.transform(taps, lambda t: F.struct(t["w"].alias("w"), pixel(v, f, f.row(i) + t["dy"], f.col(i) + t["dx"], "mirror").alias("v")))
        weighed = F.transform(each, lambda t: F.struct((t["w"] * F.exp(scale * (t["v"] - me) * (t["v"] - me))).alias("w"), t["v"].alias("v")))
        total = F.aggregate(weighed, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda s, t: F.struct((s["s"] + t["w"] * t["v"]).alias("s"), (s["n"] + t["w"]).alias("n")))
        return total["s"] / total["n"]

    return F.transform(f.places(), one)


def disc(radius: int):
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


@bound
def dilated(mask: Column, f: Frame, radius: int, erode: bool = False) -> Column:
    """Whether any (``erode``: every) pixel of the disc inside the frame is set."""

    def one(i):
        inside = F.filter(F.transform(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in disc(radius)]), lambda d: F.struct((f.row(i) + d["y"]).alias("y"), (f.col(i) + d["x"]).alias("x"))), lambda d: (d["y"] >= 0) & (d["y"] < f.h) & (d["x"] >= 0) & (d["x"] < f.w))
        at = lambda d: _at(mask, (d["y"] * f.w + d["x"]).cast("int"))
        return F.forall(inside, at) if erode else F.exists(inside, at)

    return F.transform(f.places(), one)


def closed(mask: Column, f: Frame, radius: int) -> Column:
    return let(dilated(mask, f, radius), lambda m: dilated(m, f, radius, erode=True))


def lab_of(r: Column, g: Column, b: Column) -> Column:
    """8-bit CIE Lab of 0..255 sRGB values, as an unrounded struct (l, a, b)."""
    linear = lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)
    curve = lambda t: F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    def from_linear(s):
        x = (0.412453 * s["r"] + 0.357580 * s["g"] + 0.180423 * s["b"]) / 0.950456
        y = 0.212671 * s["r"] + 0.715160 * s["g"] + 0.072169 * s["b"]
        z = (0.019334 * s["r"] + 0.119193 * s["g"] + 0.950227 * s["b"]) / 1.088754
        light = F.when(y > 0.008856, 116 * F.pow(y, 1 / 3) - 16).otherwise(903.3 * y)
        return F.struct((light * 255 / 100).alias("l"), (500 * (curve(x) - curve(y)) + 128).alias("a"), (200 * (curve(y) - curve(z)) + 128).alias("b"))

    return let(F.struct(linear(r / 255).alias("r"), linear(g / 255).alias("g"), linear(b / 255).alias("b")), from_linear)
