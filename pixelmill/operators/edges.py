"""Edge detection in two dialects, and the views made of its result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K

METHODS = ("apc", "canny", "central", "log", "sobel", "prewitt", "roberts", "scharr")


def detect_edges(rgb, method="sobel", threshold=0.3, sigma=1.0, alpha=0.5, min_size=20, close=2, low=0.1, high=0.2, dialect="strict"):
    """(binary, response) of one image.

    strict: gray / 255, gradient responses brought to 0..1, 8-bit Canny, unknown methods
    fail. lenient: gray brought to 0..1, raw gradient responses, the other Canny and
    principal curvature, unknown methods are Sobel.
    """
    strict = dialect == "strict"
    if strict and method not in METHODS:
        raise ValueError(f"unknown edge method {method!r}")
    gray8 = K.gray_of(rgb) if rgb.ndim == 3 else rgb
    gray = gray8 / 255.0 if strict else K.unit_range(gray8.astype(np.float64))
    if method == "canny":
        binary = K.canny(gray, low, high) if strict else K.canny_smooth(gray, sigma, low, high)
        return binary, binary.astype(np.float64)
    smooth = K.gaussian(gray, max(sigma, 0.1))
    if method == "apc":
        response = K.apc_response(smooth, max(sigma, 0.1), alpha, lenient=not strict)
    elif method == "central":
        response = K.unit_range(K.central_difference(smooth))
    elif method == "log":
        response = K.log_response(smooth, max(sigma, 0.1))
    else:
        response = K.gradient(smooth, method if method in METHODS else "sobel")
        response = K.unit_range(response) if strict else response
    binary = response > min(1.0, max(0.0, threshold))
    if min_size > 0:
        binary = K.without_small(binary, min_size - 1)
    return (K.closed(binary, close) if close > 0 else binary), response


def jet(v):
    """The analytic jet colour map of values in 0..1, as RGB bytes."""
    c = [np.clip(1.5 - np.abs(4 * v - k), 0, 1) for k in (3, 2, 1)]
    return (np.stack(c, -1) * 255).astype(np.uint8)


# A public polynomial of degree six for each channel of the inferno map.
INFERNO = (
    (0.0002189403691192265, 0.1065134194856116, 11.60249308247187, -41.70399613139459, 77.162935699427, -71.31942824499214, 25.13112622477341),
    (0.001651004631001012, 0.5639564367884091, -3.972853965665698, 17.43639888205313, -33.40235894210092, 32.62606426397723, -12.24266895238567),
    (-0.01948089843709184, 3.932712388889277, -15.9423941062914, 44.35414519872813, -81.80730925738993, 73.20951985803202, -23.07032500287172),
)


def inferno(v):
    """The inferno colour map of values in 0..1, as RGB bytes, by its polynomial."""
    return (np.stack([np.clip(np.polyval(c[::-1], np.asarray(v, np.float64)), 0, 1) for c in INFERNO], -1) * 255).astype(np.uint8)


def colour_map(v, name: str):
    """Red, green and blue columns in 0..1 of a column in 0..1."""
    if name == "gray":
        return v, v, v
    if name == "jet":
        made = [1.5 - F.abs(4 * v - k) for k in (3, 2, 1)]
    else:
        made = [sum((F.lit(w) * F.pow(v, F.lit(float(p))) for p, w in enumerate(c)), F.lit(0.0)) for c in INFERNO]
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) for c in made)


def edge_overlay(rgb, mask):
    """Cyan where the mask is set: red halved, green and blue halved and raised by 128."""
    out = rgb.astype(np.float64)
    out[mask] = np.minimum(out[mask] * 0.5 + np.array([0, 128, 128]), 255)
    return out.astype(np.uint8)


def tinted(rgb, mask, tint, alpha=0.45):
    out = rgb.astype(np.float64)
    out[mask] = (1 - alpha) * out[mask] + alpha * np.array(tint)
    return out.astype(np.uint8)


def stretched(rgb, mask):
    """Contrast of each channel stretched to 0..255 inside the mask; flat channels stay."""
    out = rgb.copy()
    for c in range(rgb.shape[2]):
        v = rgb[..., c][mask].astype(np.float64)
        if len(v) and v.max() > v.min():
            out[..., c][mask] = (255 * (v - v.min()) / (v.max() - v.min())).astype(np.uint8)
    return out


def gained(rgb, mask, gain=1.5):
    out = rgb.astype(np.float64)
    out[mask] = np.minimum(out[mask] * gain, 255)
    return out.astype(np.uint8)


def removed_noise(before, after):
    """Amplified difference: three times for colour, five for gray."""
    return np.minimum(np.abs(before.astype(np.int64) - after.astype(np.int64)) * (3 if before.ndim == 3 else 5), 255).astype(np.uint8)


def edge_views(rgb, binary, response, dialect="strict"):
    """Overlay, edge map, coloured response and enhanced view of an edge result."""
    rgb = rgb if rgb.ndim == 3 else np.repeat(rgb[..., None], 3, axis=2)
    edges = np.repeat(np.where(binary, 255, 0).astype(np.uint8)[..., None], 3, axis=2)
    return {"overlay": edge_overlay(rgb, binary), "edges": edges, "response": jet(K.unit_range(response)), "enhanced": stretched(rgb, binary) if dialect == "strict" else gained(rgb, binary)}


def unified(rgb, method="sobel", iterations=200, lam=0.05, dt=0.15, g=1.3, h=1.0, eps=1e-8):
    """Denoised gray, response of the gray as it was, and its colours; no threshold."""
    gray = K.unit_range((K.gray_of(rgb) if rgb.ndim == 3 else rgb).astype(np.float64))
    _, response = detect_edges(rgb, method, dialect="lenient", min_size=0, close=0)
    return {"denoised": K.hds(gray, iterations, lam, dt, g, h, eps), "response": response, "coloured": jet(K.unit_range(response))}
