"""Queries of whole operators: masks, shapes, denoisers, edges and views, on images large enough to have regions.

An embedding's 8x8 byte image is also a 32x32 one, each pixel a block of 4x4, so that
closing, small-object removal and shapes have something to do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.functions.params import COLOUR, DEFAULT, MORPHOLOGY, TEXTURE
from pixelmill.operators import edges as E
from pixelmill.operators import split as S
from pixelmill.sources.tables import SIDE, colour_images, gray_images

TILE, TIMES = 32, 4  # side of a tile, and of the block that a pixel becomes
NUMBERS = (*MORPHOLOGY, *TEXTURE, *COLOUR)
DIGITS = dict(zip(NUMBERS, (0, 4, 4, 4, 0, 6, 4, 6, 6, 5, 6, 6, 6, 6, 6, 6), strict=True))
PREFIX = "WBC-Malignant-"  # fixed value: what figure labels leave out
BOXES = ((400, 300), (400, 550), (350, 350))  # fixed values: the sizes that pictures are fitted into


def _enlarged(c: str):
    place = lambda i: F.col(c)[(F.floor(i / (TILE * TIMES)) * SIDE + F.floor(i % TILE / TIMES)).cast("int")]
    return F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), place).alias(c)


def tiles(spark, sf_dir) -> DataFrame:
    """(image_id, g): each embedding as a 32x32 byte image."""
    return gray_images(spark, sf_dir).select("image_id", _enlarged("g"))


def colour_tiles(spark, sf_dir) -> DataFrame:
    """(image_id, red, green, blue): three consecutive ones as a 32x32 colour image."""
    return colour_images(spark, sf_dir).select("image_id", *map(_enlarged, ("red", "green", "blue")))


def per_image(make, schema: str, source=tiles, side: int = TILE):
    """A query that runs a kernel on each byte image, in Arrow batches; ``make`` gives an image's rows without its id."""
    names = ["image_id", *(c.split()[0] for c in schema.split(", "))]

    def run(spark, sf_dir):
        images = source(spark, sf_dir)
        planes = [c for c in images.columns if c in ("g", "red", "green", "blue")]

        def batches(frames):
            for f in frames:
                rows = []
                for i, *v in zip(f["image_id"], *(f[c] for c in planes), strict=True):
                    image = np.stack([np.asarray(p, np.uint8).reshape(side, side) for p in v], -1)
                    rows += [(i, *r) for r in make(image if len(v) > 1 else image[..., 0])]
                yield pd.DataFrame(rows, columns=names)

        return images.select("image_id", *planes).mapInPandas(batches, "image_id long, " + schema)

    return run


def _sums(mask):
    """Area of a mask, and the sums of its places and of their squares."""
    at = np.flatnonzero(mask)
    return [(len(at), int(at.sum()), int((at * at).sum()))]


def _cells(g):
    return K.cell_mask(g, DEFAULT.cell_close, DEFAULT.min_area)


def _nuclei(g):
    return K.nucleus_mask(g, _cells(g), DEFAULT.nucleus_close, DEFAULT.min_area)


def _shapes(mask):
    return [(r["label"], r["area"], round(r["perimeter"], 6), round(r["eccentricity"] + 1e-9, 4) + 0.0, round(r["solidity"] + 1e-9, 6)) for r in K.regions(mask)]


def _features(rgb):
    _, found = K.layers_and_features(rgb, DEFAULT)
    return [tuple(None if x != x else round(float(x) + (0.0 if n in TEXTURE[1:] else 1e-9), DIGITS[n]) + 0.0 for n, x in zip(NUMBERS, found, strict=True))]


def _pixels(rgb):
    return [(int(y), int(x), *map(int, rgb[y, x])) for y in range(rgb.shape[0]) for x in range(rgb.shape[1])]


def _edges(method, dialect):
    def one(g):
        binary, response = E.detect_edges(g, method, dialect=dialect, min_size=4, close=1)
        return [(int(binary.sum()), round(float(response.sum()), 5))]

    return one


def _unified(g):
    found = E.unified(g)
    return [(round(float(found["denoised"].sum()), 4), round(float(found["response"].sum()), 4))]


def _views(dialect):
    def one(g):
        views = E.edge_views(g, *E.detect_edges(g, "sobel", dialect=dialect, min_size=4, close=1), dialect)
        return [tuple(int(views[n].sum(dtype=np.int64)) for n in ("overlay", "edges", "enhanced"))]

    return one


def reinhard_rgb(spark, sf_dir):
    """Colour images matched to the average Lab statistics of all of them, back in RGB."""
    images = colour_images(spark, sf_dir)
    stats = per_image(lambda rgb: [np.concatenate(K.lab_stats(rgb)).tolist()], ", ".join(f"{c} double" for c in "abcdef"), colour_images, SIDE)(spark, sf_dir)
    row = stats.agg(*[F.avg(c).alias(c) for c in "abcdef"]).first()
    matched = lambda rgb: _pixels(K.stain_normalised(rgb, row[:3], row[3:]))
    return per_image(matched, "y int, x int, red int, green int, blue int", lambda *_: images, SIDE)(spark, sf_dir)


def removed_noise(spark, sf_dir):
    """The amplified difference that the colour denoiser makes."""
    made = lambda rgb: _pixels(E.removed_noise(rgb, K.bilateral(rgb, *DEFAULT.bilateral)))
    return per_image(made, "y int, x int, red int, green int, blue int", colour_images, SIDE)(spark, sf_dir)


def label_tokens(spark, sf_dir):
    """A figure's label and file token of each image name."""
    name = F.concat(F.lit(PREFIX), "class_name", F.lit("-"), F.lpad(F.col("image_id").cast("string"), 3, "0"))
    rows = gray_images(spark, sf_dir).select("image_id", name.alias("stem"))
    return rows.select("image_id", F.replace("stem", F.lit(PREFIX), F.lit("")).alias("label"), F.lower(F.element_at(F.split("stem", "-"), -2)).alias("token"))


def aspect_fit(spark, sf_dir):
    """Sizes at which images of a width and height fill a box without being stretched."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 10).cast("int").alias("w"), (F.col("p_partkey") % 300 + 1).cast("int").alias("h"))
    fitted = []
    for k, (wide, high) in enumerate(BOXES):
        ratio = F.col("w") / F.col("h")
        flat = ratio > wide / high
        fitted += [F.when(flat, wide).otherwise(F.floor(high * ratio)).cast("int").alias(f"w{k}"), F.when(flat, F.floor(wide / ratio)).otherwise(high).cast("int").alias(f"h{k}")]
    return sizes.select("p_partkey", *fitted)


def figure_bars(spark, sf_dir):
    """The values and texts of the morphology and texture bars, one row per bar."""
    rows = queries()["pipeline_features"](spark, sf_dir)
    shown = [(n, "%.2f") for n in ("nucleus_area", "nucleus_eccentricity", "nucleus_solidity", "nc_ratio")] + [(n, "%.3f") for n in TEXTURE]
    bar = lambda n, form: F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.when(F.col(n) < 100, F.format_string(form, F.col(n) + 1e-9)).otherwise(F.floor(n).cast("string")).alias("text"))
    return rows.select("image_id", F.explode(F.array(*[bar(*x) for x in shown])).alias("b")).select("image_id", "b.metric", "b.value", F.when(F.col("b.value").isNotNull(), F.col("b.text")).alias("text"))


def figure_layers(spark, sf_dir):
    """The images of a figure list with their masks, joined by name and split."""
    manifest = S.split(gray_images(spark, sf_dir).select("image_id", "class_name"))
    figures = S.reference_sample(S.reference_pool(manifest)).select("image_id", "split")
    layers = queries()["cell_mask"](spark, sf_dir).join(manifest.select("image_id", "split"), "image_id")
    return layers.join(F.broadcast(figures), ["image_id", "split"])  # no more figures than the sample has


def colour_maps(spark, sf_dir):
    """Every byte level in the jet, inferno and gray maps."""
    levels = spark.range(256).select(F.col("id").cast("int").alias("level"), (F.col("id") / 255.0).alias("v"))
    return levels.select("level", *[F.floor(c * 255 + 1e-9).cast("int").alias(f"{m}_{n}") for m in ("jet", "inferno") for n, c in zip(("red", "green", "blue"), E.colour_map(F.col("v"), m), strict=True)], F.col("level").alias("gray"))


def queries():
    sums, edges, rgb = "area long, places long, squares long", "n long, response double", "y int, x int, red int, green int, blue int"
    shape = "label long, area double, perimeter double, eccentricity double, solidity double"
    small = {"source": gray_images, "side": SIDE}
    made = {
        "cell_mask": per_image(lambda g: _sums(_cells(g)), sums),
        "nucleus_mask": per_image(lambda g: _sums(_nuclei(g)), sums),
        "region_shapes": per_image(lambda g: _shapes(_cells(g)), shape),
        "perimeter_solidity": per_image(lambda g: _shapes(g <= K.otsu(g)), shape, **small),
        "pipeline_features": per_image(_features, ", ".join(f"{n} double" for n in NUMBERS), colour_tiles),
        "bilateral_colour": per_image(lambda c: _pixels(K.bilateral(c, *DEFAULT.bilateral)), rgb, colour_images, SIDE),
        "noise_removed_colour": removed_noise,
        "hds_full": per_image(lambda g: [(round(float(K.hds(g / 255.0, *DEFAULT.hds).sum()), 4),)], "total double", **small),
        "hds_colour": per_image(lambda c: _pixels(np.stack([(K.hds(c[..., k] / 255.0, 20, *DEFAULT.hds[1:]) * 255).astype(np.uint8) for k in range(3)], -1)), rgb, colour_images, SIDE),
        "unified_sobel": per_image(_unified, "denoised double, response double", **small),
        "reinhard_rgb": reinhard_rgb,
        "label_tokens": label_tokens,
        "aspect_fit": aspect_fit,
        "figure_bars": figure_bars,
        "figure_layers": figure_layers,
        "colour_maps": colour_maps,
    }
    made |= {f"detect_edges_{d}_{m}": per_image(_edges(m, d), edges, **small) for d in ("strict", "lenient") for m in E.METHODS}
    made |= {f"edge_views_{d}": per_image(_views(d), "overlay long, edges long, enhanced long", **small) for d in ("strict", "lenient")}
    return made
