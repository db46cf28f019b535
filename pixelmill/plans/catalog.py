"""Registry of the image queries and their SQL counterparts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.functions.params import DEFAULT
from pixelmill.operators import arrays as A
from pixelmill.operators import reductions as R
from pixelmill.operators import split as S
from pixelmill.plans import oracle as Q
from pixelmill.plans import tiles, tiles_oracle
from pixelmill.sources.tables import FRAME, SIDE, colour_images, gray_images, pixels


def channels():
    return tuple(F.col(c).cast("array<double>") for c in ("red", "green", "blue"))


def rounded(c, digits=6):
    return F.round(c, digits) + F.lit(0.0)


def _pixelwise(make, digits=6, source=gray_images):
    """A query of one value per pixel from an array expression."""

    def run(spark, sf_dir):
        return pixels(source(spark, sf_dir), F.transform(make(), lambda x: rounded(x, digits)))

    return run


def _images(frame_function, schema):
    """A query that runs a kernel on each 8x8 byte image, in Arrow batches."""

    def run(spark, sf_dir):
        def batches(frames):
            for f in frames:
                rows = [r for i, g in zip(f["image_id"], f["g"], strict=True) for r in frame_function(i, np.asarray(g, np.uint8).reshape(SIDE, SIDE))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        return gray_images(spark, sf_dir).select("image_id", "g").mapInPandas(batches, schema)

    return run


def _manifest(spark, sf_dir):
    return gray_images(spark, sf_dir).select("image_id", "class_name")


def class_map(spark, sf_dir):
    return S.with_class_ids(_manifest(spark, sf_dir))


def stems(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    token = F.lower(F.replace(F.get(F.split("url", "/"), 2), F.lit("www."), F.lit("")))
    return pages.select("page_id", S.stem(F.col("url")).alias("stem"), S.suffix(F.col("url")).alias("ext"), token.alias("token"))


def split_assign(spark, sf_dir):
    return S.split(_manifest(spark, sf_dir))


def split_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("class_name"))
    return S.split_counts(S.split(docs))


def _pool(spark, sf_dir):
    return S.reference_pool(S.split(_manifest(spark, sf_dir))).select("image_id", "class_name", "split", "pool")


def _lab(spark, sf_dir):
    images = colour_images(spark, sf_dir)
    lab = F.transform(F.arrays_zip(*[c.alias(n) for c, n in zip(channels(), "rgb", strict=True)]), lambda p: A.lab_of(p["r"], p["g"], p["b"]))
    return pixels(images.withColumn("lab", lab), F.col("lab"), "lab").select("image_id", "y", "x", "lab.*")


def _lab_stats(spark, sf_dir):
    aggs = [f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in "lab"]
    return _lab(spark, sf_dir).groupBy("image_id").agg(*aggs)


def lab_stats(spark, sf_dir):
    stats = _lab_stats(spark, sf_dir)
    return stats.select("image_id", *[rounded(c, 4).alias(c) for c in stats.columns[1:]])


def stain_reference(spark, sf_dir):
    stats = _lab_stats(spark, sf_dir)
    chosen = S.reference_sample(_pool(spark, sf_dir)).select("image_id")
    used = stats.join(F.broadcast(chosen), "image_id")
    return used.agg(*[rounded(F.avg(c), 4).alias(c) for c in stats.columns[1:]], F.count("*").alias("n"))


def reinhard(spark, sf_dir):
    lab, stats = _lab(spark, sf_dir), _lab_stats(spark, sf_dir)
    reference = stats.agg(*[F.avg(c).alias(f"ref_{c}") for c in stats.columns[1:]])
    joined = lab.join(stats, "image_id").join(F.broadcast(reference))
    moved = [rounded(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-8) * F.col(f"ref_std_{c}") + F.col(f"ref_mean_{c}"))), 4).alias(c) for c in "lab"]
    return joined.select("image_id", "y", "x", *moved)


def gray_convert(spark, sf_dir):
    gray = F.transform(F.arrays_zip(*[c.alias(n) for c, n in zip(channels(), "rgb", strict=True)]), lambda p: A.gray_of(p["r"], p["g"], p["b"]))
    return pixels(colour_images(spark, sf_dir), gray)


def channel_stats(spark, sf_dir):
    flat = pixels(colour_images(spark, sf_dir), F.arrays_zip(*[c.alias(n) for c, n in zip(channels(), "RGB", strict=True)]), "p").select("image_id", "p.*")
    return flat.groupBy("image_id").agg(*[rounded(f(c)).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in "RGB"])


def _thresholds(spark, sf_dir):
    return R.otsu(R.histogram(pixels(gray_images(spark, sf_dir), F.col("g"), "g"), ["image_id"]), ["image_id"])


def _masked(spark, sf_dir):
    """Images with their cell and nucleus masks (thresholds only)."""
    images = gray_images(spark, sf_dir).join(_thresholds(spark, sf_dir), "image_id").withColumn("cell", F.transform(F.col("g"), lambda g: g <= F.col("threshold")))
    inside = images.select("image_id", F.explode(F.filter(F.col("g"), lambda g: g <= F.col("threshold"))).alias("g"))
    inner = R.otsu(R.histogram(inside, ["image_id"]), ["image_id"]).withColumnRenamed("threshold", "inner")
    return images.join(inner, "image_id", "left").withColumn("nucleus", F.transform(F.col("g"), lambda g: (g <= F.col("threshold")) & F.coalesce(g < F.col("inner"), F.lit(False))))


def otsu_masked(spark, sf_dir):
    return _masked(spark, sf_dir).where("inner is not null").select("image_id", F.col("inner").alias("threshold"))


def _area(name):
    return F.size(F.filter(name, lambda x: x)).cast("long")


def cell_area(spark, sf_dir):
    return _masked(spark, sf_dir).select("image_id", _area("cell").alias("area"))


def nucleus_area(spark, sf_dir):
    return _masked(spark, sf_dir).select("image_id", _area("nucleus").alias("area"))


def nc_ratio(spark, sf_dir):
    cell = _area("cell").cast("double")
    return _masked(spark, sf_dir).select("image_id", F.when(cell > 0, rounded(_area("nucleus") / cell)).alias("nc_ratio"))


def hessian(spark, sf_dir):
    e = pixels(gray_images(spark, sf_dir), A.hessian_eigenvalues(F.col("v"), FRAME, 1.0), "e")
    return e.select("image_id", "y", "x", rounded(F.col("e.l1")).alias("l1"), rounded(F.col("e.l2")).alias("l2"))


def _mask_query(make):
    def run(spark, sf_dir):
        return pixels(_masked(spark, sf_dir), make(F.col("cell")))

    return run


def glcm_matrix(spark, sf_dir):
    shares = R.glcm(R.pairs(gray_images(spark, sf_dir), ["image_id"], "g", SIDE), ["image_id"])
    return shares.select("image_id", "i", "j", rounded(F.col("p")).alias("p"))


def _texture(counts, key):
    t = R.texture(counts, key)
    digits = {"glcm_contrast": 4, "glcm_correlation": 5}
    return t.select(*key, *[rounded(c, digits.get(c, 6)).alias(c) for c in t.columns[len(key) :]])


def glcm_props(spark, sf_dir):
    return _texture(R.pairs(gray_images(spark, sf_dir), ["image_id"], "g", SIDE), ["image_id"])


def glcm_masked(spark, sf_dir):
    images = _masked(spark, sf_dir).withColumn("g", F.zip_with("g", "cell", lambda g, m: F.when(m, g).otherwise(0)))
    return _texture(R.pairs(images, ["image_id"], "g", SIDE), ["image_id"])


def _channels(make):
    """A query of three values per pixel from (channel, mask) arrays; the mask is red above green."""

    def run(spark, sf_dir):
        images = colour_images(spark, sf_dir).withColumn("m", F.zip_with("red", "green", lambda a, b: a > b))
        made = F.arrays_zip(*[make(c, F.col("m"), n).alias(n) for c, n in zip(channels(), ("red", "green", "blue"), strict=True)])
        return pixels(images, made, "p").select("image_id", "y", "x", "p.*")

    return run


def _int(x):
    return F.floor(x).cast("int")


def _overlay(c, m, name):
    return F.zip_with(c, m, lambda v, on: F.when(on, _int(F.least(F.lit(255.0), v * 0.5 + (0 if name == "red" else 128)))).otherwise(_int(v)))


def _tint(c, m, name):
    return F.zip_with(c, m, lambda v, on: F.when(on, _int(v * 0.55 + 0.45 * {"red": 255, "green": 64, "blue": 0}[name])).otherwise(_int(v)))


def _gain(c, m, name):
    return F.zip_with(c, m, lambda v, on: F.when(on, _int(F.least(F.lit(255.0), v * 1.5))).otherwise(_int(v)))


def _stretch(c, m, name):
    def bounded(s):
        flat = s["lo"].isNull() | (s["hi"] <= s["lo"])
        return F.zip_with(c, m, lambda v, on: F.when(on & ~flat, _int(255 * (v - s["lo"]) / (s["hi"] - s["lo"]))).otherwise(_int(v)))

    held = F.filter(F.zip_with(c, m, lambda v, on: F.when(on, v)), lambda v: v.isNotNull())
    return A.let(F.struct(F.array_min(held).alias("lo"), F.array_max(held).alias("hi")), bounded)


def edge_map(spark, sf_dir):
    return pixels(gray_images(spark, sf_dir), F.transform(A.gradient(F.col("v"), FRAME, "sobel"), lambda x: F.when(F.round(x, 9) > 0.3, 255).otherwise(0)))


def noise_removed(spark, sf_dir):
    images = gray_images(spark, sf_dir).withColumn("s", A.stencil(F.col("g").cast("array<double>"), FRAME, [(a, b, 0.125) for a in (0, 1) for b in (0, 1, -1, 0)]))
    return pixels(images, F.zip_with("g", "s", lambda a, b: _int(F.least(F.lit(255.0), 5 * F.abs(a - F.round(b, 6))))))


def crop(spark, sf_dir):
    return pixels(gray_images(spark, sf_dir), F.col("g")).where("y between 2 and 5 and x between 2 and 5")


def otsu_lineitem(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast("int").alias("g"))
    return R.otsu(R.histogram(items, ["l_returnflag"]), ["l_returnflag"])


def glcm_lineitem(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("g"))
    rows = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "g"))), lambda s: s["g"]).alias("g"))
    counts = R.pairs(rows.where("size(g) > 1"), [F.lit(0).alias("image_id")], "g", F.size("g"))
    return _texture(counts, ["image_id"]).drop("image_id")


def _labels(connectivity):
    def one(i, g):
        marks, _ = K.labelled(g <= K.otsu(g), connectivity)
        return [(i, int(y), int(x), int(marks[y, x])) for y, x in zip(*np.nonzero(marks), strict=True)]

    return one


def _small(i, g):
    kept = K.without_small(g <= K.otsu(g), 3)
    return [(i, int(y), int(x)) for y, x in zip(*np.nonzero(kept), strict=True)]


def _regions(i, g):
    return [(i, r["label"], r["area"], round(r["eccentricity"], 4) + 0.0) for r in K.regions(g <= K.otsu(g))]


def rollup(spark, sf_dir):
    found = queries()["region_moments"](spark, sf_dir).groupBy("image_id").agg(F.sum("area").alias("area"), rounded(F.avg("eccentricity") + 1e-9, 3).alias("eccentricity"), F.count("*").alias("n"))
    every = gray_images(spark, sf_dir).select("image_id")
    return every.join(found, "image_id", "left").select("image_id", "area", "eccentricity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def flagship(spark, sf_dir):
    """Threshold, masks and texture of every image in one row."""
    masks = _masked(spark, sf_dir).select("image_id", "class_name", "threshold", _area("cell").alias("cell_area"), _area("nucleus").alias("nucleus_area"))
    return masks.join(glcm_masked(spark, sf_dir), "image_id")


def queries():
    pixel = "image_id long, y int, x int"
    made = {
        "manifest_class_map": class_map,
        "path_stem_ext": stems,
        "split_assign": split_assign,
        "split_counts": split_counts,
        "stain_ref_pool": _pool,
        "stain_reference": stain_reference,
        "lab_stats": lab_stats,
        "reinhard_normalize": reinhard,
        "gray_convert": gray_convert,
        "channel_stats": channel_stats,
        "minmax_norm": _pixelwise(lambda: F.col("v")),
        "quantize_u8": lambda s, d: pixels(gray_images(s, d), F.col("g")),
        "otsu_threshold": _thresholds,
        "otsu_masked": otsu_masked,
        "cell_mask_area": cell_area,
        "nucleus_mask_area": nucleus_area,
        "nc_ratio": nc_ratio,
        "central_diff": _pixelwise(lambda: A.central_difference(F.col("v"), FRAME)),
        "laplacian": _pixelwise(lambda: A.stencil(F.col("v"), FRAME, A.LAPLACE)),
        "gaussian_blur": _pixelwise(lambda: A.gaussian(F.col("v"), FRAME, 2.5)),
        "log_response": _pixelwise(lambda: A.log_response(F.col("v"), FRAME, 4.0), 4),
        "hessian_eig": hessian,
        "apc_response": _pixelwise(lambda: A.apc_response(F.col("v"), FRAME, 2.5, 0.6), 5),
        "apc_response_lenient": _pixelwise(lambda: A.apc_response(F.col("v"), FRAME, 1.0, 0.5, lenient=True), 5),
        "hds_step": _pixelwise(lambda: A.hds_step(F.col("v"), F.col("v"), FRAME, *DEFAULT.hds[1:]), 5),
        "bilateral": _pixelwise(lambda: A.bilateral(F.col("v"), FRAME, 3, 0.3, 1.5)),
        "bilateral_d9": _pixelwise(lambda: A.bilateral(F.col("v"), FRAME, 9, 0.3, 3.0)),
        "dilate": _mask_query(lambda m: A.dilated(m, FRAME, 1)),
        "erode": _mask_query(lambda m: A.dilated(m, FRAME, 1, erode=True)),
        "closing": _mask_query(lambda m: A.closed(m, FRAME, 2)),
        "glcm_matrix": glcm_matrix,
        "glcm_props": glcm_props,
        "glcm_masked_props": glcm_masked,
        "edge_overlay": _channels(_overlay),
        "tint_overlay": _channels(_tint),
        "enhance_gain": _channels(_gain),
        "enhance_stretch": _channels(_stretch),
        "edge_map": edge_map,
        "abs_diff_gain": noise_removed,
        "crop_window": crop,
        "otsu_lineitem": otsu_lineitem,
        "glcm_lineitem": glcm_lineitem,
        "components": _images(_labels(8), f"{pixel}, label long"),
        "components_4": _images(_labels(4), f"{pixel}, label long"),
        "drop_small": _images(_small, pixel),
        "region_moments": _images(_regions, "image_id long, label long, area double, eccentricity double"),
        "morphology_rollup": rollup,
    }
    made |= {m: _pixelwise(lambda m=m: A.gradient(F.col("v"), FRAME, m)) for m in ("sobel", "prewitt", "roberts", "scharr")}
    return made | tiles.queries()


def oracle_sql():
    base, q, f = Q.IMAGES, Q.query, Q.final
    mask = f"{base},\n{Q.MASKS}"
    grad = {m: q(base, Q.gradient(m), select=Q.GRADIENT) for m in ("sobel", "prewitt", "roberts", "scharr")}
    lab = f"{base},\n{Q.COLOUR},\n{Q.lab_sql()}"
    stat = "st AS (SELECT image_id, " + ", ".join(f"{fn}({c}) AS {n}_{c}" for n, fn in (("mean", "avg"), ("std", "stddev_pop")) for c in "lab") + " FROM lab GROUP BY image_id)"
    pool = Q.MANIFEST + ",\n" + Q.SPLIT + ",\n" + Q.POOL
    c3 = f"{base},\n{Q.COLOUR},\nmk AS (SELECT *, red > green AS m FROM c3)"
    ch = ("red", "green", "blue")
    shade = lambda e: "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN m THEN CAST(floor({e(c)}) AS INT) ELSE CAST({c} AS INT) END AS {c}" for c in ch) + " FROM mk"
    moved = "SELECT image_id, y, x, " + ", ".join(f"round(least(255e0, greatest(0e0, ({c} - mean_{c}) / (std_{c} + 1e-8) * rs_{c} + rm_{c})), 4) + 0e0 AS {c}" for c in "lab") + " FROM lab JOIN st USING (image_id), (SELECT " + ", ".join(f"avg(mean_{c}) AS rm_{c}, avg(std_{c}) AS rs_{c}" for c in "lab") + " FROM st)"
    stats6 = [f"{n}_{c}" for n in ("mean", "std") for c in "lab"]
    apc = lambda s, e: q(base, Q.hessian(s), Q.unit("ap", "ei", e), select=f("ap", digits=5))
    labelled = lambda near: q(mask, Q.COMPONENTS.format(near=near), select="SELECT image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM root")
    eight, four = "<= 1 AND", "+"
    moments = "mo AS (SELECT image_id, root, CAST(count(*) AS DOUBLE) AS area, var_pop(i // 8) AS a, var_pop(i % 8) AS c, covar_pop(i // 8, i % 8) AS b FROM root GROUP BY ALL),\nrg AS (SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label, area, " + Q.ECCENTRICITY + " AS e FROM mo)"
    regions = (mask, Q.COMPONENTS.format(near=eight), moments)
    return {
        "manifest_class_map": q(Q.MANIFEST, select="SELECT *, CASE class_name WHEN 'Benign' THEN 0 ELSE 1 END AS class_id_binary, CASE class_name WHEN 'Benign' THEN 0 WHEN 'Early' THEN 1 WHEN 'Pre' THEN 2 ELSE 3 END AS class_id_4way FROM mf"),
        "path_stem_ext": r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, lower(regexp_extract(url, '[^/](\.[^./]*)$', 1)) AS ext, lower(replace(split_part(url, '/', 3), 'www.', '')) AS token FROM pages",
        "split_assign": q(Q.MANIFEST, Q.SPLIT, select="SELECT * FROM sp"),
        "split_counts": q("mf AS (SELECT doc_id AS image_id, lang AS class_name FROM documents)", Q.SPLIT, select="SELECT class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM sp GROUP BY class_name"),
        "stain_ref_pool": q(pool, select="SELECT image_id, class_name, split, pool FROM po"),
        "stain_reference": q(lab, stat, pool, "ch AS (SELECT image_id FROM po ORDER BY md5('42:' || CAST(image_id AS VARCHAR)), image_id LIMIT 20)", select="SELECT " + ", ".join(f"round(avg({c}), 4) + 0e0 AS {c}" for c in stats6) + ", count(*) AS n FROM st JOIN ch USING (image_id)"),
        "lab_stats": q(lab, stat, select="SELECT image_id, " + ", ".join(f"round({c}, 4) + 0e0 AS {c}" for c in stats6) + " FROM st"),
        "reinhard_normalize": q(lab, stat, select=moved),
        "gray_convert": q(base, Q.COLOUR, select="SELECT image_id, y, x, CAST(floor((299 * red + 587 * green + 114 * blue + 500) / 1000) AS INT) AS value FROM c3"),
        "channel_stats": q(base, Q.COLOUR, select="SELECT image_id, " + ", ".join(f"round({fn}({c}), 6) + 0e0 AS {n}_{k}" for n, fn in (("mean", "avg"), ("std", "stddev_pop")) for c, k in zip(ch, "RGB", strict=True)) + " FROM c3 GROUP BY image_id"),
        "minmax_norm": q(base, select=f("nm")),
        "quantize_u8": q(base, select="SELECT image_id, y, x, g AS value FROM gr"),
        "otsu_threshold": q(mask, select="SELECT * FROM ot"),
        "otsu_masked": q(mask, select="SELECT * FROM om"),
        "cell_mask_area": q(mask, select="SELECT image_id, count(*) FILTER (v) AS area FROM ce GROUP BY image_id"),
        "nucleus_mask_area": q(mask, select="SELECT image_id, count(*) FILTER (v) AS area FROM nu GROUP BY image_id"),
        "nc_ratio": q(mask, select="SELECT image_id, round(CAST(count(*) FILTER (nu.v) AS DOUBLE) / nullif(count(*) FILTER (ce.v), 0), 6) AS nc_ratio FROM nu JOIN ce USING (image_id, y, x) GROUP BY image_id"),
        "central_diff": q(base, Q.central(), select=f("cd", "sqrt(gx * gx + gy * gy)")),
        "laplacian": q(base, Q.stencil("lp", "nm", "v", Q.LAPLACE), select=f("lp")),
        "gaussian_blur": q(base, Q.gaussian("gs", "nm", "v", 2.5), select=f("gs")),
        "log_response": q(base, Q.gaussian("gs", "nm", "v", 4.0), Q.stencil("lp", "gs", "v", Q.LAPLACE), Q.unit("lo", "lp", "abs(v)"), select=f("lo", digits=4)),
        "hessian_eig": q(base, Q.hessian(1.0), select="SELECT image_id, y, x, round(l1, 6) + 0e0 AS l1, round(l2, 6) + 0e0 AS l2 FROM ei"),
        "apc_response": apc(2.5, "0.6e0 * abs(l2) + 0.4e0 * abs(l1)"),
        "apc_response_lenient": apc(1.0, "abs(l1) + 0.5e0 * abs(l2)"),
        "hds_step": q(base, Q.hds(), select=f("hd", digits=5)),
        "bilateral": q(base, Q.bilateral(3, 0.3, 1.5).replace("GROUP BY a.image_id, a.y, a.x", "GROUP BY a.image_id, a.y, a.x"), select=f("bl")),
        "bilateral_d9": q(base, Q.bilateral(9, 0.3, 3.0), select=f("bl")),
        "dilate": q(mask, Q.disc_sql("di", "ce", "v", 1, "bool_or"), select="SELECT image_id, y, x, v AS value FROM di"),
        "erode": q(mask, Q.disc_sql("er", "ce", "v", 1, "bool_and"), select="SELECT image_id, y, x, v AS value FROM er"),
        "closing": q(mask, Q.disc_sql("di", "ce", "v", 2, "bool_or"), Q.disc_sql("er", "di", "v", 2, "bool_and"), select="SELECT image_id, y, x, v AS value FROM er"),
        "glcm_matrix": q(base, Q.PAIRS.format(name="gl", col="g", src="gr"), select="SELECT image_id, i, j, round(p, 6) AS p FROM gl"),
        "glcm_props": q(base, Q.PAIRS.format(name="gl", col="g", src="gr"), select=Q.TEXTURE.format(key="image_id", src="gl")),
        "glcm_masked_props": q(mask, "mg AS (SELECT image_id, y, x, CASE WHEN v THEN g ELSE 0 END AS g FROM ce)", Q.PAIRS.format(name="gl", col="g", src="mg"), select=Q.TEXTURE.format(key="image_id", src="gl")),
        "edge_overlay": q(c3, select=shade(lambda c: f"least(255e0, {c} * 0.5e0 + {0 if c == 'red' else 128})")),
        "tint_overlay": q(c3, select=shade(lambda c: f"{c} * 0.55e0 + 0.45e0 * {dict(red=255, green=64, blue=0)[c]}")),
        "enhance_gain": q(c3, select=shade(lambda c: f"least(255e0, {c} * 1.5e0)")),
        "enhance_stretch": q(c3, "bd AS (SELECT *, " + ", ".join(f"min({c}) FILTER (m) OVER w AS lo_{c}, max({c}) FILTER (m) OVER w AS hi_{c}" for c in ch) + " FROM mk WINDOW w AS (PARTITION BY image_id))", select="SELECT image_id, y, x, " + ", ".join(f"CASE WHEN m AND hi_{c} > lo_{c} THEN CAST(floor(255 * ({c} - lo_{c}) / (hi_{c} - lo_{c})) AS INT) ELSE CAST({c} AS INT) END AS {c}" for c in ch) + " FROM bd"),
        "edge_map": q(base, Q.gradient("sobel"), select="SELECT image_id, y, x, CASE WHEN round(sqrt((ga.v * ga.v + gb.v * gb.v) / 2), 9) > 0.3e0 THEN 255 ELSE 0 END AS value FROM ga JOIN gb USING (image_id, y, x)"),
        "abs_diff_gain": q(base, Q.stencil("bx", "gr", "g", "VALUES (0, 0, 0.25e0), (0, 1, 0.125e0), (0, -1, 0.125e0), (1, 0, 0.25e0), (1, 1, 0.125e0), (1, -1, 0.125e0)"), select="SELECT image_id, y, x, CAST(floor(least(255e0, 5 * abs(g - round(bx.v, 6)))) AS INT) AS value FROM gr JOIN bx USING (image_id, y, x)"),
        "crop_window": q(base, select="SELECT image_id, y, x, g AS value FROM gr WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"),
        "otsu_lineitem": q("li AS (SELECT l_returnflag, CAST(l_quantity AS INT) AS g FROM lineitem)", Q.OTSU.format(name="ot", key="l_returnflag", level="g", src="li"), select="SELECT * FROM ot"),
        "glcm_lineitem": q("li AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INT) AS g FROM lineitem GROUP BY ALL)", "pr AS (SELECT g AS i, lead(g) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS j FROM li)", "gl AS (SELECT 0 AS k, i, j, CAST(count(*) AS DOUBLE) / sum(CAST(count(*) AS DOUBLE)) OVER () AS p FROM (SELECT i, j FROM pr WHERE j IS NOT NULL UNION ALL SELECT j, i FROM pr WHERE j IS NOT NULL) GROUP BY i, j)", select="SELECT * EXCLUDE (k) FROM (" + Q.TEXTURE.format(key="k", src="gl") + ")"),
        "components": labelled(eight),
        "components_4": labelled(four),
        "drop_small": q(mask, Q.COMPONENTS.format(near=four), select="SELECT image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM root) WHERE n > 3"),
        "region_moments": q(*regions, select="SELECT image_id, label, area, round(e, 4) + 0e0 AS eccentricity FROM rg"),
        "morphology_rollup": q(*regions, select="SELECT vec_id AS image_id, sum(area) AS area, round(avg(round(e, 4)) + 1e-9, 3) + 0e0 AS eccentricity, count(area) AS n FROM embeddings LEFT JOIN rg ON vec_id = image_id GROUP BY vec_id"),
        **grad,
        **tiles_oracle.oracle_sql(),
    }
