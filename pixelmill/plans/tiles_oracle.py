"""SQL text for DuckDB that restates the queries of ``plans.tiles``."""

from __future__ import annotations

from pixelmill.plans import oracle as Q

ID = "image_id, y, x"
BLOCK = "(SELECT unnest(range(4)) AS dy), (SELECT unnest(range(4)) AS dx)"
TILES3 = f"t3 AS (SELECT image_id, CAST(y * 4 + dy AS INT) AS y, CAST(x * 4 + dx AS INT) AS x, red, green, blue FROM c3, {BLOCK})"
TILES = "ti AS (SELECT image_id, CAST(y * 4 + dy AS INT) AS y, CAST(x * 4 + dx AS INT) AS x, g FROM gr, " + BLOCK + ")"


def closed(name: str, src: str, radius: int, n: int) -> str:
    """``name`` (image_id, y, x, v): ``src`` closed by a disc, a row of pixels being the bits of a number; erosion is dilation of what isn't set."""
    full = (1 << n) - 1
    grown = lambda m: f"bit_or(CASE WHEN t.dx < 0 THEN ({m}) >> -t.dx ELSE ({m}) << t.dx END) & {full}"
    near = f"FROM {name}_{{0}} a CROSS JOIN ({Q.disc_taps(radius)}) t(dy, dx, w) JOIN {name}_{{0}} b ON b.image_id = a.image_id AND b.y = a.y + t.dy GROUP BY a.image_id, a.y"
    return f"""{name}_0 AS (SELECT image_id, y, CAST(sum(CASE WHEN v THEN CAST(1 AS BIGINT) << x ELSE 0 END) AS BIGINT) AS m FROM {src} GROUP BY image_id, y),
{name}_1 AS (SELECT a.image_id, a.y, {grown("b.m")} AS m {near.format(0)}),
{name}_2 AS (SELECT a.image_id, a.y, {full} - ({grown(f"{full} - b.m")}) AS m {near.format(1)}),
{name} AS (SELECT image_id, y, CAST(x AS INT) AS x, (m >> x) & 1 = 1 AS v FROM {name}_2, (SELECT unnest(range({n})) AS x))"""


def components(name: str, src: str, n: int, corners: bool) -> str:
    """``name`` (image_id, y, x, root): set pixels and the first place of their component, by runs of pixels."""
    by = 1 if corners else 0
    return f"""{name}_r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, min(y * {n} + x) AS id FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM {src} WHERE v) GROUP BY image_id, y, k),
{name}_l AS (SELECT a.image_id, a.id AS a, b.id AS b FROM {name}_r a JOIN {name}_r b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND b.x0 <= a.x1 + {by} AND b.x1 >= a.x0 - {by}),
{name}_c AS (SELECT image_id, id AS a, id AS b FROM {name}_r UNION SELECT c.image_id, c.a, l.b FROM {name}_c c JOIN {name}_l l ON l.image_id = c.image_id AND l.a = c.b),
{name} AS (SELECT r.image_id, y, CAST(unnest(range(x0, x1 + 1)) AS INT) AS x, root FROM {name}_r r JOIN (SELECT image_id, a, min(b) AS root FROM {name}_c GROUP BY image_id, a) m ON m.image_id = r.image_id AND m.a = r.id)"""


def without_small(name: str, src: str, most: int, n: int) -> str:
    """``name`` (image_id, y, x, v): every pixel of ``src``, set where its 4-connected component has more than ``most``."""
    return components(f"{name}_s", src, n, False) + f",\n{name} AS (SELECT s.image_id, s.y, s.x, coalesce(c.n > {most}, false) AS v FROM {src} s LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM {name}_s) c USING ({ID}))"


def masks(src: str, n: int) -> str:
    """cell and nuc (image_id, y, x, v) of byte images ``src`` (image_id, y, x, g)."""
    return ",\n".join(
        [
            Q.OTSU.format(name="t1", key="image_id", level="g", src=src),
            f"c0 AS (SELECT {ID}, g <= threshold AS v FROM {src} JOIN t1 USING (image_id))",
            closed("c1", "c0", 5, n),
            without_small("cell", "c1", 100, n),
            f"c2 AS (SELECT image_id, g FROM {src} JOIN cell USING ({ID}) WHERE v)",
            Q.OTSU.format(name="t2", key="image_id", level="g", src="c2"),
            f"n0 AS (SELECT {ID}, c.v AND coalesce(g < threshold, false) AS v FROM {src} JOIN cell c USING ({ID}) LEFT JOIN t2 USING (image_id))",
            closed("n1", "n0", 3, n),
            without_small("nuc", "n1", 100, n),
        ]
    )


def shapes(name: str, src: str, n: int) -> str:
    """``name`` (image_id, label, area, perimeter, eccentricity, solidity) of the 8-connected regions of ``src``.

    A hull's width in a row is the farthest reach of any chord between its pixels' edge
    midpoints (in half pixels: fy, fx) that crosses the row.
    """
    root = components(f"{name}_p", src, n, True)
    return f"""{root},
{name}_e AS (SELECT p.* FROM {name}_p p LEFT JOIN (SELECT a.image_id, a.y, a.x FROM {name}_p a JOIN {name}_p b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.image_id, a.y, a.x HAVING count(*) = 4) i USING ({ID}) WHERE i.y IS NULL),
{name}_k AS (SELECT a.image_id, a.root, a.y, a.x, sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code FROM {name}_e a JOIN {name}_e b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.image_id, a.root, a.y, a.x),
{name}_q AS (SELECT image_id, root, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1e0 WHEN code IN (21, 33) THEN sqrt(2e0) WHEN code IN (13, 23) THEN (1 + sqrt(2e0)) / 2 ELSE 0e0 END) AS perimeter FROM {name}_k GROUP BY image_id, root),
{name}_f AS (SELECT image_id, root, fy, CAST(min(fx) AS DOUBLE) AS lo, CAST(max(fx) AS DOUBLE) AS hi FROM (SELECT image_id, root, 2 * y + dy AS fy, 2 * x + dx AS fx FROM {name}_p, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx)) GROUP BY image_id, root, fy),
{name}_w AS (SELECT m.image_id, m.root, m.fy, min(CASE WHEN a.fy = b.fy THEN a.lo ELSE a.lo + (b.lo - a.lo) * (m.fy - a.fy) / (b.fy - a.fy) END) AS lo, max(CASE WHEN a.fy = b.fy THEN a.hi ELSE a.hi + (b.hi - a.hi) * (m.fy - a.fy) / (b.fy - a.fy) END) AS hi FROM {name}_f m JOIN {name}_f a ON a.image_id = m.image_id AND a.root = m.root AND a.fy <= m.fy JOIN {name}_f b ON b.image_id = m.image_id AND b.root = m.root AND b.fy >= m.fy WHERE m.fy % 2 = 0 GROUP BY m.image_id, m.root, m.fy),
{name}_h AS (SELECT image_id, root, sum(floor(hi / 2 + 1e-9) - ceil(lo / 2 - 1e-9) + 1) AS hull FROM {name}_w GROUP BY image_id, root),
{name}_m AS (SELECT image_id, root, CAST(count(*) AS DOUBLE) AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM {name}_p GROUP BY image_id, root),
{name} AS (SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label, area, perimeter, {Q.ECCENTRICITY} AS eccentricity, area / hull AS solidity FROM {name}_m JOIN {name}_q USING (image_id, root) JOIN {name}_h USING (image_id, root))"""


def bilateral_bytes(name: str, src: str, columns: list[str], n: int) -> str:
    """``name``: byte images denoised over a disc of diameter 9, colours differing by the sum over channels."""
    apart = " + ".join(f"abs(b.{c} - a.{c})" for c in columns)
    k = f"(t.w * exp(-0.5e0 * pow(({apart}) / 75e0, 2)))"
    taps = "SELECT dy, dx, exp(-0.5e0 * (dy * dy + dx * dx) / (75e0 * 75e0)) AS w FROM (" + Q.disc_taps(4) + ")"
    made = ", ".join(f"CAST(floor(sum({k} * b.{c}) / sum({k}) + 0.5e0) AS INT) AS {c}" for c in columns)
    return f"{name} AS (SELECT a.image_id, a.y, a.x, {made} FROM {src} a CROSS JOIN ({taps}) t JOIN {src} b ON b.image_id = a.image_id AND b.y = {Q.fold('a.y + t.dy', 'mirror', n)} AND b.x = {Q.fold('a.x + t.dx', 'mirror', n)} GROUP BY a.image_id, a.y, a.x)"


def diffused(name: str, src: str, value: str, rounds: int) -> str:
    """``name`` (image_id, u): lists of 64 values in 0..1 after so many diffusion steps."""
    me, first = "u[i]", "f[i]"
    c = lambda d: f"1.3e0 * (1 / (1 + ({d}) * ({d}) / 1e0) + 1 / (abs({d}) + 1e-8)) * ({d})"
    ways = [f"{me} - u[CASE WHEN i > 8 THEN i - 8 ELSE i END]", f"u[CASE WHEN i <= 56 THEN i + 8 ELSE i END] - {me}", f"{me} - u[CASE WHEN i % 8 <> 1 THEN i - 1 ELSE i END]", f"u[CASE WHEN i % 8 <> 0 THEN i + 1 ELSE i END] - {me}"]
    flow = " + ".join(map(c, ways))
    new = f"least(1e0, greatest(0e0, {me} + 0.15e0 * ({flow} - 0.05e0 * ({me} / ({first} + 1e-8) - 1) / ({me} + 1e-8))))"
    return f"""{name}_i AS (SELECT image_id, 0 AS k, list({value} ORDER BY y * 8 + x) AS f, list({value} ORDER BY y * 8 + x) AS u FROM {src} GROUP BY image_id UNION ALL SELECT image_id, k + 1, f, list_transform(range(1, 65), lambda i: {new}) FROM {name}_i WHERE k < {rounds}),
{name} AS (SELECT image_id, u FROM {name}_i WHERE k = {rounds})"""


def response(method: str, strict: bool) -> str:
    """re (image_id, y, x, v): an edge method's response on the 8x8 images."""
    start = "in_ AS (SELECT image_id, y, x, g / 255e0 AS v FROM gr)" if strict else Q.unit("in_", "gr", "CAST(g AS DOUBLE)")
    parts = [start, Q.gaussian("sm", "in_", "v", 1.0)]
    if method == "apc":
        parts += [Q.hessian(1.0, "sm"), Q.unit("re", "ei", "0.5e0 * abs(l2) + 0.5e0 * abs(l1)" if strict else "abs(l1) + 0.5e0 * abs(l2)")]
    elif method == "central":
        parts += [Q.central("sm"), Q.unit("re", "cd", "sqrt(gx * gx + gy * gy)")]
    elif method == "log":
        parts += [Q.gaussian("s2", "sm", "v", 1.0), Q.stencil("lp", "s2", "v", Q.LAPLACE), Q.unit("re", "lp", "abs(v)")]
    else:
        parts += [Q.gradient(method, "sm"), f"gd AS (SELECT {ID}, sqrt((ga.v * ga.v + gb.v * gb.v) / 2) AS v FROM ga JOIN gb USING ({ID}))", Q.unit("re", "gd", "v") if strict else f"re AS (SELECT {ID}, v FROM gd)"]
    return ",\n".join(parts)


def edges(method: str, strict: bool) -> str:
    """re, and bn (image_id, y, x, v): its edges."""
    return ",\n".join([response(method, strict), f"b0 AS (SELECT {ID}, v > 0.3e0 AS v FROM re)", without_small("b1", "b0", 3, 8), closed("bn", "b1", 1, 8)])


def oracle_sql() -> dict[str, str]:
    q, base = Q.query, Q.IMAGES
    area = lambda m: f"SELECT image_id, count(*) FILTER (v) AS area, CAST(coalesce(sum(y * 32 + x) FILTER (v), 0) AS BIGINT) AS places, CAST(coalesce(sum((y * 32 + x) * (y * 32 + x)) FILTER (v), 0) AS BIGINT) AS squares FROM {m} GROUP BY image_id"
    shape = "SELECT image_id, label, area, round(perimeter, 6) AS perimeter, round(eccentricity + 1e-9, 4) + 0e0 AS eccentricity, round(solidity + 1e-9, 6) AS solidity FROM sh"
    colour = f"{base},\n{Q.COLOUR}"
    ch = ["red", "green", "blue"]
    texture = Q.TEXTURE.format(key="image_id", src="gl").replace("(i - j)), 4)", "(i - j)) + 1e-9, 4)")
    spread = ", ".join(f"{f}({c}) AS {n}_{k}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for c, k in zip(ch, "RGB", strict=True))
    numbers = "SELECT i.image_id, s.area AS nucleus_area, round(s.perimeter, 4) AS nucleus_perim, round(s.ecc + 1e-9, 4) + 0e0 AS nucleus_eccentricity, round(s.sol + 1e-9, 4) AS nucleus_solidity, c.n AS cell_area, round(s.area / c.n + 1e-9, 6) AS nc_ratio, glcm_contrast, glcm_energy, glcm_homogeneity, glcm_correlation, " + ", ".join(f"round({n}_{k} + 1e-9, 6) AS {n}_{k}" for n in ("mean", "std") for k in "RGB")
    features = [f"{colour},\n{TILES3}", bilateral_bytes("d3", "t3", ch, 32), f"dn AS (SELECT {ID}, red, green, blue, CAST((299 * red + 587 * green + 114 * blue + 500) // 1000 AS INT) AS g FROM d3)", masks("dn", 32), shapes("sh", "nuc", 32), "an AS (SELECT image_id, bool_or(v) AS held FROM cell GROUP BY image_id)", f"mg AS (SELECT {ID}, CASE WHEN v OR NOT held THEN g ELSE 0 END AS g FROM dn JOIN cell USING ({ID}) JOIN an USING (image_id))", Q.PAIRS.format(name="gl", col="g", src="mg"), f"tx AS ({texture})", "fe AS (" + numbers + f" FROM (SELECT image_id, {spread} FROM dn GROUP BY image_id) i LEFT JOIN (SELECT image_id, sum(area) AS area, sum(perimeter) AS perimeter, avg(eccentricity) AS ecc, avg(solidity) AS sol FROM sh GROUP BY image_id) s USING (image_id) LEFT JOIN (SELECT image_id, CAST(nullif(count(*) FILTER (v), 0) AS DOUBLE) AS n FROM cell GROUP BY image_id) c USING (image_id) JOIN tx USING (image_id))"]
    bars = " UNION ALL ".join(f"SELECT image_id, '{n}' AS metric, {n} AS value, CASE WHEN {n} < 100 THEN printf('%.{d}f', {n} + 1e-9) ELSE CAST(CAST(floor({n}) AS BIGINT) AS VARCHAR) END AS text FROM fe" for n, d in [(n, 2) for n in ("nucleus_area", "nucleus_eccentricity", "nucleus_solidity", "nc_ratio")] + [(n, 3) for n in ("glcm_contrast", "glcm_energy", "glcm_homogeneity", "glcm_correlation")])
    diffused_colour = [diffused(f"h_{c}", "c3", f"{c} / 255", 20) for c in ch]
    back = "SELECT image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, " + ", ".join(f"CAST(floor(h_{c}.u[i] * 255) AS INT) AS {c}" for c in ch) + " FROM h_red JOIN h_green USING (image_id) JOIN h_blue USING (image_id), (SELECT unnest(range(1, 65)) AS i)"
    fits = ", ".join(f"CAST(CASE WHEN w / h > {a}e0 / {b} THEN {a} ELSE floor({b} * (w / h)) END AS INT) AS w{k}, CAST(CASE WHEN w / h > {a}e0 / {b} THEN floor({a} / (w / h)) ELSE {b} END AS INT) AS h{k}" for k, (a, b) in enumerate([(400, 300), (400, 550), (350, 350)]))
    jet = ", ".join(f"CAST(floor(least(1e0, greatest(0e0, 1.5e0 - abs(4 * (level / 255e0) - {k}))) * 255 + 1e-9) AS INT) AS jet_{n}" for k, n in zip((3, 2, 1), ch, strict=True))
    inferno = ", ".join(f"CAST(floor(least(1e0, greatest(0e0, {' + '.join(f'({w!r}) * pow(level / 255e0, {p})' for p, w in enumerate(ws))})) * 255 + 1e-9) AS INT) AS inferno_{n}" for n, ws in zip(ch, Q.INFERNO, strict=True))
    pool = Q.MANIFEST + ",\n" + Q.SPLIT + ",\n" + Q.POOL
    views = lambda strict: q(base, edges("sobel", strict), f"vw AS (SELECT {ID}, g, bn.v AS v, min(g) FILTER (bn.v) OVER w AS lo, max(g) FILTER (bn.v) OVER w AS hi FROM gr JOIN bn USING ({ID}) WINDOW w AS (PARTITION BY image_id))", select="SELECT image_id, CAST(sum(CASE WHEN v THEN floor(g * 0.5e0) + 2 * floor(least(255e0, g * 0.5e0 + 128)) ELSE 3 * g END) AS BIGINT) AS overlay, 765 * count(*) FILTER (v) AS edges, CAST(sum(3 * CASE WHEN NOT v THEN g " + ("WHEN hi > lo THEN floor(255 * (g - lo) / CAST(hi - lo AS DOUBLE)) ELSE g" if strict else "ELSE floor(least(255e0, g * 1.5e0))") + " END) AS BIGINT) AS enhanced FROM vw GROUP BY image_id")
    found = {
        "cell_mask": q(f"{base},\n{TILES}", masks("ti", 32), select=area("cell")),
        "nucleus_mask": q(f"{base},\n{TILES}", masks("ti", 32), select=area("nuc")),
        "region_shapes": q(f"{base},\n{TILES}", masks("ti", 32), shapes("sh", "cell", 32), select=shape),
        "perimeter_solidity": q(f"{base},\n{Q.MASKS}", shapes("sh", "ce", 8), select=shape),
        "pipeline_features": q(*features, select="SELECT * FROM fe"),
        "figure_bars": q(*features, select=bars),
        "figure_layers": q(f"{base},\n{TILES}", masks("ti", 32), pool, "ch AS (SELECT image_id, split FROM po ORDER BY md5('42:' || CAST(image_id AS VARCHAR)), image_id LIMIT 20)", f"ar AS ({area('cell')})", select="SELECT image_id, split, area, places, squares FROM ar JOIN ch USING (image_id)"),
        "bilateral_colour": q(colour, bilateral_bytes("bl", "c3", ch, 8), select=f"SELECT {ID}, red, green, blue FROM bl"),
        "noise_removed_colour": q(colour, bilateral_bytes("bl", "c3", ch, 8), select=f"SELECT {ID}, " + ", ".join(f"CAST(least(255, 3 * abs(c3.{c} - bl.{c})) AS INT) AS {c}" for c in ch) + f" FROM c3 JOIN bl USING ({ID})"),
        "hds_full": q(base, diffused("hd", "gr", "g / 255e0", 200), select="SELECT image_id, round(list_sum(u), 4) AS total FROM hd"),
        "hds_colour": q(colour, *diffused_colour, select=back),
        "unified_sobel": q(base, Q.unit("un", "gr", "CAST(g AS DOUBLE)"), diffused("hd", "un", "v", 200), response("sobel", False), select="SELECT image_id, round(list_sum(u), 4) AS denoised, round(r, 4) AS response FROM hd JOIN (SELECT image_id, sum(v) AS r FROM re GROUP BY image_id) USING (image_id)"),
        "reinhard_rgb": q(f"{colour},\n{Q.lab_sql()}", Q.REINHARD, select=f"SELECT {ID}, red, green, blue FROM bk"),
        "label_tokens": q(Q.MANIFEST, select="SELECT image_id, class_name || '-' || lpad(CAST(image_id AS VARCHAR), 3, '0') AS label, lower(class_name) AS token FROM mf"),
        "aspect_fit": f"SELECT p_partkey, {fits} FROM (SELECT p_partkey, CAST(p_size * 10 AS DOUBLE) AS w, CAST(p_partkey % 300 + 1 AS DOUBLE) AS h FROM part)",
        "colour_maps": f"SELECT CAST(level AS INT) AS level, {jet}, {inferno}, CAST(level AS INT) AS gray FROM (SELECT unnest(range(256)) AS level)",
    }
    for name, strict in (("strict", True), ("lenient", False)):
        for method in ("apc", "central", "log", "sobel", "prewitt", "roberts", "scharr"):
            found[f"detect_edges_{name}_{method}"] = q(base, edges(method, strict), select="SELECT image_id, count(*) FILTER (bn.v) AS n, round(sum(re.v), 5) + 0e0 AS response FROM re JOIN bn USING (image_id, y, x) GROUP BY image_id")
        found[f"edge_views_{name}"] = views(strict)
    return found
