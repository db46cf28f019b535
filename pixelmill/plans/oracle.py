"""SQL text for DuckDB that restates the image queries with joins and windows."""

from __future__ import annotations

IMAGES = """px AS (SELECT vec_id AS image_id, label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
nm AS (SELECT image_id, label, y, x, (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w + 1e-10) AS v FROM px WINDOW w AS (PARTITION BY image_id)),
gr AS (SELECT *, CAST(floor(v * 255) AS INT) AS g FROM nm)"""
OTSU = """{name}_h AS (SELECT {key}, {level} AS g, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY ALL),
{name}_c AS (SELECT {key}, g, sum(n) OVER u AS w0, sum(n * g) OVER u AS m0, sum(n) OVER a AS w, sum(n * g) OVER a AS m FROM {name}_h WINDOW u AS (PARTITION BY {key} ORDER BY g ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {key})),
{name} AS (SELECT {key}, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN w0 > 0 AND w0 < w THEN (m0 * w - m * w0) * (m0 * w - m * w0) / (w0 * (w - w0)) ELSE 0e0 END DESC, g) AS k FROM {name}_c) WHERE k = 1)"""
CLASS = "['Benign', 'Early', 'Pre', 'Pro'][label % 4 + 1]"
SPLIT = """sp0 AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || CAST(image_id AS VARCHAR)), image_id) AS rk, count(*) OVER (PARTITION BY class_name) AS n FROM mf),
sp1 AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, CAST(round_even(n * 0.7e0, 0) AS INT)) END AS tr, CASE WHEN n = 1 THEN 0 ELSE CAST(round_even(n * 0.15e0, 0) AS INT) END AS va FROM sp0),
sp AS (SELECT image_id, class_name, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + CASE WHEN n >= 3 AND n - tr - va < 1 THEN greatest(0, va - 1) ELSE va END THEN 'val' ELSE 'test' END AS split FROM sp1)"""
MANIFEST = f"mf AS (SELECT vec_id AS image_id, {CLASS} AS class_name FROM embeddings)"
COLOUR = """c3 AS (SELECT image_id // 3 AS image_id, y, x, CAST(max(CASE WHEN image_id % 3 = 0 THEN g END) AS DOUBLE) AS red, CAST(max(CASE WHEN image_id % 3 = 1 THEN g END) AS DOUBLE) AS green, CAST(max(CASE WHEN image_id % 3 = 2 THEN g END) AS DOUBLE) AS blue FROM gr GROUP BY ALL HAVING count(*) = 3)"""
LAB = """li AS (SELECT image_id, y, x, lin(red / 255) AS r, lin(green / 255) AS g, lin(blue / 255) AS b FROM c3),
xz AS (SELECT image_id, y, x, (0.412453e0 * r + 0.357580e0 * g + 0.180423e0 * b) / 0.950456e0 AS cx, 0.212671e0 * r + 0.715160e0 * g + 0.072169e0 * b AS cy, (0.019334e0 * r + 0.119193e0 * g + 0.950227e0 * b) / 1.088754e0 AS cz FROM li),
lab AS (SELECT image_id, y, x, CASE WHEN cy > 0.008856e0 THEN 116 * cur(cy) - 16 ELSE 903.3e0 * cy END * 255 / 100 AS l, 500 * (cur(cx) - cur(cy)) + 128 AS a, 200 * (cur(cy) - cur(cz)) + 128 AS b FROM xz)"""


def lab_sql() -> str:
    import re

    text = re.sub(r"lin\((\w+ / 255)\)", r"(CASE WHEN \1 > 0.04045e0 THEN pow((\1 + 0.055e0) / 1.055e0, 2.4e0) ELSE \1 / 12.92e0 END)", LAB)
    text = text.replace("116 * cur(cy) - 16", "116 * pow(cy, 1e0 / 3) - 16")
    return re.sub(r"cur\((\w+)\)", r"(CASE WHEN \1 > 0.008856e0 THEN pow(\1, 1e0 / 3) ELSE 7.787e0 * \1 + 16e0 / 116 END)", text)


def fold(p: str, border: str, n: int = 8) -> str:
    if border == "zero":
        return f"({p})"
    if border == "nearest":
        return f"greatest(0, least({n - 1}, {p}))"
    if border == "mirror":
        m = f"((({p}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2})"
        return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END)"
    m = f"((({p}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END)"


# Taps are written out here, or as SQL that computes them; none comes from the operators under test.
LAPLACE = "VALUES (0, 0, 4e0), (-1, 0, -1e0), (1, 0, -1e0), (0, -1, -1e0), (0, 1, -1e0)"
GRADIENTS = {
    "sobel": "VALUES (-1, -1, 0.125e0), (-1, 0, 0.25e0), (-1, 1, 0.125e0), (1, -1, -0.125e0), (1, 0, -0.25e0), (1, 1, -0.125e0)",
    "prewitt": "VALUES (-1, -1, 1e0 / 6), (-1, 0, 1e0 / 6), (-1, 1, 1e0 / 6), (1, -1, -1e0 / 6), (1, 0, -1e0 / 6), (1, 1, -1e0 / 6)",
    "scharr": "VALUES (-1, -1, 3e0 / 32), (-1, 0, 10e0 / 32), (-1, 1, 3e0 / 32), (1, -1, -3e0 / 32), (1, 0, -10e0 / 32), (1, 1, -3e0 / 32)",
}


def stencil(name: str, src: str, col: str, taps: str, border: str = "reflect", value: str = "sum(t.w * b.{col})", n: int = 8) -> str:
    return f"{name} AS (SELECT a.image_id, a.y, a.x, {value.format(col=col)} AS v FROM {src} a CROSS JOIN ({taps}) t(dy, dx, w) JOIN {src} b ON b.image_id = a.image_id AND b.y = {fold('a.y + t.dy', border, n)} AND b.x = {fold('a.x + t.dx', border, n)} GROUP BY a.image_id, a.y, a.x)"


def gaussian(name: str, src: str, col: str, sigma: float, border: str = "reflect") -> str:
    r = int(4 * sigma + 0.5)
    kernel = f"SELECT CAST(k AS INT) AS k, w / sum(w) OVER () AS w FROM (SELECT k, exp(-0.5e0 * pow(k / {sigma}e0, 2)) AS w FROM (SELECT unnest(range(-{r}, {r} + 1)) AS k))"
    return stencil(f"{name}_y", src, col, f"SELECT k, 0, w FROM ({kernel})", border) + ",\n" + stencil(name, f"{name}_y", "v", f"SELECT 0, k, w FROM ({kernel})", border)


def unit(name: str, src: str, value: str) -> str:
    return f"{name} AS (SELECT image_id, y, x, (q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w + 1e-10) AS v FROM (SELECT *, {value} AS q FROM {src}) WINDOW w AS (PARTITION BY image_id))"


def final(src: str, value: str = "v", digits: int = 6, name: str = "value") -> str:
    return f"SELECT image_id, y, x, round({value}, {digits}) + 0e0 AS {name} FROM {src}"


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def slope(name: str, src: str, axis: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"{name} AS (SELECT image_id, y, x, CASE WHEN {axis} = 0 THEN lead(v) OVER w - v WHEN {axis} = 7 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS v FROM {src} WINDOW w AS (PARTITION BY image_id, {other} ORDER BY {axis}))"


def hessian(sigma: float, src: str = "nm") -> str:
    j = "FROM rr JOIN rc USING (image_id, y, x) JOIN cc USING (image_id, y, x)"
    return ",\n".join([gaussian("gs", src, "v", sigma, "zero"), slope("sy", "gs", "y"), slope("sx", "gs", "x"), slope("rr", "sy", "y"), slope("rc", "sy", "x"), slope("cc", "sx", "x"), f"hs AS (SELECT image_id, y, x, (rr.v + cc.v) / 2 AS m, sqrt(((rr.v - cc.v) / 2) * ((rr.v - cc.v) / 2) + rc.v * rc.v) AS d {j})", "ei AS (SELECT image_id, y, x, m + d AS l1, m - d AS l2 FROM hs)"])


def central(src: str = "nm") -> str:
    return f"cd AS (SELECT *, CASE WHEN x BETWEEN 1 AND 6 THEN (lead(v) OVER r - lag(v) OVER r) / 2 ELSE 0e0 END AS gx, CASE WHEN y BETWEEN 1 AND 6 THEN (lead(v) OVER c - lag(v) OVER c) / 2 ELSE 0e0 END AS gy FROM {src} WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"


def disc_taps(radius: int) -> str:
    span = f"unnest(range(-{radius}, {radius} + 1))"
    return f"SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, 1e0 AS w FROM (SELECT {span} AS dy), (SELECT {span} AS dx) WHERE dy * dy + dx * dx <= {radius * radius}"


def disc_sql(name: str, src: str, col: str, radius: int, agg: str) -> str:
    return stencil(name, src, col, disc_taps(radius), "zero", agg + "(b.{col})")


MASKS = ",\n".join([OTSU.format(name="ot", key="image_id", level="g", src="gr"), "ce AS (SELECT gr.image_id, y, x, g, g <= threshold AS v FROM gr JOIN ot USING (image_id))", "inside AS (SELECT image_id, g FROM ce WHERE v)", OTSU.format(name="om", key="image_id", level="g", src="inside"), "nu AS (SELECT ce.image_id, y, x, g, v AND coalesce(g < threshold, false) AS v FROM ce LEFT JOIN om USING (image_id))"])
COMPONENTS = """on_ AS (SELECT image_id, y, x, y * 8 + x AS i FROM ce WHERE v),
link AS (SELECT a.image_id, a.i AS a, b.i AS b FROM on_ a JOIN on_ b ON a.image_id = b.image_id AND abs(a.y - b.y) {near} abs(a.x - b.x) <= 1),
reach AS (SELECT image_id, a, b FROM link UNION SELECT r.image_id, r.a, l.b FROM reach r JOIN link l ON l.image_id = r.image_id AND l.a = r.b),
root AS (SELECT image_id, a AS i, min(b) AS root FROM reach GROUP BY ALL)"""
PAIRS = """{name}_p AS (SELECT image_id, {col} AS i, lead({col}) OVER (PARTITION BY image_id, y ORDER BY x) AS j FROM {src}),
{name} AS (SELECT image_id, i, j, CAST(count(*) AS DOUBLE) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY image_id) AS p FROM (SELECT image_id, i, j FROM {name}_p WHERE j IS NOT NULL UNION ALL SELECT image_id, j, i FROM {name}_p WHERE j IS NOT NULL) GROUP BY image_id, i, j)"""
TEXTURE = """SELECT {key}, round(sum(p * (i - j) * (i - j)), 4) AS glcm_contrast, round(sqrt(sum(p * p)), 6) AS glcm_energy, round(sum(p / (1 + (i - j) * (i - j))), 6) AS glcm_homogeneity, round(CASE WHEN any_value(var) < 1e-15 THEN 1e0 ELSE sum(p * (i - mu) * (j - mu)) / any_value(var) END, 5) + 0e0 AS glcm_correlation
FROM (SELECT *, sum(p * i * i) OVER w - mu * mu AS var FROM (SELECT *, sum(p * i) OVER w AS mu FROM {src} WINDOW w AS (PARTITION BY {key})) WINDOW w AS (PARTITION BY {key})) GROUP BY {key}"""


def bilateral(diameter: int, sigma_colour: float, sigma_space: float) -> str:
    k = f"t.w * exp({-0.5 / sigma_colour**2!r} * (b.v - a.v) * (b.v - a.v))"
    taps = f"SELECT dy, dx, exp(-0.5e0 * (dy * dy + dx * dx) / ({sigma_space}e0 * {sigma_space}e0)) FROM ({disc_taps(diameter // 2)})"
    return stencil("bl", "nm", "v", taps, "mirror", f"sum({k} * b.v) / sum({k})")


def hds(lam=0.05, dt=0.15, g=1.3, h=1.0, eps=1e-8) -> str:
    c = lambda d: f"({g}e0 * (1e0 / (1e0 + {d} * {d} / {h * h}e0) + 1e0 / (abs({d}) + {eps!r})) * {d})"
    w = "nb AS (SELECT *, v - coalesce(lag(v) OVER r, v) AS dw, coalesce(lead(v) OVER r, v) - v AS de, v - coalesce(lag(v) OVER c, v) AS dn, coalesce(lead(v) OVER c, v) - v AS ds FROM nm WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"
    flow = " + ".join(map(c, ("dn", "ds", "dw", "de")))
    return w + f",\nhd AS (SELECT image_id, y, x, least(1e0, greatest(0e0, v + {dt}e0 * ({flow} - {lam}e0 * (v / (v + {eps!r}) - 1) * (1 / (v + {eps!r}))))) AS v FROM nb)"


def gradient(method: str, src: str = "nm") -> str:
    if method == "roberts":
        down, across = "VALUES (0, 0, 1e0), (-1, -1, -1e0)", "VALUES (0, -1, 1e0), (-1, 0, -1e0)"
    else:
        down = GRADIENTS[method]
        across = f"SELECT dx, dy, w FROM ({down}) g(dy, dx, w)"
    return stencil("ga", src, "v", down) + ",\n" + stencil("gb", src, "v", across)


GRADIENT = "SELECT image_id, y, x, round(sqrt((ga.v * ga.v + gb.v * gb.v) / 2), 6) AS value FROM ga JOIN gb USING (image_id, y, x)"
ECCENTRICITY = "CASE WHEN a + c = 0 THEN 0e0 ELSE sqrt(least(1e0, greatest(0e0, 1 - ((a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)) / ((a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b))))) END"
POOL = "pl AS (SELECT *, CASE WHEN class_name = 'Benign' AND split = 'train' THEN 1 WHEN class_name = 'Benign' THEN 2 WHEN split = 'train' THEN 3 ELSE 4 END AS pool FROM sp),\npo AS (SELECT * FROM pl WHERE pool = (SELECT min(pool) FROM pl))"
# A public polynomial of degree six for each channel of the inferno map.
INFERNO = (
    (0.0002189403691192265, 0.1065134194856116, 11.60249308247187, -41.70399613139459, 77.162935699427, -71.31942824499214, 25.13112622477341),
    (0.001651004631001012, 0.5639564367884091, -3.972853965665698, 17.43639888205313, -33.40235894210092, 32.62606426397723, -12.24266895238567),
    (-0.01948089843709184, 3.932712388889277, -15.9423941062914, 44.35414519872813, -81.80730925738993, 73.20951985803202, -23.07032500287172),
)
_FORWARD = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))


def _inverse(m):
    """A 3x3 matrix's inverse by cofactors."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    whole = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / whole for j in range(3)] for i in range(3)]


def _reinhard() -> str:
    each = lambda f: ", ".join(f(c) for c in "lab")
    back = lambda t: f"CASE WHEN {t} > 0.206893e0 THEN pow({t}, 3) ELSE ({t} - 16e0 / 116) / 7.787e0 END"
    rows = [" + ".join(f"({w!r}) * {c}" for w, c in zip(r, ("wx", "wy", "wz"), strict=True)) for r in _inverse(_FORWARD)]
    gamma = lambda c: f"CAST(least(255, greatest(0, floor((CASE WHEN {c} > 0.0031308e0 THEN 1.055e0 * pow({c}, 1e0 / 2.4e0) - 0.055e0 ELSE 12.92e0 * {c} END) * 255 + 0.5e0))) AS INT)"
    return f"""l8 AS (SELECT image_id, y, x, {each(lambda c: f"least(255e0, greatest(0e0, floor({c} + 0.5e0))) AS {c}")} FROM lab),
s8 AS (SELECT image_id, {each(lambda c: f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}")} FROM l8 GROUP BY image_id),
r8 AS (SELECT {each(lambda c: f"avg(m_{c}) AS rm_{c}, avg(s_{c}) AS rs_{c}")} FROM s8),
mv AS (SELECT image_id, y, x, {each(lambda c: f"floor(least(255e0, greatest(0e0, ({c} - m_{c}) / (s_{c} + 1e-8) * rs_{c} + rm_{c}))) AS {c}")} FROM l8 JOIN s8 USING (image_id), r8),
fy AS (SELECT image_id, y, x, a - 128 AS a, b - 128 AS b, l * (100e0 / 255) AS l FROM mv),
fz AS (SELECT *, CASE WHEN l > 903.3e0 * 0.008856e0 THEN (l + 16) / 116 ELSE 7.787e0 * (l / 903.3e0) + 16e0 / 116 END AS f FROM fy),
xz8 AS (SELECT image_id, y, x, ({back("(f + a / 500)")}) * 0.950456e0 AS wx, CASE WHEN l > 903.3e0 * 0.008856e0 THEN pow(f, 3) ELSE l / 903.3e0 END AS wy, ({back("(f - b / 200)")}) * 1.088754e0 AS wz FROM fz),
li8 AS (SELECT image_id, y, x, {", ".join(f"least(1e0, greatest(0e0, {r})) AS c{k}" for k, r in enumerate(rows))} FROM xz8),
bk AS (SELECT image_id, y, x, {", ".join(f"{gamma(f'c{k}')} AS {n}" for k, n in enumerate(("red", "green", "blue")))} FROM li8)"""


REINHARD = _reinhard()
