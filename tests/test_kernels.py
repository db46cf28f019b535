"""Kernels against the column lane, their definitions, and defined edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.functions.params import DEFAULT
from pixelmill.operators import arrays as A
from pixelmill.operators import edges as E
from pixelmill.operators import split as S

SIZES = [(8, 8), (11, 5), (1, 7)]


def lane(spark, image, make):
    df = spark.createDataFrame([(image.astype(float).ravel().tolist(),)], "v array<double>")
    return np.array(df.select(make(F.col("v"), A.Frame(*image.shape)).alias("o")).first().o).reshape(image.shape)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", ["gaussian", "log", "apc", "lenient", "laplace", "hds", "sobel", "prewitt", "scharr", "roberts", "central", "bilateral", "closing"])
def test_kernel_equals_column_expression(spark, size, name):
    image = np.random.default_rng(3).random(size)
    pair = {
        "gaussian": (lambda a: K.gaussian(a, 2.5), lambda v, f: A.gaussian(v, f, 2.5)),
        "log": (lambda a: K.log_response(a, 1.5), lambda v, f: A.log_response(v, f, 1.5)),
        "apc": (lambda a: K.apc_response(a, 1.0), lambda v, f: A.apc_response(v, f, 1.0, 0.6)),
        "lenient": (lambda a: K.apc_response(a, 1.0, 0.5, True), lambda v, f: A.apc_response(v, f, 1.0, 0.5, True)),
        "laplace": (K.laplacian, lambda v, f: A.stencil(v, f, A.LAPLACE)),
        "hds": (lambda a: K.hds(a, 1), lambda v, f: A.hds_step(v, v, f, *DEFAULT.hds[1:])),
        "central": (K.central_difference, A.central_difference),
        "bilateral": (lambda a: K.bilateral(a, 5, 0.3, 2.0), lambda v, f: A.bilateral(v, f, 5, 0.3, 2.0)),
        "closing": (lambda a: K.closed(a > 0.6, 2), lambda v, f: A.closed(F.transform(v, lambda x: x > 0.6), f, 2)),
    }
    kernel, column = pair.get(name) or (lambda a: K.gradient(a, name), lambda v, f: A.gradient(v, f, name))
    np.testing.assert_allclose(lane(spark, image, column), kernel(image), atol=1e-9)


def test_constant_and_bimodal_images():
    flat = np.full((6, 6), 0.4)
    assert not K.unit_range(flat).any() and K.otsu(np.full((4, 4), 9, np.uint8)) == 9
    two = np.array([[10] * 4, [200] * 4], np.uint8)
    assert K.otsu(two) == 10
    assert K.texture(np.full((5, 5), 7, np.uint8)) == (0.0, 1.0, 1.0, 1.0)


def test_components_and_small_objects():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 0]], bool)
    assert K.labelled(m, 8)[1] == 3 and K.labelled(m, 4)[1] == 4
    assert K.without_small(m, 2).sum() == 3 and K.without_small(m, 1, 8).sum() == 7
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert K.labelled(snake, 4)[1] == 1


def test_closing_is_extensive_and_idempotent():
    m = np.random.default_rng(1).random((30, 30)) > 0.8
    once = K.closed(m, 3)
    assert (once | ~m).all() and (K.closed(once, 3) == once).all()


def test_regions_of_known_shapes():
    box = np.zeros((20, 30), bool)
    box[4:14, 5:25] = True
    (r,) = K.regions(box)
    assert r["area"] == 200 and r["solidity"] == 1.0 and r["perimeter"] == 56.0
    assert r["eccentricity"] == pytest.approx(np.sqrt(1 - 99 / 399), abs=1e-9)  # variances of 10 and 20 places: 99/12 and 399/12
    line, dot, ell = np.zeros((5, 9), bool), np.zeros((3, 3), bool), np.zeros((4, 4), bool)
    line[2, 1:8] = dot[1, 1] = ell[1:3, 1] = ell[2, 2] = True
    assert K.regions(line)[0]["eccentricity"] == 1 and K.regions(dot)[0]["eccentricity"] == 0
    assert K.regions(ell)[0]["eccentricity"] == pytest.approx(np.sqrt(1 - 1 / 3))  # variances 2/9, covariance 1/9 by hand
    assert K.regions(np.eye(6, dtype=bool))[0]["eccentricity"] == pytest.approx(1)
    assert all(np.isnan(x) for x in K.morphology(np.zeros((4, 4), bool)))


def test_glcm_is_symmetric_and_sums_to_one():
    p = K.glcm(np.random.default_rng(2).integers(0, 256, (9, 12)).astype(np.uint8))
    assert np.allclose(p, p.T) and p.sum() == pytest.approx(1)


def test_hds_stays_in_range():
    out = K.hds(np.random.default_rng(0).random((12, 12)), 25)
    assert out.min() >= 0 and out.max() <= 1


def test_colour_round_trip():
    rgb = np.random.default_rng(5).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert np.abs(K.rgb_of_lab8(K.lab_of(rgb)).astype(int) - rgb).max() <= 1
    assert np.abs(K.rgb_of_lab8(K.lab8_of(rgb)).astype(int) - rgb).mean() <= 1.5  # bytes of Lab are coarse
    assert np.allclose(K.lab_of(np.array([[[255, 255, 255]]], np.uint8)), [[[255, 128, 128]]], atol=0.1)


def test_edges():
    rgb = np.zeros((24, 24, 3), np.uint8)
    rgb[:, 12:] = 200
    for dialect in ("strict", "lenient"):
        for m in E.METHODS:
            binary, response = E.detect_edges(rgb, m, 0.05, dialect=dialect, min_size=4, close=1)
            assert binary[5:19, 9:15].any() and response.shape == (24, 24), (dialect, m)
        assert set(E.edge_views(rgb, binary, response, dialect)) == {"overlay", "edges", "response", "enhanced"}
    with pytest.raises(ValueError, match="unknown"):
        E.detect_edges(rgb, "nope")
    assert (E.detect_edges(rgb, "nope", dialect="lenient")[1] == E.detect_edges(rgb, "sobel", dialect="lenient")[1]).all()
    with pytest.raises(ValueError, match="unknown"):
        K.denoised(rgb, "nope", DEFAULT)
    assert E.unified(rgb, iterations=2)["coloured"].shape == rgb.shape


def test_split_sizes(spark):
    want = {1: (1, 0, 0), 2: (1, 0, 1), 3: (2, 0, 1), 4: (3, 0, 1), 5: (4, 0, 1), 7: (5, 1, 1), 10: (7, 2, 1), 15: (10, 2, 3), 20: (14, 3, 3), 100: (70, 15, 15)}
    rows = [(f"{n}-{i}", str(n)) for n in want for i in range(n)]
    got = {int(r.class_name): (r.train, r.val, r.test) for r in S.split_counts(S.split(spark.createDataFrame(rows, "image_id string, class_name string"))).collect()}
    assert got == want
    same = S.split_compatible([(a, b) for a, b in rows])
    for n, sizes in want.items():
        held = [same[a] for a, b in rows if b == str(n)]
        assert tuple(map(held.count, ("train", "val", "test"))) == sizes
    nested = S.by_parts([("r/Early/a-b/x.png", "Early"), ("r/Early/a/x.png", "Early"), ("r/Benign/z.png", "Benign")])
    assert nested == [("r/Benign/z.png", "Benign"), ("r/Early/a/x.png", "Early"), ("r/Early/a-b/x.png", "Early")]
    golden = S.split_compatible([("Early-012", "Early"), ("Pro-002", "Pro"), ("Pro-003", "Pro")])
    assert golden == {"Early-012": "train", "Pro-002": "test", "Pro-003": "train"}


def test_reference_pool_cascades(spark):
    def pool(*rows):
        return {r.image_id for r in S.reference_pool(spark.createDataFrame(rows, "image_id string, class_name string, split string")).collect()}

    assert pool(("a", "Benign", "train"), ("b", "Benign", "test"), ("c", "Pro", "train")) == {"a"}
    assert pool(("b", "Benign", "test"), ("c", "Pro", "train")) == {"b"}
    assert pool(("c", "Pro", "train"), ("d", "Pro", "test")) == {"c"}
    assert pool(("d", "Pro", "test")) == {"d"}
