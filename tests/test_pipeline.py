"""End to end over files: scan, split, transform, sinks, incremental ingestion."""

from dataclasses import replace

import numpy as np
import pytest

from pixelmill.functions.params import DEFAULT, FEATURES
from pixelmill.plans import pipeline
from pixelmill.sources import images, sinks
from pixelmill.streaming.ingest import ingest


def synthetic(side=128, seed=0):
    """A cell on a light field: an oval with a darker disc inside, and noise, as RGB."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side] - side // 2
    rgb = np.full((side, side, 3), (214, 196, 171), np.int64)
    rgb[y * y + x * x <= 30 * 30] = (131, 66, 122)
    rgb[y * y + x * x <= 12 * 12] = (63, 21, 58)
    return np.clip(rgb + rng.integers(-9, 10, rgb.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("raw")
    for k, name in enumerate(("Benign", "Early", "Pre", "Pro")):
        (top / name / "deep").mkdir(parents=True)
        (top / name / f"{name}-1.png").write_bytes(images.png(synthetic(seed=k)))
    (top / "Pro" / "deep" / "Pro-2.PNG").write_bytes(images.png(synthetic(seed=9)))
    (top / "Pro" / "note.txt").write_text("no image")
    (top / "pro").mkdir()
    (top / "pro" / "x.png").write_bytes(images.png(synthetic()))
    return top


@pytest.fixture(scope="module")
def result(spark, root, tmp_path_factory):
    return pipeline.run(spark, str(root), str(tmp_path_factory.mktemp("out")))


def test_features(result):
    assert result["status"] == 0 and result["errors"].isEmpty()
    rows = result["features"].collect()
    assert len(rows) == 5 and result["features"].columns == [c.split()[0] for c in FEATURES.split(", ")]
    for r in rows:
        assert r.nc_ratio == r.nucleus_area / r.cell_area
        assert abs(r.cell_area - 2821) < 200 and abs(r.nucleus_area - 441) < 120
        assert r.nucleus_eccentricity < 0.3 and r.nucleus_solidity > 0.9
        assert float(r.mean_R * 128 * 128).is_integer() and 0 < r.glcm_energy < 1
    assert {r.image_id for r in rows} == {"Benign-1", "Early-1", "Pre-1", "Pro-1", "Pro-2"}


def test_layers_and_sinks(spark, result, tmp_path):
    layers = result["layers"]
    for row in layers.collect():
        a = sinks.arrays_of(row)
        assert a["rgb"].shape == (128, 128, 3) and a["apc"].dtype == np.float32 and 0 <= a["log"].min() <= a["log"].max() <= 1 and a["cell_mask"][64, 64]
    sinks.write_layers(layers, str(tmp_path / "layers"))
    assert sinks.read_layers(spark, str(tmp_path / "layers")).where("split = 'train'").count() == layers.where("split = 'train'").count()
    sinks.write_files(sinks.npz_files(layers), str(tmp_path / "npz"))
    assert sorted(map(tuple, sinks.read_npz(spark, str(tmp_path / "npz")).select("image_id", "split", "height", "rgb").collect())) == sorted(map(tuple, layers.select("image_id", "split", "height", "rgb").collect()))
    assert sinks.layer_pictures(layers).count() == 30 and sinks.previews(layers).count() == 5
    sinks.write_csv(result["features"], str(tmp_path / "csv"))
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path / "csv"), FEATURES).collect())) == sorted(map(tuple, result["features"].collect()))
    assert sinks.run_record(spark, 1, {"a": 2}).count() == 1


def test_failures_and_empty_input(spark, root, tmp_path):
    (tmp_path / "raw" / "Pre").mkdir(parents=True)
    (tmp_path / "raw" / "Benign").mkdir()
    (tmp_path / "raw" / "Pre" / "bad.png").write_bytes(b"no image at all")
    (tmp_path / "raw" / "Benign" / "good.png").write_bytes(images.png(synthetic()))
    got = pipeline.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert got["status"] == 3 and [r.image_id for r in got["errors"].collect()] == ["bad"] and got["features"].count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert pipeline.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"))["status"] == 1
    assert pipeline.run(spark, str(root), str(tmp_path / "out3"), dry=True, compatible=True)["manifest"].count() == 5
    table = spark.createDataFrame([("a", "p1", "train"), ("a", "p2", "train"), ("b", "p3", "test")], "image_id string, orig_path string, split string")
    assert [r.image_id for r in pipeline.duplicates(table).collect()] == ["a"]


def test_equal_names_stay_apart(spark, tmp_path):
    for k, name in enumerate(("Benign", "Early", "Pro")):
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "raw" / name / "same.png").write_bytes(images.png(synthetic(64, k)))
    (tmp_path / "raw" / "Early" / "gray.png").write_bytes(images.png(synthetic(64, 5)[..., 0]))
    got = pipeline.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert sorted((r.image_id, r.class_name) for r in got["features"].collect()) == [("gray", "Early"), ("same", "Benign"), ("same", "Early"), ("same", "Pro")]
    assert {r.image_id: r.n for r in got["duplicates"].collect()}.keys() <= {"same"} and got["status"] == 0
    unchanged = {r.orig_path[-8:]: images.channels_of(r.data, r.height, r.width, r.channels).shape for r in images.decoded(spark, str(tmp_path / "raw")).collect()}
    assert unchanged["gray.png"] == (64, 64) and unchanged["same.png"] == (64, 64, 3)


def test_any_failure_is_one_images(spark, monkeypatch, tmp_path):
    (tmp_path / "raw" / "Pro").mkdir(parents=True)
    for k in range(2):
        (tmp_path / "raw" / "Pro" / f"{k}.png").write_bytes(images.png(synthetic(64, k)))
    got = pipeline.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), replace(DEFAULT, denoise="nope"))
    assert got["status"] == 3 and sorted(r.error.split(":")[0] for r in got["errors"].collect()) == ["ValueError", "ValueError"]


def test_streamed_files_are_taken_once(spark, root, tmp_path):
    for _ in range(2):
        ingest(spark, str(root), str(tmp_path / "table"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_diagnosis():
    found = pipeline.diagnosed(synthetic(32))
    assert set(found) == {"raw", "stain", "bilateral", "hds20", "hds200"} and found["bilateral"][1] <= found["raw"][1]
