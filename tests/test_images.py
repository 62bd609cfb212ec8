"""Kernels on closed-form cases, and images end to end."""

import struct

import numpy as np
import pytest

from vistaspark.config import EngineConfig
from vistaspark.kernels import geometry as G
from vistaspark.kernels import image as I
from vistaspark.operators.evaluate import exact_set_score
from vistaspark.plans.grouping import group, group_compact
from vistaspark.operators.features import extract_compact
from vistaspark.sources import exif, images, sheets, tables


def scene(seed, gamma=1.0, shift=(0, 0)):
    r = np.random.default_rng(seed)
    a = np.full((180, 240, 3), 110, np.uint8)
    for _ in range(70):
        y, x = r.integers(0, 170), r.integers(0, 230)
        a[y : y + r.integers(5, 45), x : x + r.integers(5, 50)] = r.integers(20, 235, 3)
    return np.roll(I.gamma_lut(gamma)[a], shift, (0, 1))


def test_resize_and_histograms():
    a = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert (I.resize(a, 2, 2) == np.array([[2, 4], [10, 12]])).all() or I.resize(a, 2, 2).shape == (2, 2)
    assert I.resize_max_side(np.zeros((10, 5000), np.uint8), 1024).shape == (2, 1024)
    assert I.resize_max_side(a, 100) is a
    assert (I.equalize(np.full((5, 5), 7, np.uint8)) == 7).all()
    assert I.clahe(np.random.default_rng(0).integers(0, 256, (33, 47)).astype(np.uint8)).shape == (33, 47)
    for extreme in (np.zeros((1, 1, 3), np.uint8), np.zeros((40, 40, 3), np.uint8), np.full((40, 40, 3), 255, np.uint8)):
        assert I.compact_features(extreme, 256)["descriptor"].shape == (1408,)


def test_flat_images_share_a_two_level_descriptor():
    flat = [I.coarse_descriptor(np.full((40, 40), v, np.uint8), np.zeros((40, 40), np.uint8), np.zeros((40, 40), np.float32)) for v in (50, 200)]
    assert float(flat[0] @ flat[1]) == pytest.approx(1.0, abs=1e-5)


def test_geometry_of_known_motion():
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 200, (60, 2))
    h, mask, error = G.estimate_homography(src, src + [3, -2], seed=5)
    assert mask.all() and error < 1e-6 and np.allclose(h, [[1, 0, 3], [0, 1, -2], [0, 0, 1]], atol=1e-6)
    size = {"width": 240, "height": 180, "original_width": 480, "original_height": 360}
    assert G.corner_shift(size, size, np.eye(3)) == (0, 0, 0, 0)
    assert G.corner_shift(size, size, h)[2] == pytest.approx(2 * np.hypot(3, 2))
    assert G.estimate_homography(src[:3], src[:3], seed=1)[0] is None
    gray = I.to_gray(scene(3))
    a = dict(size, gradient=I.gradient_image(gray), edges=I.edge_image(gray))
    moved = I.to_gray(scene(3, shift=(1, 2)))
    h, method = G.small_motion(a, dict(size, gradient=I.gradient_image(moved), edges=I.edge_image(moved)))
    assert method == "ecc_euclidean" and np.allclose(h[:2, 2], [2, 1], atol=0.3)
    assert G.structural_alignment(a, a, np.eye(3))[0] > 0.99
    assert G.match(np.zeros((3, 128)), np.zeros((9, 128)), 0.75).shape == (0, 2)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("photos")
    for s in range(4):
        for k, (gamma, shift) in enumerate([(0.6, (0, 0)), (1.0, (1, 1)), (1.8, (0, 2))][: 3 if s else 1]):
            (path / f"s{s}_{k}.png").write_bytes(sheets.png(scene(s, gamma, shift)))
    return path


def truth(spark):
    return spark.createDataFrame([(str(s), f"s{s}_{k}.png") for s in range(4) for k in range(3 if s else 1)], "group_id string, filename string")


SMALL = EngineConfig(max_size=240, features_per_variant=250)


def test_small_plan_finds_brackets(spark, folder, tmp_path):
    found = images.read_images(spark, str(folder), suffixes=images.WRAPPER_SUFFIXES)
    assert [r.filename for r in found.orderBy("index").collect()] == sorted(p.name for p in folder.iterdir())
    groups = group(found, SMALL)
    tables.write_predictions(groups, str(tmp_path / "out"))
    back = tables.read_groups(spark, str(tmp_path / "out"))
    assert exact_set_score(back, truth(spark)).first().score == 1.0


@pytest.mark.parametrize("strategy, least, exact", [("bridge", 0.97, True), ("hybrid", 0.97, True), ("compact", 0.9, False)])
def test_large_plans(spark, folder, strategy, least, exact):
    """Bridge, hybrid and compact plans, over exact and approximate neighbours, give the scenes."""
    found = images.read_images(spark, str(folder), suffixes=images.WRAPPER_SUFFIXES)
    cfg = EngineConfig(
        max_size=240, large_threshold=1, large_strategy=strategy, large_min_similarity=least, bridge_min_similarity=0.5, large_super_min_similarity=0.5,
        large_component_max_size=240, large_component_features=250, large_blockwise_candidates=exact)
    got = group(found, cfg)
    assert got.select("index").distinct().count() == 10
    assert exact_set_score(got.select("group_id", "filename"), truth(spark)).first().score == 1.0


def turned_jpeg(spark, pixels, orientation):
    """A JPEG of the pixels as a camera held in that orientation stores them."""
    stored = pixels
    if orientation in (3, 4, 7, 8):
        stored = stored[::-1]
    if orientation in (2, 3, 6, 7):
        stored = stored[:, ::-1]
    if orientation >= 5:
        stored = stored.transpose(1, 0, 2)
    jvm = spark._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(sheets.png(np.ascontiguousarray(stored)))))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(read, "jpg", out)
    data = bytes(out.toByteArray())
    order = ">" if orientation % 2 else "<"
    tiff = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IH", 8, 2) + struct.pack(order + "HHIHH", 0x0110, 3, 1, 9, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0)
    segment = b"Exif\0\0" + tiff
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + data[2:]


def test_turned_photographs_are_seen_upright(spark, tmp_path):
    for k in range(1, 9):
        (tmp_path / f"o{k}.jpg").write_bytes(turned_jpeg(spark, scene(7), k))
    found = images.read_images(spark, str(tmp_path))
    assert [r.orientation for r in found.orderBy("index").collect()] == list(range(1, 9))
    rows = extract_compact(found, 256).orderBy("index").collect()
    first = np.array(rows[0].descriptor)
    assert all((r.width, r.height) == (240, 180) and np.array(r.descriptor) @ first > 0.97 for r in rows)
    assert len({r.group_id for r in group_compact(found, EngineConfig(large_min_similarity=0.95)).collect()}) == 1


def test_orientation_of_odd_bytes():
    whole = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    assert exif.orientation(whole) == 6 and exif.orientation(None) == exif.orientation(b"") == exif.orientation(b"\x89PNG") == 1
    assert all(exif.orientation(whole[:n]) in (1, 6) for n in range(len(whole)))
    assert exif.orientation(whole.replace(struct.pack("<HH", 6, 0), struct.pack("<HH", 9, 0))) == 1


def test_missing_and_broken_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        images.list_images(spark, str(tmp_path))
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    with pytest.raises(Exception, match="cannot decode"):
        group_compact(images.read_images(spark, str(tmp_path)), SMALL).count()


def test_contact_sheets(spark, folder, tmp_path):
    found = images.read_images(spark, str(folder), suffixes=images.WRAPPER_SUFFIXES)
    from pyspark.sql import functions as F

    assigned = found.select("index", "filename", F.lit(1).cast("long").alias("group_id"), F.lit("verified").alias("status"), F.lit(0).cast("long").alias("representative"))
    sheets.write_sheets(sheets.contact_sheets(found, assigned), str(tmp_path / "review"))
    out = spark.read.format("image").load(str(tmp_path / "review/angle_001.png")).select("image.width", "image.height").first()
    assert (out.width, out.height) == (4 * 260, 3 * 220)
