"""Labels in contact sheets, pages of large groups, files written by tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.sources import files, sheets


def decoded(spark, path):
    r = spark.read.format("image").load(path).select("image.*").first()
    return np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)


@pytest.fixture(scope="module")
def photos(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"/p/{k}.png", f"{'wide name of a photograph ' if k == 1 else ''}{k:03d}é☃.png", 6, 8, 3, rng.integers(0, 255, 144).astype(np.uint8).tobytes(), 1) for k in range(9)]
    return spark.createDataFrame(rows, "index long, path string, filename string, height int, width int, channels int, data binary, orientation int").repartition(3)


def assigned(photos, group="1"):
    return photos.select("index", "filename", F.expr(group).cast("long").alias("group_id"), F.lit("verified").alias("status"), F.lit(0).cast("long").alias("representative"))


def test_labels_are_in_the_pixels(spark, photos, tmp_path):
    sheets.write_sheets(sheets.contact_sheets(photos, assigned(photos)), str(tmp_path))
    sheet = decoded(spark, str(tmp_path / "angle_001.png"))
    font = sheets.glyphs(spark)
    names = sorted(r["filename"] for r in photos.collect())
    assert (font["a"] != 0).any() and not (font[" "] != 0).any() and (font["a"].shape != font["b"].shape or (font["a"] != font["b"]).any())
    for k, name in enumerate(names):
        y, x = k // 4 * sheets.CELL_HEIGHT, k % 4 * sheets.CELL_WIDTH
        strip = sheet[y + sheets.CELL_HEIGHT - sheets.STRIP : y + sheets.CELL_HEIGHT - 4, x + 8 : x + sheets.CELL_WIDTH - 8, 0]
        label = ("* " if name.startswith("000") else "") + name[:34]
        ink = np.concatenate([font.get(c, font["?"]) for c in label], 1)[: sheets.STRIP - 4, : sheets.CELL_WIDTH - 16]
        wanted = np.rint(245 - (245 - 20) * (ink / 255.0))
        assert np.abs(strip[:, : ink.shape[1]].astype(float) - wanted).max() <= 1
        assert (strip[:, ink.shape[1] :] == 245).all()
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("_writing")]


def test_large_groups_have_more_sheets(spark, photos, monkeypatch):
    monkeypatch.setattr(sheets, "PAGE_IMAGES", 4)
    out = {r["name"]: r["labels"] for r in sheets.contact_sheets(photos, assigned(photos, "if(index < 8, 1, 2)")).select("name", "labels").collect()}
    assert set(out) == {"angle_001.png", "angle_001_p2.png", "angle_002.png"}
    names = sorted(r["filename"] for r in photos.where("index < 8").collect())
    assert [x.removeprefix("* ") for x in out["angle_001.png"] + out["angle_001_p2.png"]] == [n[:34] for n in names]
    assert sheets.contact_sheets(photos.limit(0), assigned(photos.limit(0))).count() == 0


def test_files_replace_theirs_and_leave_others(spark, tmp_path):
    (tmp_path / "other").write_bytes(b"stays")
    (tmp_path / "f3").write_bytes(b"goes")
    rows = spark.range(20).select(F.format_string("f%d", "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(5)
    files.write_files(rows, f"file://{tmp_path}")
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {f"f{k}": str(k).encode() for k in range(20)} | {"other": b"stays"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = spark.range(8).select(F.format_string("g%d", "id").alias("name"), F.when(F.col("id") == 5, F.raise_error("lost").cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken.repartition(4), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
