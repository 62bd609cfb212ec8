"""Pair requests as a stream: scored once, resumed from the cache."""

from vistaspark.config import Thresholds
from vistaspark.operators.features import extract_features
from vistaspark.sources import images, sheets, tables
from vistaspark.streaming.incremental import score_stream
from tests.test_images import scene


def test_stream_scores_each_pair_once(spark, tmp_path):
    folder = tmp_path / "photos"
    folder.mkdir()
    for k in range(3):
        (folder / f"p{k}.png").write_bytes(sheets.png(scene(k // 2)))
    found = images.read_images(spark, str(folder), suffixes=images.WRAPPER_SUFFIXES).cache()
    features = extract_features(found, 160, 80).cache()
    names = found.select("index", "filename")
    cache = tables.PairCache(spark, str(tmp_path / "cache"), "s")
    asked = str(tmp_path / "asked")
    for pairs in ([(0, 1)], [(1, 0), (1, 2)]):
        spark.createDataFrame(pairs, "i long, j long").write.mode("append").parquet(asked)
        stream = spark.readStream.schema("i long, j long").parquet(asked)
        score_stream(stream, features, names, cache, str(tmp_path / "checkpoint"), Thresholds()).awaitTermination(300)
    rows = spark.read.parquet(cache.path)
    assert rows.count() == 2
    wanted = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "i long, j long")
    got = {tuple(sorted((r.i, r.j))): r.decision for r in cache.load(wanted, names).collect()}
    assert set(got) == {(0, 1), (1, 2)} and got[0, 1] == "verified"
