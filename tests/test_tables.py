"""The pair cache and the files, infinite values included."""

from pyspark.sql import functions as F

from vistaspark.schemas import PAIR_SCORE
from vistaspark.sources import tables

ROW = dict(i=0, j=1, filename_a="a", filename_b="b", decision="reject", confidence=0.5, good_matches=3, ransac_inliers=0, inlier_ratio=0.0, median_reprojection_error=float("inf"), avg_corner_shift_ratio=float("inf"), max_corner_shift_ratio=1.0, avg_corner_shift_pixels=1.0, max_corner_shift_pixels=1.0, edge_score=0.1, gradient_score=0.1, method="none", reason="no_homography")


def scores(spark, *changes):
    return spark.createDataFrame([tuple((ROW | c).values()) for c in changes], PAIR_SCORE)


def test_cache_keeps_the_last_of_wanted_rows(spark, tmp_path):
    images = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "index long, filename string")
    pairs = spark.createDataFrame([(0, 1), (2, 1)], "i long, j long")
    cache = tables.PairCache(spark, str(tmp_path / "cache"), "s1")
    assert cache.load(pairs, images).count() == 0
    cache.append(scores(spark, {}, {"i": 2, "j": 1, "filename_a": "c", "confidence": 0.7}, {"i": 0, "j": 2, "filename_b": "c"}, {"i": 1, "j": 0, "filename_a": "wrong", "filename_b": "a"}))
    cache.append(scores(spark, {"i": 1, "j": 0, "filename_a": "b", "filename_b": "a", "confidence": 0.9}))
    tables.PairCache(spark, str(tmp_path / "cache"), "s2").append(scores(spark, {"confidence": 0.1}))
    got = {(r.i, r.j): r.confidence for r in cache.load(pairs, images).collect()}
    assert got == {(1, 0): 0.9, (2, 1): 0.7}


def test_infinite_values_survive_csv(spark, tmp_path):
    path = str(tmp_path / "scores")
    scores(spark, {}).write.option("header", "true").option("positiveInf", "inf").csv(path)
    (tmp_path / "scores" / "part-x.csv").write_text("i,j\nbroken,row\n")
    got = tables.read_pair_scores(spark, path).collect()
    assert len(got) == 1 and got[0].median_reprojection_error == float("inf")
    tables.write_pair_scores(scores(spark, {}), str(tmp_path / "report"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "report")).where(F.col("confidence") == "0.5000").count() == 1


def test_malformed_rows_are_counted_and_empty_texts_kept(spark, tmp_path):
    names = list(ROW)
    good = {n: str(v) for n, v in ROW.items()} | {"reason": ""}
    changes = [{}, {"i": "x"}, {"confidence": ""}, {"good_matches": "3.0"}, {"j": " 7 "}, {"edge_score": "nan"}, {"method": ""}, {"filename_a": "a, b"}]
    quoted = lambda v: f'"{v}"' if "," in v else v
    lines = [",".join(reversed(names))] + [",".join(quoted((good | c)[n]) for n in reversed(names)) for c in changes] + ["short,row"]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    report = {}
    got = tables.read_pair_scores(spark, str(tmp_path / "s.csv"), report).collect()
    assert report == {"malformed": 4} and sorted((r.j, r.method, r.filename_a, r.reason) for r in got) == [(1, "", "a", ""), (1, "none", "a", ""), (1, "none", "a", ""), (1, "none", "a, b", ""), (7, "none", "a", "")]
