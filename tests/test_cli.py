"""The command line, end to end on generated photographs."""

import re

import pytest

from tests.test_images import scene
from vistaspark import cli
from vistaspark.progress import progress
from vistaspark.sources import sheets


def csv(folder):
    (part,) = folder.glob("part-*.csv")
    return part.read_text().splitlines()


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli")
    for s in range(2):
        for k, gamma in enumerate((0.7, 1.4)):
            (path / f"s{s}_{k}.png").write_bytes(sheets.png(scene(s, gamma)))
    return path


def test_predict_and_score(spark, photos, tmp_path, capsys):
    assert cli.main(["predict", str(photos), str(tmp_path / "p"), "--max-size", "240", "--features-per-variant", "200"]) == 0
    shown = [int(x) for x in re.findall(r"predict: (\d+)%", capsys.readouterr().out)]
    assert shown[0] == 0 and shown[-1] == 100 and shown == sorted(set(shown))
    rows = csv(tmp_path / "p")
    assert rows == ["filename,group_id", "s0_0.png,0", "s0_1.png,0", "s1_0.png,1", "s1_1.png,1"]
    (tmp_path / "m.csv").write_text("group_id,filename\na,s0_0.png\na,s0_1.png\nb,s1_0.png\nc,s1_1.png\n")
    assert cli.main(["score", str(tmp_path / "p"), str(tmp_path / "m.csv"), "--output", str(tmp_path / "s")]) == 0
    text = capsys.readouterr().out
    assert "predicted_groups=2\nreference_groups=3\nexact_matches=1\nmissed_groups=2\nextra_groups=1\nscore=0.333333" in text
    assert "score=0.333333" in next((tmp_path / "s").glob("part-*")).read_text()


def test_group_of_one_photograph_and_of_none(spark, tmp_path, capsys):
    from tests.test_images import turned_jpeg

    one = tmp_path / "one"
    one.mkdir()
    with pytest.raises(ValueError, match="no images"):
        cli.main(["group", str(one), str(tmp_path / "none")])
    (one / "a.jpg").write_bytes(turned_jpeg(spark, scene(3), 6))
    assert cli.main(["group", str(one), str(tmp_path / "out"), "--max-size", "200", "--features-per-variant", "50"]) == 0
    assert csv(tmp_path / "out/angle_groups") == ["angle_id,filename,representative_filename,group_size,confidence,status", "angle_001,a.jpg,a.jpg,1,1.0000,singleton"]
    assert (tmp_path / "out/review/angle_001.png").exists()


def test_options():
    p = cli.parser()
    a = p.parse_args(["group", "x", "y", "--jobs", "3", "--min-inliers", "9", "--disable-pruning"]) if "--min-inliers" in p._subparsers._group_actions[0].choices["group"].format_help() else p.parse_args(["group", "x", "y", "--jobs", "3", "--disable-pruning"])
    assert a.jobs == 3 and a.disable_pruning and not a.recursive
    with pytest.raises(SystemExit):
        p.parse_args(["score", "x"])


def test_progress_and_threads(spark, monkeypatch):
    told = []
    with progress(spark.sparkContext, "work", told.append, every=0.05):
        spark.range(0, 200, 1, 40).repartition(20).selectExpr("sum(id)").collect()
    assert told[0] == "work: 0%" and told[-1] == "work: 100%" and len(told) == len(set(told))
    with pytest.raises(ZeroDivisionError), progress(spark.sparkContext, "fails", told.append):
        1 / 0
    assert told[-1] == "fails: 0%"
    for name in cli.THREADS:
        monkeypatch.delenv(name, raising=False)
    same = cli.session(None)
    assert {same.conf.get(f"spark.executorEnv.{n}") for n in cli.THREADS} == {"1"}
