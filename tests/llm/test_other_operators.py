"""Page extraction, vector search, the pipeline and the registry."""

import collections

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import SCHEMA
from vistaspark.llm import ann, html_extract


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="x">
    <nav><ul><li>menu</li></ul></nav><div class="cookie-banner">cookies</div><header>site</header>
    <main><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
       two&nbsp;x<p>Three<br>four</p><form>f<input></form><!-- c <p>no</p> --><div class="comments"><p>bad</p></div><aside>s</aside></article></main>
    <footer>foot</footer></body></html>"""
    assert html_extract.main_texts([page]) == ["Head & line\nOne bold two x\nThree\nfour"]
    assert html_extract.main_texts([None, "", "<p></p>", "plain &lt;text&gt;", "<article><p>cut off"]) == ["", "", "", "plain <text>", "cut off"]
    assert html_extract.main_texts([]) == []


def test_html_host_boilerplate():
    notice = "Subscribe to our letter and get news of all kinds every single week"
    pages = [f"<div>{notice}</div><p>story {k} " + " ".join(f"w{k}x{j}" for j in range(30)) + "</p>" for k in range(5)]
    assert all("Subscribe" not in t and t.startswith(f"story {k} ") for k, t in enumerate(html_extract.main_texts(pages)))
    inside = [f"<article><p>{notice}</p><p>tale {k} " + " ".join(f"w{k}x{j}" for j in range(9)) + "</p></article>" for k in range(20)]
    assert all(t.startswith(f"tale {k}") for k, t in enumerate(html_extract.main_texts(inside)))
    copies = ["<article><p>" + " ".join(f"c{j}" for j in range(50)) + "</p></article>"] * 5
    assert all(len(t.split()) == 50 for t in html_extract.main_texts(copies))


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(12)]
    owner, pages, ends = html_extract.repeated_runs(streams, 5)
    on = collections.defaultdict(set)
    for s, x in enumerate(streams):
        for i in range(len(x) - 4):
            on[tuple(x[i : i + 5])].add(s)
    at = 0
    for s, x in enumerate(streams):
        for i in range(len(x)):
            assert pages[at + i] == (len(on[tuple(x[i : i + 5])]) if i + 5 <= len(x) else 0)
        at += len(x) + 1


def test_html_table(spark):
    rows = [(1, "https://a.org/x", "<article><p>hi</p></article>", "clash", 2**60 + 1), (None, None, None, None, None), (2, "nonsense", "", "t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, big long")
    out = html_extract.extract_main_text(pages).collect()
    assert collections.Counter((r.page_id, r.main_text, r.main_chars, r.big) for r in out) == collections.Counter([(1, "hi", 2, 2**60 + 1), (None, "", 0, None), (2, "", 0, None)])
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def recall(data, out, k=5):
    """Share of the true k nearest found, by brute force in double precision; scores are exact."""
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in data.collect()]
    m, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    q = ids % 50 == 0
    sims = m[q] @ m.T / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q], axis=1)[:, None]
    sims[np.arange(q.sum()), np.flatnonzero(q)] = -2
    got = collections.defaultdict(dict)
    for r in out:
        got[r.query_id][r.vec_id] = r.score
    of, place = dict(zip(ids[q].tolist(), sims)), {i: k for k, i in enumerate(ids.tolist())}
    assert all(abs(of[i][place[j]] - s) < 1e-12 for i, g in got.items() for j, s in g.items())
    assert all(len(g) == min(k, len(ids) - 1) for g in got.values()) and set(got) == set(of)
    return sum(len(set(got[i]) & set(ids[np.argsort(-s)[:k]].tolist())) for i, s in of.items()) / (k * len(of))


@pytest.mark.parametrize("sf, block_rows", [("0.001", 8192), ("0.1", 8192), ("0.1", 700)])
def test_forest_recall_and_work(spark, sf, block_rows):
    data = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    out = ann.nearest_neighbours(data, data.where("vec_id % 50 = 0"), block_rows=block_rows, query_rows=16).collect()
    assert recall(data, out) >= 0.9
    rows = data.count()
    work = {r.query_id: r.compared for r in out}
    assert sum(work.values()) <= 0.45 * rows * len(work), "products are taken with candidates only"


def test_forest_ties_at_the_last_place_and_long_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(1500)
    rows = [(k, (base if k in (0, 4, 9, 3, 7, 8, 1, 5) else rng.standard_normal(1500)).tolist(), 1.0) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    out = ann.nearest_neighbours(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 3, 4, 5, 7] and len({r.score for r in out}) == 1


def test_forest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [inf, 1.0]), (4, [1.0, None]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, []), (0, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, block string, compared int")
    out = ann.nearest_neighbours(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 5)]
    assert out[0].score == 1.0 and out[3].score == 0.0
    assert ann.nearest_neighbours(v.limit(0), v.limit(0)).count() == 0


@pytest.fixture(scope="module")
def plain(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")


def test_pipeline_stages_take_effect(spark, plain):
    docs, seen = plain, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "").cache()
        assert docs.columns == plain.columns
        seen.append((name, before.count(), docs.count()))
    assert seen[0][2] < seen[0][1] and seen[1][1] == seen[1][2] and seen[2][2] < seen[2][1]
    from vistaspark.llm import jaccard

    kept = jaccard.near_duplicates(corpus_pipeline.near_duplicate_stage(spark, plain, ""))
    assert kept.where("not keeper").count() == 0
    out = corpus_pipeline.token_stage(spark, docs, "")
    assert out.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), "").count() == 0


def test_stages_leave_clashing_columns_alone(spark, docs):
    own = ["pos", "doc", "size", "block", "kept", "key"]
    odd = docs.withColumn("n_words", docs["pos"]).withColumn("line_kept", docs["pos"]).withColumn("h", docs["pos"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns
        assert all(r.pos == r.n_words == r.line_kept == r.h and r.key in ("k", None) for r in out.select(*own, "n_words", "line_kept", "h").collect())


def test_registry_has_all_ten():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
