"""Cross-parsing of whole texts, sparse automata, samples, ties and clashes."""

import random
import re

import pytest

from vistaspark.llm import langid


def greedy(sample, text):
    """Phrases of the greedy parse of text by longest matches in sample; foreign letters stand alone."""
    phrases = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


@pytest.mark.parametrize("segment", [3, 16, 512])
def test_whole_text_is_one_parse(segment):
    r = random.Random(segment)
    for seed in range(4):
        sample = re.sub(" +", " ", "".join(r.choice("abc ") for _ in range(300)))
        parser = langid.Parser({"x": sample}, segment=segment)
        texts = [re.sub(" +", " ", "".join(r.choice("abcd ") for _ in range(r.randint(0, 200)))) for _ in range(30)] + ["ab" * 200, "a" * 333, sample * 3, ""]
        costs, _ = parser.costs(texts)
        assert [round(c / parser.bits[0]) for c in costs[:, 0]] == [greedy(sample, t) for t in texts]


def test_large_alphabets_stay_small():
    r = random.Random(8)
    han = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(20_000))
    parser = langid.Parser({"zh": han, "en": "the cat sat on the mat " * 50})
    assert sum(a.nbytes for m in parser.tables for a in m) < 4_000_000
    assert parser.predict([han[100:400], "the mat sat", "Привет", "123", None]) == [("zh", pytest.approx(1, abs=0.2)), ("en", pytest.approx(0.5, abs=0.5)), ("en", pytest.approx(0.5, abs=0.5)), ("und", 0.0), ("und", 0.0)]


def test_samples_hold_distinct_whole_texts(spark):
    rows = [("aa", f"text number {k % 3} of the copies")  for k in range(200)] + [("aa", f"rare words {k} here") for k in range(5)]
    rows += [("bb", "y" * 9000), ("cc", "short one"), ("cc", "z" * 9000), ("dd", None), ("dd", ""), (None, "no language")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = langid.sample_languages(frame, docs_per_lang=8, doc_chars=4000)
    assert sorted(got) == ["aa", "bb", "cc"] and all(t in got["aa"] for _, t in rows[:205]) and len(got["aa"]) < 400
    assert got["bb"] == "y" * 4000 and got["cc"] == "short one " + "z" * 4000
    assert langid.sample_languages(frame, docs_per_lang=8) == got
    assert len(langid.sample_languages(frame, docs_per_lang=2)["aa"].split("text number")) <= 3


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "abab abab", "old", 0.5), (1, "abab abab", "old", 0.5), (2, None, None, None), (3, "?!", "x", 1.0), (4, "ab " * 40_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, h double")
    out = langid.identify(docs, {"second": "abab", "first": "abab"}).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred, r.lang_score, r.h) for r in out] == [(1, "first", 0.0, 0.5), (1, "first", 0.0, 0.5), (2, "und", 0.0, None), (3, "und", 0.0, 1.0), (4, "first", 0.0, 1.0)]


def test_long_runs_of_one_letter_take_linear_time():
    import time

    sample = " ".join(["aaa baa aab"] * 20)
    parser, other = langid.Parser({"x": sample, "y": "some other words here"}), langid.Parser({"x": sample, "y": "some other words here"})
    other.segment = 1 << 21
    r = __import__("random").Random(4)
    for text in ("a" * 20_000, "a" * 5000 + " word " + "ab" * 9000, "".join(r.choice("ab ") for _ in range(30_000))):
        assert (parser.costs([text, "aa b", text[:700]])[0] == other.costs([text, "aa b", text[:700]])[0]).all()
    took = []
    for n in (250_000, 1_000_000):
        began = time.perf_counter()
        parser.predict(["a" * n])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] and took[1] < 15, took


def test_samples_hold_whole_texts(spark):
    long, short = "lang " * 3000, "kurz und gut"
    rows = [("de", long), ("de", short), ("de", short), ("fr", "bref " * 2000)]
    found = langid.sample_languages(spark.createDataFrame(rows, "lang string, text string"), doc_chars=100)
    assert found == {"de": f"{short} {long}", "fr": "bref " * 2000}
