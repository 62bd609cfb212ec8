"""Spelling variants against brute force over all pairs."""

import collections
import random
import re
import zlib

import pytest

from vistaspark.llm import queries, spelling


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    """Rows by the definition."""
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_apart(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return collections.Counter((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(frame):
    return collections.Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


@pytest.mark.parametrize("alphabet, longest", [("ab", 7), ("abé", 5), ("aß×ÿ", 6)])
def test_variants_against_brute_force(spark, alphabet, longest):
    r = random.Random(len(alphabet))
    n = {"".join(r.choice(alphabet) for _ in range(r.randint(1, longest))): r.choice([1, 2, 5, 9, 25, 60, 300, 1500]) for _ in range(150)}
    frame = spark.createDataFrame([(w, k, "clash", None) for w, k in n.items()], "word string, n long, form string, root string").repartition(3)
    assert got(spelling.variants(frame)) == plain_variants(n)


def test_chains_of_forms_are_followed_to_the_end(spark):
    n = {"aaaaaa" + "b" * k: 6**k for k in range(12)} | {"zzzzzz": 5}
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert all(rows["aaaaaa" + "b" * k].root == "aaaaaa" + "b" * 11 for k in range(12)) and rows["zzzzzz"].root == "zzzzzz" and rows["zzzzzz"].form is None
    with pytest.raises(RuntimeError):
        spelling.follow(spark.createDataFrame([(1, 2), (2, 1)], "id long, form long"), max_rounds=3)


def test_very_long_words_nulls_and_empty_tables(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(60_000))
    n = {long: 50, long[:500] + long[501:]: 5, "x" * 50_000: 5, "x" * 50_001: 30, "alone": 7}
    frame = spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")
    assert got(spelling.variants(frame)) == plain_variants(n)
    assert spelling.variants(frame.limit(0)).count() == 0
    assert spelling.word_keys([])["key"].size == 0


def test_keys_are_those_of_equal_strings():
    words = ["aab", "aabb", "b", "aa", "ba"]
    k = spelling.word_keys(words)
    named = collections.defaultdict(set)
    for row, key, lo in zip(k["row"].tolist(), k["key"].tolist(), k["lo"].tolist()):
        w = words[row]
        named[key].add(w if lo < 0 else w[:lo] + w[lo + 1 :])
    assert all(len(v) == 1 for v in named.values())
    assert len(k["key"]) == sum(1 + len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)


def plain_query(rows):
    """The contract's words from (doc_id, text), counted."""
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_query_against_brute_force(spark, tmp_path, docs, rows, empty):
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    n = plain_query([(r[0], r[1]) for r in rows])
    assert len(n) > 30
    assert got(queries.op11_spelling_variants(spark, f"{tmp_path}/a")) == plain_variants(n)
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_spelling_variants(spark, f"{tmp_path}/b").count() == 0


def test_query_on_a_given_table(spark):
    import pyarrow.parquet as pq

    from tests.conftest import SF

    n = plain_query([(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()])
    assert got(queries.op11_spelling_variants(spark, SF)) == plain_variants(n)
