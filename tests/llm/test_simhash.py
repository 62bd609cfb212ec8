"""SimHash groups against brute force over all pairs."""

import collections
import random

import numpy as np
import pytest
import xxhash

from vistaspark.llm import simhash
from vistaspark.sources.workspace import Workspace


def plain_fingerprint(text, width=4):
    """The definition, word by word."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=4):
    """Smallest place reachable, from all pairs."""
    prints = np.array(prints, np.uint64)
    label = np.arange(prints.size)
    while True:
        before = label.copy()
        for k in range(prints.size):
            near = np.bitwise_count(prints ^ prints[k]) <= radius
            label[near] = label[near].min()
        if np.array_equal(before, label):
            return label.tolist()


def test_fingerprint_against_its_definition(rows, monkeypatch):
    for text in {r[1] for r in rows}:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 7)
    for text in {r[1] for r in rows if len(r[1] or "") < 3000}:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_spark_hashes_agree(spark):
    one = spark.sql("select hex(xxhash64('a b c é')) h").first().h
    assert int(one, 16) == xxhash.xxh64_intdigest("a b c é".encode(), 42)


def test_groups_against_brute_force(spark, docs, rows, empty):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    marked = [(r[0], plain_fingerprint(r[1])) for r in rows]
    component = plain_components([p for _, p in marked])
    least = collections.defaultdict(list)
    for (i, _), c in zip(marked, component):
        if i is not None:
            least[c].append(i)
    want = collections.Counter((i, f"{p:016x}", min(least[c], default=None)) for (i, p), c in zip(marked, component))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket_rows, values", [(1 << 14, 1 << 22), (16, 500)])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, bucket_rows, values):
    """A family in one ball, chains at distance four, neighbours at distance five, noise; crowded prefixes and values in parts."""
    monkeypatch.setattr(simhash, "_VALUES", values)
    r = random.Random(11)
    flip = lambda p, n: p ^ sum(1 << k for k in r.sample(range(64), n))
    centre = r.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1} | {flip(centre, r.randint(1, 3)) for _ in range(120)} | {r.getrandbits(64) for _ in range(100)}
    for n in (4, 5):
        p = r.getrandbits(64)
        for _ in range(15):
            prints.add(p)
            p = flip(p, n)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    links = simhash.fingerprint_links(frame, Workspace(spark, "test-simhash"), bucket_rows=bucket_rows).collect()
    at = {p: k for k, p in enumerate(signed)}
    label = simhash._merge(np.arange(len(prints)), np.array([at[x.i] for x in links]), np.array([at[x.j] for x in links]))
    assert label.tolist() == plain_components(prints)
    with pytest.raises(ValueError):
        simhash.fingerprint_links(frame, Workspace(spark, "test-simhash"), radius=3)


def test_meeting_loses_nothing_when_values_are_split(monkeypatch):
    r = np.random.default_rng(4)
    prints = np.unique(r.integers(0, 1 << 9, 300).astype(np.uint64) << np.uint64(30))
    whole = simhash._meet(prints, np.full(prints.size, 2), 64, 4)
    assert whole.tolist() == plain_components(prints)
    monkeypatch.setattr(simhash, "_VALUES", 2000)
    assert simhash._meet(prints, np.full(prints.size, 2), 64, 4).tolist() == whole.tolist()
