"""The levelled exchange against plain sums, and its number of messages."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from vistaspark.llm import blocks as B
from vistaspark.sources.workspace import Workspace


def _answer(keys, data):
    return {"total": data["n"], "owned": np.ones(keys.size, bool)}, {"kinds": int(keys.size), "all": int(data["n"].sum())}


@pytest.mark.parametrize("blocks, fan_bits", [(1, 4), (16, 4), (17, 4), (60, 4), (300, 4), (20, 2), (9, 8), (300, 8)])
def test_exchange_adds_up_and_sends_messages_in_proportion(spark, blocks, fan_bits):
    M = B.Sums({"n": "i8"}, {"total": "i8", "owned": "u1"}, _answer, ("kinds", "all"), keeps=True, fan_bits=fan_bits)  # noqa: N806

    def data(b):
        rng = np.random.default_rng(b)
        some = np.unique(np.concatenate([rng.integers(0, 1 << 63, 40), np.arange(1, 6) << 59])).astype(np.uint64)
        return {"keys": some if b % 7 else some[:0], "n": rng.integers(1, 9, some.size)[: some.size if b % 7 else 0]}

    def ask(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                yield from B.as_table(B.messages(M, b, data(b)), B.asked_fields(M)).to_batches()

    work = Workspace(spark, "exchange-test")
    asked = spark.range(blocks).mapInArrow(ask, B.asked_schema(M)).cache()
    replies, extra, kept = B.exchange_and_keep(work, "x", asked, blocks, M)
    of = collections.defaultdict(list)
    for r in replies.collect():
        of[r["block"]].append(r.asDict())
    want = collections.Counter()
    for b in range(blocks):
        d = data(b)
        want.update(dict(zip(d["keys"].tolist(), d["n"].tolist())))
    owners = collections.Counter()
    for b in range(blocks):
        d, got = data(b), M.take(of[b])
        assert got["total"].tolist() == [want[k] for k in d["keys"].tolist()]
        owners.update(k for k, o in zip(d["keys"].tolist(), got["owned"]) if o)
    assert set(owners) == set(want) and set(owners.values()) <= {1}
    assert extra == ({"kinds": len(want), "all": sum(want.values())} if want else extra)
    assert asked.count() <= blocks << fan_bits and sum(map(len, of.values())) <= blocks << fan_bits
    stored = [dict(zip(B.unpack_sorted(r["keys"], "u8").tolist(), B.unpack_sorted(r["total"], "i8").tolist())) for r in kept.collect()]
    assert {k: n for s in stored for k, n in s.items()} == dict(want) and sum(map(len, stored)) == len(want)


def test_levels_grow_with_the_logarithm():
    assert [B.levels_of(n) for n in (1, 16, 17, 256, 257, 10**7)] == [1, 1, 2, 2, 3, 6]


def test_packing():
    rng = np.random.default_rng(0)
    for dtype in ("u1", "u4", "u8", "i8", "f8"):
        x = np.sort(rng.integers(0, 200, 1000)).astype(dtype)
        assert (B.unpack_sorted(B.pack_sorted(x), dtype) == x).all() and B.unpack_sorted(B.pack_sorted(x[:0]), dtype).size == 0
    keys = np.sort(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    assert len(B.pack_sorted(keys)) < 7 * keys.size
