"""Blocks of documents and packed exchanges between them.

Counting over a corpus (n-grams, shingles, substrings) means shuffling about as
many keys as there are tokens.  Here documents lie in blocks of bounded size, and
a block sends its *distinct* keys once, as packed sorted arrays.

Blocks and key ranges both grow with the corpus, so a message from every block to
every range would grow with its square.  ``exchange`` therefore goes by levels
(a butterfly): about 16 blocks form a group, which merges their keys and deals
them into 16 ranges; 16 groups that hold the same range merge and deal it into 16
finer ones, and so on, until one unit holds all of a range.  Every unit sends and
receives about 16 messages and holds about as many keys as a block, and equal keys
are one from the first level on, so a frequent key is never a large group.
Answers go back the same way, along positions that every unit has kept.  Messages
are 16 a block and level; levels are log16 of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace

#: Bits of a key that a level deals by: 16 ranges, and 16 units to a group.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Bits of a row's place in its block.
ROW_BITS = 20
#: In place of an asking block's number: a range's own table.
KEPT = -1


def pack(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_sorted(array: np.ndarray) -> bytes:
    """Sorted or small integers, byte plane by byte plane: planes that hardly change take no room."""
    return pack(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T)


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def follow(h: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Key of a sequence with one more element."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + then)


def levels_of(blocks: int, fan_bits: int = FAN_BITS) -> int:
    """Levels after which one unit holds a range."""
    n, levels = blocks, 1
    while n > 1 << fan_bits:
        n, levels = -(-n // (1 << fan_bits)), levels + 1
    return levels


def digit_edges(sorted_keys: np.ndarray, level: int, fan_bits: int = FAN_BITS) -> np.ndarray:
    """Where the keys of each of a level's ranges begin and end; the keys agree in what earlier levels dealt by."""
    fan = 1 << fan_bits
    digits = (sorted_keys >> np.uint64(64 - fan_bits * (level + 1))) & np.uint64(fan - 1)
    return np.searchsorted(digits, np.arange(fan + 1, dtype=np.uint64))


class Sums:
    """What an exchange of keys with numbers merges: numbers of equal keys are added up.

    ``up``: the numbers' names and types.  ``answer(keys, totals)``: what the unit
    that holds a range replies for each of its keys, by name, and numbers for the
    driver to add up.  ``down``: the replies' names and types.  A reply named
    ``owned`` is true for one of the blocks that have asked for a key only.
    ``keeps``: each range's keys and replies are a table of their own too (see ``exchange_and_keep``).
    ``fan_bits``: bits of a key that a level deals by.  All keys are shuffled once
    a level: more bits make fewer levels of more, smaller messages.
    """

    keeps, fan_bits = False, FAN_BITS

    def __init__(self, up: dict[str, str], down: dict[str, str], answer: Callable, extra: tuple[str, ...] = (), keeps: bool = False, fan_bits: int = FAN_BITS):
        self.up, self.down, self.answer, self.extra, self.keeps, self.fan_bits = up, down, answer, extra, keeps, fan_bits

    def dump(self, data: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, bytes]:
        return {"keys": pack_sorted(data["keys"][lo:hi])} | {n: pack_sorted(data[n][lo:hi]) for n in self.up}

    def load(self, row: dict) -> dict[str, np.ndarray]:
        return {"keys": unpack_sorted(row["keys"], np.uint64)} | {n: unpack_sorted(row[n], t) for n, t in self.up.items()}

    def merge(self, parts: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Merged data, the place in it of every key of every part, and the part that owns each merged key."""
        keys, first, at = np.unique(np.concatenate([p["keys"] for p in parts]), return_index=True, return_inverse=True)
        data = {"keys": keys}
        for n, t in self.up.items():
            data[n] = np.bincount(at, np.concatenate([p[n] for p in parts]), keys.size).astype(t)
        owner = np.searchsorted(np.cumsum([p["keys"].size for p in parts]), first, side="right")
        return data, at, owner

    def answers(self, parts: list[dict], children: list[int]) -> tuple[list[dict], dict]:
        data, at, owner = self.merge(parts)
        reply, extra = self.answer(data["keys"], data)
        edges = np.cumsum([0, *[p["keys"].size for p in parts]])
        picked = [self.pick(reply, at[a:b], owner[at[a:b]] == k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        return picked + ([reply | {"keys": data["keys"]}] if self.keeps else []), extra

    def pick(self, reply: dict, at: np.ndarray, mine: np.ndarray) -> dict:
        return {n: mine & reply[n][at] if n == "owned" else reply[n][at] for n in self.down}

    def give(self, reply: dict) -> dict[str, bytes]:
        return {n: pack_sorted(reply[n].astype(t)) for n, t in self.down.items()}

    def take(self, rows: list[dict]) -> dict[str, np.ndarray]:
        """Replies of the ranges of one asker, in order of its keys."""
        rows = sorted((r for r in rows if r[next(iter(self.down))] is not None), key=lambda r: r["part"])
        return {n: np.concatenate([unpack_sorted(r[n], t) for r in rows]) if rows else np.zeros(0, t) for n, t in self.down.items()}


def messages(m: Sums, block: int, data: dict[str, np.ndarray]) -> list[dict]:
    """A block's rows of ``asked``: its distinct keys, sorted, with their data, one row a range that has any."""
    edges = digit_edges(data["keys"], 0, m.fan_bits)
    return [{"block": block, "digit": d} | m.dump(data, lo, hi) for d, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]


def asked_fields(m: Sums) -> list[tuple[str, pa.DataType]]:
    return [("block", pa.int64()), ("digit", pa.int64()), ("keys", pa.binary()), *[(n, pa.binary()) for n in m.up]]


def asked_schema(m: Sums) -> str:
    return "block long, digit long, keys binary" + "".join(f", {n} binary" for n in m.up)


def _children(table: pa.Table, m: Sums) -> tuple[list[int], list[dict]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["child"])
    return [r["child"] for r in rows], [m.load(r) for r in rows]


def _merge(table: pa.Table, m: Sums, level: int) -> pa.Table:
    """A unit: the merged keys of its children, dealt into ranges, and a row that remembers whose they are."""
    group, prefix = table.column("group")[0].as_py(), table.column("prefix")[0].as_py()
    children, parts = _children(table, m)
    data, at, owner = m.merge(parts)
    unit = (group << (m.fan_bits * level)) | prefix
    blank = dict.fromkeys(["keys", *m.up, "children", "counts", "places", "owner"])
    sizes = np.array([p["keys"].size for p in parts], np.int64)
    # Each child's places rise: differences are small.
    places = np.diff(at, prepend=0)
    places[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = at[np.cumsum(sizes)[:-1][sizes[1:] > 0]]
    out = [blank | {"unit": unit, "group": group, "prefix": prefix, "digit": -1, "children": children, "counts": pack(sizes), "places": pack_sorted(places.astype(np.uint32)), "owner": pack_sorted(owner.astype(np.uint16))}]
    edges = digit_edges(data["keys"], level, m.fan_bits)
    out += [blank | {"unit": unit, "group": group, "prefix": prefix, "digit": d} | m.dump(data, lo, hi) for d, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
    binary = [(n, pa.binary()) for n in ("keys", *m.up, "counts", "places", "owner")]
    return as_table(out, [*[(n, pa.int64()) for n in ("unit", "group", "prefix", "digit")], ("children", pa.list_(pa.int64())), *binary])


def _merger(m: Sums, level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _merge(table, m, level)


def _answer(table: pa.Table, m: Sums) -> pa.Table:
    prefix = table.column("prefix")[0].as_py()
    children, parts = _children(table, m)
    replies, extra = m.answers(parts, children)
    none = dict.fromkeys(m.extra, 0)
    out = [{"child": c, "part": prefix} | m.give(r) | (none if k else none | extra) for k, (c, r) in enumerate(zip([*children, KEPT], replies))]
    if m.keeps:
        out = [o | {"keys": pack_sorted(r["keys"]) if "keys" in r else None} for o, r in zip(out, replies)]
    fields = [("child", pa.int64()), ("part", pa.int64()), *[(n, pa.binary()) for n in m.down], *[(n, pa.int64()) for n in m.extra]]
    return as_table(out, fields + ([("keys", pa.binary())] if m.keeps else []))


def _pass_on(left: pa.Table, right: pa.Table, m: Sums) -> pa.Table:
    """A unit's replies, handed to its children."""
    (row,) = right.to_pylist()
    reply = m.take(left.to_pylist())
    sizes = unpack(row["counts"], np.int64)
    places, owner = unpack_sorted(row["places"], np.uint32), unpack_sorted(row["owner"], np.uint16)
    out, at = [], 0
    for k, (child, n) in enumerate(zip(row["children"], sizes)):
        where = np.cumsum(places[at : at + n], dtype=np.int64)
        at += n
        out.append({"child": child, "part": row["prefix"]} | m.give(m.pick(reply, where, owner[where] == k)))
    return as_table(out, [("child", pa.int64()), ("part", pa.int64()), *[(n, pa.binary()) for n in m.down]])


def exchange(work: Workspace, name: str, asked: DataFrame, blocks: int, m: Sums) -> tuple[DataFrame, dict]:
    """Replies (block, part, ...) to what blocks ask (see ``messages``), about 16 rows a block, and the sums of the extra numbers."""
    return exchange_and_keep(work, name, asked, blocks, m)[:2]


def exchange_and_keep(work: Workspace, name: str, asked: DataFrame, blocks: int, m: Sums) -> tuple[DataFrame, dict, DataFrame | None]:
    """As ``exchange``, and where ``m.keeps`` the table (part, keys, replies ...) of distinct keys, one row a key range."""
    levels, fan = levels_of(blocks, m.fan_bits), 1 << m.fan_bits
    up = asked.select(
        F.col("block").alias("child"), F.pmod(F.xxhash64("block"), F.lit(-(-blocks // fan))).alias("group"), F.col("digit").alias("prefix"), "keys", *m.up)
    middle = "unit long, group long, prefix long, digit long, children array<long>, keys binary" + "".join(f", {n} binary" for n in (*m.up, "counts", "places", "owner"))
    replies = "child long, part long" + "".join(f", {n} binary" for n in m.down)
    merged = []
    for level in range(1, levels):
        merged.append(work.put(up.groupBy("group", "prefix").applyInArrow(_merger(m, level), middle), f"{name}-merged{level}"))
        up = merged[-1].where("digit >= 0").select(
            F.col("unit").alias("child"), F.shiftright("group", m.fan_bits).alias("group"), (F.col("prefix") * fan + F.col("digit")).alias("prefix"), "keys", *m.up)
    answers = work.put(up.groupBy("group", "prefix").applyInArrow(lambda t: _answer(t, m), replies + "".join(f", {n} long" for n in m.extra) + (", keys binary" if m.keeps else "")), f"{name}-answers")
    extra = answers.agg(*[F.sum(n).alias(n) for n in m.extra]).first().asDict() if m.extra else {}
    answers, kept_table = answers.drop(*m.extra), None
    if m.keeps:
        kept_table = answers.where(F.col("child") == KEPT).select("part", "keys", *m.down)
        answers = answers.where(F.col("child") != KEPT).drop("keys")
    for level in range(levels - 1, 0, -1):
        kept = merged[level - 1].where("digit < 0").select("unit", "prefix", "children", "counts", "places", "owner")
        answers = answers.groupBy("child").cogroup(kept.groupBy("unit")).applyInArrow(lambda a, b: _pass_on(a, b, m), replies)
    if levels > 1:
        answers = work.put(answers, f"{name}-replies")
        for level in range(1, levels):
            work.drop(f"{name}-merged{level}")
        if not m.keeps:
            work.drop(f"{name}-answers")
    return answers.withColumnRenamed("child", "block"), extra, kept_table


def words_of(text: str | None) -> list[bytes]:
    """Words between U+0020, U+0009 to U+000D, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_block(number: int, rows: list[dict]) -> dict:
    """Texts as local word numbers, and the words' keys: what counting needs of a text, in a fraction of its size."""
    import xxhash

    ids: dict[bytes, int] = {}
    tokens: list[int] = []
    lengths = []
    for r in rows:
        words = words_of(r["text"])
        lengths.append(len(words))
        tokens += [ids.setdefault(w, len(ids)) for w in words]
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    return {
        "block": number, "tokens": pack(np.array(tokens, np.uint32)), "words": pack(keys),
        "lengths": pack(np.array(lengths, np.int64)), "ids": [r["id"] for r in rows],
    }


def text_weight(row: dict) -> int:
    """About the number of words, and 1 at least."""
    return len(row["text"] or "") // 6 + 1


def make_blocks(docs: DataFrame, schema: str, weigh: Callable[[dict], int], limit: int, build: Callable[[int, list[dict]], dict]) -> DataFrame:
    """Rows to blocks: rows are gathered until their weights reach ``limit`` and built into one block row.

    Block numbers follow from the input's partitions, which a rerun task sees alike:
    up to 2**20 blocks a partition and 2**23 partitions (a task fails rather than
    take another's number).  A block's rows are numbered in 20 bits, so that a
    number shifted left by 20 has room for a row's place in its block.
    """
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kinds = {name: types[kind] for name, kind in (x.split() for x in schema.split(","))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        first = number
        held: list[dict] = []
        weight = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            if number - first == 1 << 20:
                raise ValueError("an input partition has more than 2**20 blocks")
            row = build(number, held)
            number += 1
            return pa.RecordBatch.from_pydict({n: pa.array([row[n]], t) for n, t in kinds.items()})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                weight += weigh(row)
                if weight >= limit or len(held) == 1 << ROW_BITS:
                    yield out()
                    held, weight = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, schema)


def as_table(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in fields})
