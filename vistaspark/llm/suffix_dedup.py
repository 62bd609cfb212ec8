"""Exact removal of repeated substrings of a least length.

Every string of ``length`` bytes that occurred earlier (in a text with a smaller
id, or further left in the same text) is removed wherever it occurs again.

Method: threshold-bounded interval expansion.  On the Burrows-Wheeler transform
of a text, the suffixes that begin with a string form an interval.  Expansion
begins with the empty string's interval; backward extension by a character gives
the intervals of longer strings, breadth first, so common prefixes come out by
increasing value; singletons drop out at once and the expansion stops at the
least length.  What is left are the intervals of all repeated strings of that
length.  An interval is its two ends: the transform's runs of equal characters
tell which characters come before it, at a cost that does not depend on its size.

The corpus is too large for one transform, so equal strings are brought
together first.  Each string of ``length`` bytes holds an anchor, the substring
of ``ANCHOR`` bytes with the smallest hash, chosen by content alone; equal
strings have equal anchors at equal places.  An anchor's surroundings within
reach of any such string (its context) go to the unit that holds the anchor's
key (see ``blocks.exchange``), if the anchor occurs twice at all; equal contexts
become one on their way, and the unit decides all strings in them by its own
transform.
"""

from __future__ import annotations

from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm import blocks as B
from vistaspark.sources.workspace import Workspace

ANCHOR = 32
_SLICE = 1 << 18
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Multipliers (odd) of the four words of an anchor.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _build(number: int, rows: list[dict]) -> dict:
    texts = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows]
    return {"block": number, "data": B.pack(np.frombuffer(b"".join(texts), np.uint8)), "lengths": B.pack(np.array([len(t) for t in texts], np.int64)), "ids": [r["id"] for r in rows]}


def _words_at_all(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as integers; beyond the end zeros."""
    n = data.size
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8 - n % 8, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + out.size].view("<u8")
    return out[:n]


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for all i where that is whole."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


class Anchors:
    """Anchors of a block: place, key, context bounds and context key, in order of place."""

    def __init__(self, row: dict, length: int):
        self.data = B.unpack(row["data"], np.uint8)
        self.lengths = B.unpack(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.length, self.reach = length, length - ANCHOR
        width = self.reach + 1
        n = self.data.size
        word = _words_at_all(self.data)
        # Bytes left in the text, from every place on.
        left = np.repeat(self.ends.astype(np.int32), self.lengths) - np.arange(n, dtype=np.int32)
        places, keys = [], []
        for lo in range(0, n, _SLICE):
            a, b = max(0, lo - width), min(n, lo + _SLICE + length + 32)
            w = word[a:b]
            size = w.size - 24
            if size < width:
                w = np.concatenate([w, np.zeros(width + 24 - w.size, np.uint64)])
                size = w.size - 24
            h = w[:size] * _ODD[0] + w[8 : 8 + size] * _ODD[1] + w[16 : 16 + size] * _ODD[2] + w[24 : 24 + size] * _ODD[3]
            h = B.mix64(h) | np.uint64(1)
            room = np.zeros(size, np.int64)
            room[: min(size, b - a)] = left[a : a + min(size, b - a)]
            h[room < ANCHOR] = _MAX
            least = _sliding(h, width, np.minimum)
            least[room[: least.size] < length] = 0
            # An anchor is the least of some whole string around it.
            around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(max(0, size - least.size), np.uint64)])
            most = _sliding(around, width, np.maximum)[:size]
            hit = np.flatnonzero(most == h)
            hit = hit[(hit + a >= lo) & (hit + a < lo + _SLICE)]
            places.append(hit + a)
            keys.append(h[hit])
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.key = B.mix64(np.concatenate(keys) + np.uint64(0x5851F42D4C957F2D)) if keys else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.place, side="right")
        begin = self.ends[self.doc] - self.lengths[self.doc]
        self.lo = np.maximum(begin, self.place - self.reach)
        self.hi = np.minimum(self.ends[self.doc], self.place + length)
        self.start_of_doc = begin
        self._word = word

    def only(self, which: np.ndarray) -> None:
        for name in ("place", "key", "doc", "lo", "hi", "start_of_doc"):
            setattr(self, name, getattr(self, name)[which])

    def context_keys(self) -> np.ndarray:
        """64-bit keys of the contexts: content, and the anchor's place in it."""
        full = self.length + self.reach
        at, size = self.place - self.lo, self.hi - self.lo
        out = B.mix64(at.astype(np.uint64) * np.uint64(1024) + size.astype(np.uint64))
        n = self._word.size
        for k in range(0, full, 8):
            more = k < size
            word = self._word[np.minimum(self.lo + k, n - 1)]
            over = np.maximum(k + 8 - size, 0)
            word = word & (_MAX >> (np.uint64(8) * np.minimum(over, 7).astype(np.uint64)))
            out = np.where(more, B.follow(out, word), out)
        return out


def _repeated(keys: np.ndarray, totals: dict) -> tuple[dict, dict]:
    return {"repeated": totals["times"] > 1}, {}


#: Which anchors occur twice or more; a block tells one place from several.
ANCHOR_COUNTS = B.Sums({"times": "u4"}, {"repeated": "u1"}, _repeated)


def _ask(batches, length: int):
    """Distinct anchor keys of each block, and which occur more than once in the block."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, counts = np.unique(Anchors(row, length).key, return_counts=True)
            out = B.messages(ANCHOR_COUNTS, row["block"], {"keys": keys, "times": np.minimum(counts, 2).astype("u4")})
            yield from B.as_table(out, B.asked_fields(ANCHOR_COUNTS)).to_batches()


class Contexts:
    """A block's repeated anchors and their distinct contexts, sorted by (anchor key, context key)."""

    def __init__(self, row: dict, replies: list[dict], length: int):
        self.anchors = a = Anchors(row, length)
        _, at = np.unique(a.key, return_inverse=True)
        a.only(ANCHOR_COUNTS.take(replies)["repeated"][at] > 0)
        last = np.iinfo(np.int64).max
        self.ids = np.array([last if i is None else i for i in row["ids"]], np.int64)
        context = a.context_keys()
        start = a.place - a.start_of_doc
        order = np.lexsort((start, a.doc, self.ids[a.doc], context, a.key))
        key, context = a.key[order], context[order]
        new = np.ones(order.size, bool)
        new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        self.first = order[new]
        self.keys, self.contexts = key[new], context[new]
        #: Of each anchor: its context's number, and whether it is the context's first here.
        self.number = np.empty(order.size, np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.is_first = np.zeros(order.size, bool)
        self.is_first[self.first] = True


class ContextMerge(B.Sums):
    """Merging of contexts: equal ones become one, that of the first text; the unit that holds an anchor decides its strings.

    ``first`` is told to the block with a context's first occurrence, with the strings in it that occur ``earlier``.
    """

    def __init__(self, length: int, batch_bytes: int):
        super().__init__(dict.fromkeys(("contexts", "bytes", "sizes", "ids", "texts", "starts"), ""), {"first": "u1", "earlier": "u1"}, None)
        self.length, self.batch_bytes = length, batch_bytes
        self.width = -(-(length - ANCHOR + 1) // 8)

    def dump(self, data: dict, lo: int, hi: int) -> dict[str, bytes]:
        at = data["offset"][lo] if lo < hi else 0
        end = data["offset"][hi - 1] + data["sizes"][hi - 1] if lo < hi else 0
        return {
            "keys": B.pack_sorted(data["keys"][lo:hi]), "contexts": data["contexts"][lo:hi].tobytes(), "bytes": B.pack(data["bytes"][at:end]), "sizes": B.pack(data["sizes"][lo:hi].astype(np.uint16)),
            "ids": B.pack_sorted(data["ids"][lo:hi]), "texts": B.pack_sorted(data["texts"][lo:hi]), "starts": B.pack_sorted(data["starts"][lo:hi]),
        }

    def load(self, row: dict) -> dict:
        sizes = B.unpack(row["sizes"], np.uint16).astype(np.int64)
        return {
            "keys": B.unpack_sorted(row["keys"], np.uint64), "contexts": np.frombuffer(row["contexts"], np.uint64), "bytes": B.unpack(row["bytes"], np.uint8), "sizes": sizes,
            "offset": np.cumsum(sizes) - sizes, **{n: B.unpack_sorted(row[n], np.int64) for n in ("ids", "texts", "starts")},
        }

    @staticmethod
    def chosen(data: dict, which: np.ndarray) -> dict:
        sizes = data["sizes"][which]
        offset = np.cumsum(sizes) - sizes
        at = np.repeat(data["offset"][which] - offset, sizes) + np.arange(sizes.sum())
        return {n: data[n][which] for n in ("keys", "contexts", "sizes", "ids", "texts", "starts")} | {"bytes": data["bytes"][at], "offset": offset}

    def _joined(self, parts: list[dict]) -> tuple[dict, np.ndarray, np.ndarray]:
        """All parts' contexts; the number of each one's kind, and each kind's first occurrence."""
        data = {n: np.concatenate([p[n] for p in parts]) for n in ("keys", "contexts", "bytes", "sizes", "ids", "texts", "starts")}
        data["offset"] = np.cumsum(data["sizes"]) - data["sizes"]
        order = np.lexsort((data["starts"], data["texts"], data["ids"], data["contexts"], data["keys"]))
        k, c = data["keys"][order], data["contexts"][order]
        new = np.ones(order.size, bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        number = np.empty(order.size, np.int64)
        number[order] = np.cumsum(new) - 1
        return data, number, order[new]

    def merge(self, parts: list[dict]) -> tuple[dict, np.ndarray, np.ndarray]:
        data, number, first = self._joined(parts)
        owner = np.searchsorted(np.cumsum([p["keys"].size for p in parts]), first, side="right")
        return self.chosen(data, first), number, owner

    def answers(self, parts: list[dict], children: list[int]) -> tuple[list[dict], dict]:
        data, _, first = self._joined(parts)
        is_first = np.zeros(data["keys"].size, bool)
        is_first[first] = True
        earlier = decide(data, first, self.length, self.batch_bytes)
        edges = np.cumsum([0, *[p["keys"].size for p in parts]])
        return [{"first": is_first[a:b], "earlier": earlier[a:b]} for a, b in zip(edges, edges[1:])], {}

    def pick(self, reply: dict, at: np.ndarray, mine: np.ndarray) -> dict:
        first = (reply["first"][at] > 0) & mine
        return {"first": first, "earlier": np.where(first[:, None], reply["earlier"][at], np.uint8(0))}

    def give(self, reply: dict) -> dict[str, bytes]:
        return {"first": B.pack(reply["first"].astype(np.uint8)), "earlier": B.pack(reply["earlier"])}

    def take(self, rows: list[dict]) -> dict:
        rows = sorted((r for r in rows if r["first"] is not None), key=lambda r: r["part"])
        first = [B.unpack(r["first"], np.uint8) for r in rows]
        earlier = [B.unpack(r["earlier"], np.uint8).reshape(-1, self.width) for r in rows]
        return {"first": np.concatenate([np.zeros(0, np.uint8), *first]), "earlier": np.concatenate([np.zeros((0, self.width), np.uint8), *earlier])}


def _send(left: pa.Table, right: pa.Table, m: ContextMerge) -> pa.Table:
    (row,), replies = left.to_pylist(), right.to_pylist()
    c = Contexts(row, replies, m.length)
    a, f = c.anchors, c.first
    whole = {
        "keys": a.key, "contexts": np.zeros(a.key.size, np.uint64), "bytes": a.data, "sizes": a.hi - a.lo, "offset": a.lo,
        "ids": c.ids[a.doc], "texts": (row["block"] << B.ROW_BITS) + a.doc, "starts": a.lo - a.start_of_doc,
    }
    data = m.chosen(whole, f) | {"contexts": c.contexts}
    return B.as_table(B.messages(m, row["block"], data), B.asked_fields(m))


def repeated_intervals(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings of ``length`` bytes that begin at two places or more of the concatenated strings and lie in one of them.

    Returns places and interval numbers (equal strings, equal numbers).
    """
    count = sizes.size
    n = int(text.size + count)
    symbols = np.zeros(n, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(n, bool)
    inner[ends] = False
    symbols[inner] = text.astype(np.int64) + 1
    to_end = np.repeat(ends, sizes + 1) - np.arange(n)
    # Order of the suffixes, each ending at its string's end, by their first ``length`` symbols or more (ties by place,
    # which suffices for strings of that length): 7 symbols at once, then doubling.
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: max(0, n - k)] += np.where(k <= to_end, np.append(symbols[k:], np.zeros(min(k, n), np.int64)), 0)[: max(0, n - k)]
    rank = np.unique(key, return_inverse=True)[1]
    depth, longest = 7, min(length, int(sizes.max(initial=0)) + 1)
    while depth < longest and rank.max(initial=0) < n - 1:
        key = rank * (n + 1)
        key[: max(0, n - depth)] += np.where(depth <= to_end, np.append(rank[depth:] + 1, np.zeros(min(depth, n), np.int64)), 0)[: max(0, n - depth)]
        rank = np.unique(key, return_inverse=True)[1]
        depth *= 2
    suffixes = np.argsort(rank * n + np.arange(n)).astype(np.int32)
    # The transform: the symbol before each suffix (none across strings), and where a step back leads.
    transform = np.where(suffixes > 0, symbols[suffixes - 1], 0).astype(np.uint16)
    back = np.empty(n, np.int32)
    back[np.argsort(transform, kind="stable")] = np.arange(n, dtype=np.int32)
    # Its runs of equal symbols.
    new = np.ones(n, bool)
    new[1:] = transform[1:] != transform[:-1]
    run = (np.cumsum(new) - 1).astype(np.int32)
    begin = np.flatnonzero(new).astype(np.int32)
    end = np.append(begin[1:], np.int32(n))
    # Intervals [lo, hi) of the empty string, of single symbols, and so on; those of one suffix drop out.
    lo, hi = (np.array([x], np.int32) if n > 1 else np.zeros(0, np.int32) for x in (0, n))
    for _ in range(length):
        if not lo.size:
            break
        first = run[lo]
        inner = end[first] >= hi
        # One symbol comes before all of it.
        at = np.flatnonzero(inner)
        at = at[transform[lo[at]] > 0]
        one_lo, one_hi = back[lo[at]], back[hi[at] - 1] + 1
        # Several do: the runs within, gathered by symbol.
        at = np.flatnonzero(~inner)
        pieces = run[hi[at] - 1] - first[at] + 1
        which = np.repeat(at, pieces)
        of_run = np.repeat(first[at] - (np.cumsum(pieces) - pieces), pieces) + np.arange(pieces.sum())
        symbol = transform[begin[of_run]]
        known = symbol > 0
        which, of_run, symbol = which[known], of_run[known], symbol[known]
        by = which * 512 + symbol
        order = np.argsort(by)
        by = by[order]
        head = np.flatnonzero(np.concatenate([by[:1] == by[:1], by[1:] != by[:-1]]))
        if head.size:
            low, high = np.maximum(lo[which], begin[of_run])[order], np.minimum(hi[which], end[of_run])[order]
            child_lo, child_hi = np.minimum.reduceat(back[low], head), np.maximum.reduceat(back[high - 1], head) + 1
            more = child_hi - child_lo > 1
            one_lo, one_hi = np.concatenate([one_lo, child_lo[more]]), np.concatenate([one_hi, child_hi[more]])
        lo, hi = one_lo, one_hi
    sizes_of = hi - lo
    at = np.repeat(lo - (np.cumsum(sizes_of) - sizes_of), sizes_of) + np.arange(sizes_of.sum())
    places = suffixes[at]
    return places - np.searchsorted(ends, places), np.repeat(np.arange(lo.size), sizes_of)


def decide(data: dict, first: np.ndarray, length: int, batch_bytes: int) -> np.ndarray:
    """Which strings in the contexts occur earlier, as packed bits; ``first``: the distinct contexts, by anchor."""
    keys, sizes, ids, text, starts, offset = (data[n] for n in ("keys", "sizes", "ids", "texts", "starts", "offset"))
    # Only anchors with several contexts need the transform.
    key_of = keys[first]
    new_key = np.ones(first.size, bool)
    new_key[1:] = key_of[1:] != key_of[:-1]
    of_key = np.cumsum(new_key) - 1
    several = np.bincount(of_key)[of_key] > 1 if first.size else np.zeros(0, bool)
    some, of_key = first[several], of_key[several]
    strings = length - ANCHOR + 1
    earlier = np.zeros((keys.size, strings), bool)
    # Whole anchors are dealt into transforms of about batch_bytes.
    batch = np.cumsum(sizes[some]) // batch_bytes
    if some.size:
        batch = batch[np.searchsorted(of_key, of_key)]
    for b in np.unique(batch):
        part = some[batch == b]
        size = sizes[part]
        base = np.cumsum(size) - size
        at = np.repeat(offset[part] - base, size) + np.arange(size.sum())
        places, group = repeated_intervals(data["bytes"][at], size, length)
        owner = np.searchsorted(base, places, side="right") - 1
        inner = places - base[owner]
        who = part[owner]
        start = starts[who] + inner
        by = np.lexsort((start, text[who], ids[who], group))
        group, who, inner, start = group[by], who[by], inner[by], start[by]
        head = np.ones(group.size, bool)
        head[1:] = group[1:] != group[:-1]
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (start != start[lead]) | (text[who] != text[who[lead]])
        earlier[who[later], inner[later]] = True
    return np.packbits(earlier, axis=1)


def _remove(left: pa.Table, right: pa.Table, m: ContextMerge, keep_text: bool) -> pa.Table:
    (row,), replies = left.to_pylist(), right.to_pylist()
    length = m.length
    c = Contexts(row, replies, length)
    a = c.anchors
    edge = np.zeros(a.data.size + 1, np.int64)
    if a.place.size:
        told = m.take(replies)
        first, earlier = told["first"] > 0, np.unpackbits(told["earlier"], axis=1)[:, : length - ANCHOR + 1]
        lead = c.is_first & first[c.number]
        gone = ~lead & (a.hi - a.lo >= length)
        np.add.at(edge, a.lo[gone], 1)
        np.add.at(edge, a.hi[gone], -1)
        at = np.flatnonzero(lead)
        which, inner = np.nonzero(earlier[c.number[at]])
        begin = a.lo[at[which]] + inner
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
    removed = np.cumsum(edge[:-1]) > 0
    out = []
    begins = c.anchors.ends - c.anchors.lengths
    for i, lo, hi in zip(row["ids"], begins, c.anchors.ends):
        gone = removed[lo:hi]
        kept = a.data[lo:hi][~gone].tobytes()
        r = {"id": i, "n_bytes": int(hi - lo), "n_removed": int(gone.sum()), "n_spans": int((gone[1:] & ~gone[:-1]).sum() + (gone[:1]).sum()), "kept_sha256": sha256(kept).hexdigest()}
        if keep_text:
            steps = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            r |= {"kept": kept, "spans": steps.reshape(-1, 2).ravel().tolist()}
        out.append(r)
    kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    return B.as_table(out, kinds + ([("kept", pa.binary()), ("spans", pa.list_(pa.int64()))] if keep_text else []))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 100, block_bytes: int = 8_000_000, batch_bytes: int = 200_000, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and with ``keep_text`` ``kept`` (bytes) and ``spans`` (starts and ends by turns).

    Texts are UTF-8 bytes, whole; null is empty.  A text shorter than ``length`` is
    untouched.  Overlapping strings count, as do strings that overlap themselves.
    What is removed is judged on the input.  Rows that share an id come in the
    order in which they are read; null ids come last.  Repeated rows lose all but
    what is new in the first.  Other columns, whatever their names, are not looked
    at.  An empty table gives an empty table.  ``length`` must exceed the anchor's
    32 bytes.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    work = Workspace(spark, "suffix")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    weigh = lambda r: len(r["text"] or "") + 64
    blocks = work.put(B.make_blocks(rows, "block long, data binary, lengths binary, ids array<long>", weigh, block_bytes, _build), "blocks")
    count = blocks.select("block").count()
    asked = blocks.mapInArrow(partial(_ask, length=length), B.asked_schema(ANCHOR_COUNTS))
    repeated, _ = B.exchange(work, "anchors", asked, count, ANCHOR_COUNTS)
    repeated = repeated.select("block", F.col("part"), "repeated")
    m = ContextMerge(length, batch_bytes)
    sent = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda a, b: _send(a, b, m), B.asked_schema(m))
    decided, _ = B.exchange(work, "contexts", sent, count, m)
    told = repeated.unionByName(decided, allowMissingColumns=True)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<long>" if keep_text else "")
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _remove(a, b, m, keep_text), schema)
    return out.withColumnRenamed("id", id_col)
