"""Near-duplicate groups by SimHash fingerprints, found by meeting in the middle.

Two fingerprints that differ in at most ``radius`` bits have a value within half
the radius of both.  So every distinct fingerprint emits all values within half
the radius, equal values meet, and what emitted one value is linked and verified.

Values are shuffled by their leading bits: a fingerprint is sent once for each
*prefix* that its values have (1 + p + p(p-1)/2 rows for p bits and radius 4, in
place of 2,081 values), and the rest of a value is filled in where the prefix is
decided.  Prefixes that a dense family crowds are lengthened until they hold a
bounded number of fingerprints, so no task's size depends on the largest family.

Fingerprints that emitted one value are within the radius of each other, so
chaining them in order loses no connection and no pairs of a family are listed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaspark.llm.rows import with_columns_from_text
from vistaspark.operators.graph import connected_components
from vistaspark.sources.workspace import Workspace

#: Values written out at once inside a task.
_VALUES = 1 << 22
#: Bits by which a crowded prefix is lengthened.
_STEP = 6
_PIECE = 1 << 20


def _pieces(text: str, width: int):
    """Lists of words: each holds the last ``width - 1`` words of the one before, so that no shingle is lost or counted twice."""
    lo, held = 0, []
    while True:
        hi = lo + _PIECE
        # A piece ends at a blank; U+0020 and U+0009 to U+000D alone part words.
        while hi < len(text) and text[hi] not in " \t\n\x0b\x0c\r":
            hi += 1
        words = held + text[lo:hi].encode("utf-8", "surrogatepass").lower().split()
        lo = hi
        if lo >= len(text):
            yield words
            return
        if len(words) >= width:
            yield words
            words = words[len(words) - width + 1 :]
        held = words


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes (XXH64, seed 42); 0 without words."""
    counts, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    first = True
    for words in _pieces(text or "", width):
        if not words:
            break
        if len(words) < width:
            if not first:
                break
            hashes = [digest(b" ".join(words), 42)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - width].tolist()]
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]
        first = False
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return sum(1 << k for k in range(64) if 2 * int(counts[k]) > total)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """docs with ``fingerprint_bits`` (long, two's complement)."""
    def start():
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return lambda t: (signed(fingerprint(t, width)),)

    return with_columns_from_text(docs, text, [("fingerprint_bits", T.LongType())], start)


@cache
def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``most`` ones."""
    return np.array([sum(1 << k for k in c) for n in range(min(bits, most) + 1) for c in combinations(range(bits), n)], np.uint64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each place's smallest known companion) after linking places a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def _meet(prints: np.ndarray, left: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Places' companions through equal values: each place may still change ``left`` of the low ``bits`` bits."""
    label = np.arange(prints.size)
    todo = [(label.copy(), left, bits)]
    while todo:
        at, free, low = todo.pop()
        kinds = np.unique(free)
        if at.size < 2:
            continue
        if sum(int((free == t).sum()) * masks(low, int(t)).size for t in kinds) > _VALUES and low:
            # Too many values at once: first those whose next bit is 0, then those whose next bit is 1.
            bit = (prints[at] >> np.uint64(low - 1)) & np.uint64(1)
            for want in (0, 1):
                after = free - (bit != want)
                keep = after >= 0
                todo.append((at[keep], after[keep], low - 1))
            continue
        values, owners = [], []
        rest = np.uint64((1 << low) - 1)
        for t in kinds:
            who = at[free == t]
            change = masks(low, int(t))
            values.append(((prints[who] & rest)[:, None] ^ change).ravel())
            owners.append(np.repeat(who, change.size))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        a, b = owner[same], owner[same + 1]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        label = _merge(label, a[near], b[near])
    return label


def _links(table: pa.Table, radius: int) -> pa.Table:
    """Links of the fingerprints under one prefix."""
    prints = table.column("fp").to_numpy().view(np.uint64)
    label = _meet(prints, table.column("free").to_numpy().astype(np.int64), 64 - table.column("used")[0].as_py(), radius)
    moved = np.flatnonzero(label != np.arange(label.size))
    return pa.table({"i": prints[moved].view(np.int64), "j": prints[label[moved]].view(np.int64)})


def _spread(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """rows (fp, prefix, used, free) with prefixes of ``bits`` more bits: one row for each prefix of the values that a row still emits."""
    changes = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("mask"), F.lit(int(m).bit_count()).alias("n")) for m in masks(bits, most)])
    shift = F.lit(64) - F.col("used") - F.lit(bits)
    following = F.call_function("shiftrightunsigned", F.col("fp"), shift.cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    each = rows.withColumn("c", F.explode(changes)).where(F.col("c.n") <= F.col("free"))
    return each.select(
        "fp", (F.shiftleft("prefix", bits) + following.bitwiseXOR(F.col("c.mask"))).alias("prefix"),
        (F.col("used") + bits).cast("int").alias("used"), (F.col("free") - F.col("c.n")).cast("int").alias("free"),
    )


def fingerprint_links(prints: DataFrame, work: Workspace, radius: int = 4, bucket_rows: int = 1 << 14) -> DataFrame:
    """(i, j): links that connect what is within ``radius`` bits, over distinct fingerprints ``fp`` (long)."""
    if radius % 2:
        raise ValueError("radius must be even: values halfway link what is within twice that distance")
    most, count = radius // 2, prints.count()
    bits = next(p for p in range(33) if p == 32 or count * masks(p, most).size <= bucket_rows << p)
    start = prints.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used"), F.lit(most).alias("free"))
    level = _spread(start, bits, most) if bits else start
    found, depth = [], 0
    while True:
        used = bits + depth * _STEP
        full = level.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * bucket_rows)
        crowded = work.put(full.select("prefix"), f"crowded{depth}") if used + _STEP <= 64 else None
        some = crowded is not None and not crowded.isEmpty()
        ready = level.join(crowded, "prefix", "left_anti") if some else level
        found.append(work.put(ready.groupBy("prefix").applyInArrow(lambda t: _links(t, radius), "i long, j long"), f"links{depth}"))
        if not some:
            break
        level = work.put(_spread(level.join(crowded, "prefix", "left_semi"), _STEP, most), f"level{depth}")
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hex_of(bits: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = 4, width: int = 4, bucket_rows: int = 1 << 14) -> DataFrame:
    """One row per row of docs: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id``: the smallest id reachable by links, own id included.  Words:
    stretches without U+0020, U+0009 to U+000D; A-Z are lower-cased.  A text of
    fewer than ``width`` words is one shingle; null, empty and wordless texts have
    fingerprint zero, which links like any other.  A bit set in exactly half of the
    shingles is 0.  Repeated rows have equal fingerprints and all stay.  Null ids
    are no id: a component of such rows alone has a null ``component_id``.  Texts of
    any length count whole.  Other columns, whatever their names, are not looked
    at.  An empty table gives an empty table.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    marked = work.put(with_fingerprint(rows, "text", width).select("id", F.col("fingerprint_bits").alias("fp")), "marked")
    prints = work.put(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    groups = connected_components(fingerprint_links(prints.select("fp"), work, radius, bucket_rows))
    reached = work.put(
        prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "reached")
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reached.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id")
