"""Near-duplicate groups: a Jaccard join over word n-grams, size-aware, heavy and light.

Two texts link when their shingle sets have Jaccard similarity of at least 0.8.
Small sets: all subsets of each size that a linked partner can share are
enumerated; texts that share a subset of size o link exactly when their sizes
allow it, and linking each to the smallest of them loses no connection.  Large
sets: inverted lists over set prefixes, rarest shingles first, give families of
texts that may link; a family's overlaps are counted from its inverted lists,
short lists by their pairs and long lists as dense columns, by cost.  The size at
which sets count as large is where the two costs meet over the sizes at hand.

Equal sets are one before anything is compared.  Families are compared in
chunks of bounded size and report spanning links, never all pairs.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.llm import blocks as B
from vistaspark.operators.graph import connected_components
from vistaspark.sources.workspace import Workspace

#: Largest size for which subsets are considered at all.
SMALL_MOST = 24
_ROW = (1 << B.ROW_BITS) - 1


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set must share with any partner: ceil(percent / 100 * size)."""
    return -(-percent * size // 100)


def _rows_of(block: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's texts: text's place, key (sorted within a text), and the sizes of the sets."""
    lengths = B.unpack(block["lengths"], np.int64)
    keys = B.unpack(block["words"], np.uint64)[B.unpack(block["tokens"], np.uint32)]
    n = keys.size
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(lengths.size), lengths)
    h = keys.copy()
    for j in range(1, width):
        h = B.follow(h[: max(0, h.size - 1)], keys[j:]) if j < n else h[:0]
    whole = np.arange(h.size) + width <= ends[owner[: h.size]]
    docs, shingles = owner[: h.size][whole], h[whole]
    brief = np.flatnonzero((lengths > 0) & (lengths < width))
    if brief.size:
        at, size = ends[brief] - lengths[brief], lengths[brief]
        one = B.mix64(size.astype(np.uint64))
        for j in range(width - 1):
            more = j < size
            one[more] = B.follow(one[more], keys[at[more] + j])
        docs, shingles = np.concatenate([docs, brief]), np.concatenate([shingles, one])
    order = np.lexsort((shingles, docs))
    docs, shingles = docs[order], shingles[order]
    fresh = np.ones(docs.size, bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (shingles[1:] != shingles[:-1])
    docs, shingles = docs[fresh], shingles[fresh]
    return docs, shingles, np.bincount(docs, minlength=lengths.size)


def _build(number: int, rows: list[dict], width: int) -> dict:
    """A token block with each text's set size and two keys of the whole set."""
    block = B.token_block(number, rows)
    docs, shingles, sizes = _rows_of(block, width)
    sums = []
    for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B):
        total = np.zeros(len(rows), np.uint64)
        np.add.at(total, docs, B.mix64(shingles ^ np.uint64(salt)))
        sums.append(total.view(np.int64))
    return block | {"sizes": sizes.astype(np.int64), "set1": sums[0], "set2": sums[1], "hashes": [r["hash"] for r in rows]}


_BLOCK = "block long, tokens binary, words binary, lengths binary, ids array<long>, sizes array<long>, set1 array<long>, set2 array<long>, hashes array<long>"


def _log2(keys: np.ndarray, data: dict) -> tuple[dict, dict]:
    return {"levels": np.floor(np.log2(np.maximum(data["times"], 1)))}, {}


#: Shingles to the binary logarithms of their numbers of texts.
LEVELS = B.Sums({"times": "u8"}, {"levels": "u1"}, _log2)


def short_keys(blocks: int) -> np.uint64:
    """The bits of a shingle's key that frequencies are counted by: those that name its range, and 32 more.

    Shingles that agree in them count as one, which makes them look more frequent:
    that changes the order of prefixes for all texts alike and no result.
    """
    bits = min(64, B.FAN_BITS * B.levels_of(blocks) + 32)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def _ask(batches, width: int, mask: np.uint64):
    """Distinct shingles of each block, with the number of texts."""
    for batch in batches:
        for row in batch.to_pylist():
            _, shingles, _ = _rows_of(row, width)
            keys, counts = np.unique(shingles & mask, return_counts=True)
            out = B.messages(LEVELS, row["block"], {"keys": keys, "times": counts.astype("u8")})
            yield from B.as_table(out, B.asked_fields(LEVELS)).to_batches()


def _with_levels(row: dict, replies: list[dict], width: int, rows: np.ndarray, mask: np.uint64):
    """Shingles of the chosen rows of a block with their levels."""
    docs, shingles, sizes = _rows_of(row, width)
    _, at = np.unique(shingles & mask, return_inverse=True)
    levels = LEVELS.take(replies)["levels"][at]
    chosen = np.zeros(sizes.size, bool)
    chosen[rows] = True
    keep = chosen[docs]
    return docs[keep], shingles[keep], levels[keep], sizes


_ENTRY = [("kind", pa.int32()), ("key", pa.int64()), ("size", pa.int64()), ("gid", pa.int64())]


def _entries(left: pa.Table, right: pa.Table, width: int, percent: int, small: int, mask: np.uint64) -> pa.Table:
    """Index entries of a block's representative texts.

    kind 0: an entry of an inverted list (shared prefix shingles of sets that may
    meet a large one).  kind o > 0: a subset of size o of a small set.
    """
    (row,), replies = left.to_pylist(), right.to_pylist()
    mine = np.array([r["gid"] for r in replies if r["gid"] is not None], np.int64)
    docs, shingles, levels, sizes = _with_levels(row, replies, width, mine & _ROW, mask)
    base = row["block"] << B.ROW_BITS
    order = np.lexsort((shingles, levels, docs))
    docs, shingles, levels = docs[order], shingles[order], levels[order]
    present, first = np.unique(docs, return_index=True)
    start = np.zeros(sizes.size, np.int64)
    start[present] = first
    size = sizes[docs]
    prefix = size - (-(-percent * size // 100)) + 1
    meets_large = 100 * size >= percent * (small + 1)
    listed = (np.arange(docs.size) - start[docs] < prefix) & (levels > 0) & meets_large
    kinds = [np.zeros(listed.sum(), np.int64)]
    keys, of_size, gids = [shingles[listed].view(np.int64)], [size[listed]], [base + docs[listed]]
    subsets: list[tuple[int, int, int, int]] = []
    for d, at in zip(present, first):
        n = int(sizes[d])
        if n <= small:
            elements = [int(x) for x in B.mix64(shingles[at : at + n])]
            for o in range(least_overlap(n, percent), n + 1):
                for c in combinations(elements, o):
                    subsets.append((o, (sum(c) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), n, base + int(d)))
    if subsets:
        for to, column in zip((kinds, keys, of_size, gids), zip(*subsets)):
            to.append(np.array(column, np.int64))
    cols = [np.concatenate(x) for x in (kinds, keys, of_size, gids)]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_ENTRY, cols)})


def _family_sets(left: pa.Table, right: pa.Table, width: int, mask: np.uint64) -> pa.Table:
    """Shared shingles of the texts that are in families."""
    (row,), replies = left.to_pylist(), right.to_pylist()
    mine = {r["gid"] & _ROW: r for r in replies if r["gid"] is not None}
    docs, shingles, levels, sizes = _with_levels(row, replies, width, np.fromiter(mine, np.int64, len(mine)), mask)
    shared = levels > 0
    docs, shingles = docs[shared], shingles[shared]
    present, first = np.unique(docs, return_index=True)
    ends = dict(zip(present.tolist(), zip(first.tolist(), [*first[1:].tolist(), docs.size])))
    out = []
    for d, r in mine.items():
        a, b = ends.get(d, (0, 0))
        out.append({"family": r["family"], "chunk": r["chunk"], "chunks": r["chunks"], "gid": r["gid"], "size": int(sizes[d]), "elements": shingles[a:b].tobytes()})
    return B.as_table(out, [("family", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("elements", pa.binary())])


def overlaps(sets: list[np.ndarray], dense_cells: int = 1 << 22) -> np.ndarray:
    """Matrix of intersection sizes, from inverted lists: short ones by pairs, long ones as dense columns."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    rows = np.repeat(np.arange(m), [s.size for s in sets])
    if not rows.size:
        return out
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    counts = np.bincount(column)
    starts = np.cumsum(counts) - counts
    # A pair costs about as much as 64 cells of a dense product.
    heavy = counts * counts * 64 > m * m
    for c in np.unique(counts[(counts > 1) & ~heavy]):
        of = np.flatnonzero((counts == c) & ~heavy)
        lists = rows[starts[of][:, None] + np.arange(c)]
        for lo in range(0, len(lists), max(1, (1 << 21) // int(c * c))):
            part = lists[lo : lo + max(1, (1 << 21) // int(c * c))]
            out += np.bincount((part[:, :, None] * m + part[:, None, :]).ravel(), minlength=m * m).reshape(m, m).astype(np.int32)
    of = np.flatnonzero(heavy & (counts > 1))
    step = max(1, dense_cells // m)
    for lo in range(0, of.size, step):
        some = of[lo : lo + step]
        dense = np.zeros((m, some.size), np.float32)
        at = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in some])
        dense[rows[at], np.repeat(np.arange(some.size), counts[some])] = 1
        out += (dense @ dense.T).astype(np.int32)
    return out


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    m = len(linked)
    todo = np.ones(m, bool)
    out = []
    for root in range(m):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            near = np.flatnonzero(linked[u] & todo)
            todo[near] = False
            out += [(u, int(v)) for v in near]
            stack += near.tolist()
    return out


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Spanning links within pairs of chunks."""
    rows: dict[tuple, list[dict]] = {}
    for r in table.to_pylist():
        rows.setdefault((r["family"], r["c1"], r["c2"]), []).append(r)
    out: list[dict] = []
    for group in rows.values():
        group.sort(key=lambda r: r["gid"])
        o = overlaps([np.frombuffer(r["elements"], np.uint64) for r in group])
        sizes = np.array([r["size"] for r in group])
        linked = 100 * o.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - o)
        out += [{"i": group[a]["gid"], "j": group[b]["gid"]} for a, b in spanning_links(linked)]
    return B.as_table(out, [("i", pa.int64()), ("j", pa.int64())])


def small_boundary(histogram: dict[int, int], percent: int) -> int:
    """The largest size whose sets are cheaper as subsets than in inverted lists, summed over the sizes at hand."""
    subsets = lambda a: sum(comb(a, o) for o in range(least_overlap(a, percent), a + 1))
    lists = lambda a: a + 2 * (a - least_overlap(a, percent) + 1)
    best, best_cost = 0, None
    for b in range(SMALL_MOST + 1):
        cost = sum(n * ((subsets(a) if a <= b else 0) + (lists(a) if 100 * a >= percent * (b + 1) else 0)) for a, n in histogram.items())
        if best_cost is None or cost < best_cost:
            best, best_cost = b, cost
    return best


def text_hash(text: Column) -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    width: int = 5,
    percent: int = 80,
    block_tokens: int = 1_000_000,
    chunk: int = 512,
) -> DataFrame:
    """One row per row of docs: id, ``n_shingles``, ``component_id``, ``keeper``, ``text_hash``.

    ``component_id``: the smallest id reachable by links, own id included; a text
    without words links with nothing and is its own component.  Null and empty
    texts have no shingles.  Null ids are no id: a component of such rows alone has
    a null ``component_id``.  Repeated rows are texts with equal sets, so they are
    in one component.  ``keeper`` marks one row of each component, one with the
    smallest id.  Words are compared by 64-bit keys.  Texts of any length count
    whole.  Other columns, whatever their names, are not looked at.  An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"), text_hash(docs[text]).alias("hash"))
    blocks = work.put(B.make_blocks(rows, _BLOCK, B.text_weight, block_tokens, partial(_build, width=width)), "blocks")
    count = blocks.select("block").count()
    mask = short_keys(count)
    bare = blocks.select("block", "tokens", "words", "lengths")

    texts = blocks.select("block", F.posexplode(F.arrays_zip("ids", "sizes", "set1", "set2", "hashes")).alias("row", "t")).select(
        (F.shiftleft("block", B.ROW_BITS) + F.col("row")).alias("gid"), F.col("t.ids").alias("id"), F.col("t.sizes").alias("size"), "t.set1", "t.set2", F.col("t.hashes").alias("text_hash"),
    )
    sets = work.put(texts.where("size > 0").groupBy("size", "set1", "set2").agg(F.min("gid").alias("rep"), F.min("id").alias("least_id")), "sets")
    histogram = {r["size"]: r["count"] for r in sets.where(F.col("size") <= 2 * SMALL_MOST).groupBy("size").count().collect()}
    small = small_boundary(histogram, percent)

    levels, _ = B.exchange(work, "levels", bare.mapInArrow(partial(_ask, width=width, mask=mask), B.asked_schema(LEVELS)), count, LEVELS)
    reps = sets.select(F.shiftright("rep", B.ROW_BITS).alias("block"), F.col("rep").alias("gid"))
    told = levels.unionByName(reps, allowMissingColumns=True)
    entries = work.put(
        bare.groupBy("block").cogroup(told.groupBy("block"))
        .applyInArrow(lambda a, b: _entries(a, b, width, percent, small, mask), "kind int, key long, size long, gid long"), "entries")

    # Small sets: each text to the smallest with the same subset.
    subsets = entries.where("kind > 0")
    least = subsets.groupBy("kind", "key").agg(F.min(F.struct("size", "gid")).alias("p"))
    small_links = (
        subsets.join(least, ["kind", "key"])
        .where((F.col("gid") != F.col("p.gid")) & (100 * F.col("kind") >= percent * (F.col("size") + F.col("p.size") - F.col("kind"))))
        .select(F.col("gid").alias("i"), F.col("p.gid").alias("j"))
    )

    # Large sets: families of texts that share a list, in neighbouring size bands (a link spans one band at most).
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) - 1e-9)
    listed = entries.where("kind = 0").select("key", "gid", F.explode(F.array(band, band + 1)).alias("band"))
    heads = listed.groupBy("key", "band").agg(F.min("gid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    may_link = listed.join(heads, ["key", "band"]).where("gid != head").select(F.col("gid").alias("i"), F.col("head").alias("j")).distinct()
    families = work.put(connected_components(may_link), "families")
    sizes = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))
    members = families.join(sizes, "component").select(
        F.shiftright("node", B.ROW_BITS).alias("block"), F.col("node").alias("gid"), F.col("component").alias("family"), "chunks",
        F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"),
    )
    told = levels.unionByName(members, allowMissingColumns=True)
    bags = bare.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda a, b: _family_sets(a, b, width, mask), "family long, chunk long, chunks long, gid long, size long, elements binary")
    pairs = bags.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).select(
        "family", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunks", "gid", "size", "elements")
    # Families of one chunk share tasks; each pair of chunks of a larger family is a group.
    group = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("family"), F.lit(16 * max(8, count)))).otherwise(-1 - F.abs(F.xxhash64("family", "c1", "c2")))
    large_links = (
        pairs.withColumn("task", group).groupBy("task")
        .applyInArrow(lambda t: _compare(t, percent), "i long, j long")
    )
    links = work.put(small_links.unionByName(large_links), "links")
    groups = connected_components(links)

    reached = (
        sets.join(groups, sets["rep"] == groups["node"], "left")
        .select("size", "set1", "set2", "rep", "least_id", F.coalesce("component", "rep").alias("root"))
    )
    reached = work.put(reached, "reached")
    least_ids = reached.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = reached.join(least_ids, "root").select("size", "set1", "set2", "root", "component_id")
    found = work.put(
        texts.join(named, ["size", "set1", "set2"], "left")
        .select("gid", "id", "text_hash", "size", F.coalesce("root", F.col("gid")).alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "found")
    first = found.groupBy("root").agg(F.min_by("gid", F.struct(F.col("id").isNull(), "id", "gid")).alias("first"))
    return found.join(first, "root").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", (F.col("gid") == F.col("first")).alias("keeper"), "text_hash",
    )
