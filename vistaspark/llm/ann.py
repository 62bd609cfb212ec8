"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has a long string of sign bits per tree (random hyperplanes, at
right angles within each group of as many as the vectors have components); a
tree is the array of these strings in sorted order.  A query descends each tree
to its longest prefix match, then all trees ascend together, a bit a step, until
the entries that share the prefix in some tree are enough; those, and no others,
are compared exactly.  Rows lie in blocks of bounded size with a forest each; a
block answers every query chunk, and a query's answers from all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace

BITS = 32
#: Trees hashed at a time.
_TREES = 16


def hyperplanes(dim: int, trees: int, seed: int) -> np.ndarray:
    """Normals of the trees' hyperplanes, in columns; groups of ``dim`` of them are orthogonal."""
    groups = -(-trees * BITS // dim)
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((groups, dim, dim)))
    return np.ascontiguousarray(q.transpose(1, 0, 2).reshape(dim, -1)[:, : trees * BITS])


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(trees, rows) of 32-bit strings."""
    out = []
    for lo in range(0, planes.shape[1], _TREES * BITS):
        signs = (vectors @ planes[:, lo : lo + _TREES * BITS] > 0).reshape(len(vectors), -1, BITS)
        out.append(np.packbits(signs, axis=2).view(">u4")[:, :, 0].T.astype(np.uint32))
    return np.concatenate(out)


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.planes = hyperplanes(vectors.shape[1], trees, seed)
        strings = hash_strings(vectors, self.planes)
        order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, order, axis=1)
        #: All trees' entries, tree by tree.
        self.entries = order.astype(np.int32).ravel()
        self.start = np.arange(trees) * len(ids)

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per depth (1 to BITS), tree and query: the tree's entries that share that many bits with the query."""
        low, high = (np.empty((BITS, *strings.shape), np.int32) for _ in range(2))
        for d in range(1, BITS + 1):
            first = strings >> np.uint32(BITS - d) << np.uint32(BITS - d)
            last = first + np.uint32((1 << (BITS - d)) - 1)
            for t, row in enumerate(self.sorted):
                low[d - 1, t] = np.searchsorted(row, first[t])
                high[d - 1, t] = np.searchsorted(row, last[t], side="right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, enough: int) -> np.ndarray:
        """Rows that share the query's prefix in some tree, at the greatest common depth at which they are enough.

        low, high: the query's ranges by depth and tree.  All rows, if even one bit is too much.
        """
        sizes = high - low
        deep = np.flatnonzero(sizes.sum(axis=1) >= enough)
        for d in range(deep[-1] if deep.size else -1, -1, -1):
            size = sizes[d].astype(np.int64)
            at = np.repeat(self.start + low[d] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit = np.zeros(len(self.ids), bool)
            hit[self.entries[at]] = True
            if np.count_nonzero(hit) >= enough:
                return np.flatnonzero(hit)
        return np.arange(len(self.ids))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Each query's id, its k nearest of the candidates, their scores, and how many rows were compared."""
        enough = max(k + 1, int(np.ceil(share * len(self.ids))))
        for lo in range(0, len(queries), 256):
            low, high = self.ranges(hash_strings(queries[lo : lo + 256], self.planes))
            for i, (q, qid) in enumerate(zip(queries[lo : lo + 256], query_ids[lo : lo + 256])):
                at = self.candidates(low[:, :, i], high[:, :, i], enough)
                at = at[self.ids[at] != qid]
                if not at.size:
                    continue
                rows = self.vectors[at]
                near, compared, size = rows @ q / self.norms[at], at.size, np.sqrt((q * q).sum())
                if at.size > k:
                    close = near >= np.partition(near, -k)[-k] - 1e-9 * size
                    at, rows = at[close], rows[close]
                # Summed row by row in one order, so equal vectors have equal scores.
                score = (rows * q).sum(axis=1) / (self.norms[at] * size)
                best = np.lexsort((self.ids[at], -score))[:k]
                yield qid, self.ids[at][best], score[best], compared


def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list]] = {}
        made = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pd.DataFrame:
            nonlocal made
            ids, rows_ = held.pop(dim)
            made += 1
            m = np.array(rows_, np.float64)
            return pd.DataFrame({name: [made], "dim": [dim], f"{name}_ids": [np.array(ids, np.int64).tobytes()], f"{name}_rows": [m.tobytes()]})

        for frame in frames:
            for i, v in zip(frame["id"], frame["vector"]):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInPandas(pack, f"{name} long, dim int, {name}_ids binary, {name}_rows binary")


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    k: int = 5,
    trees: int = 256,
    share: float = 0.25,
    block_rows: int = 8192,
    query_rows: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score, compared): each query's ``k`` nearest by cosine found in the index over all ``vectors``.

    A block is searched until ``share`` of its rows, k + 1 at least, are candidates,
    whatever its size; ``trees`` and ``share`` are recall settings and drop no row
    from the index.  ``compared``: rows of all blocks that the query was multiplied
    with.  Vectors that are null, empty or zero, or hold null or non-finite
    components take no part on either side, nor do null ids.  Vectors meet only
    vectors of their length.  Rows with the query's id are its own and never its
    neighbours; repeated rows of one id count once.  Ties go to the smaller id.
    Other columns, whatever their names, are not looked at.  An empty table gives
    an empty table.
    """
    work = Workspace(vectors.sparkSession, "forest")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        return (
            df.select(df[id_col].cast("long").alias("id"), df[vector].cast("array<double>").alias("vector"))
            .where(F.col("id").isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))
        )

    blocks = work.put(_packed(usable(vectors), block_rows, "block"), "blocks")
    chunks = work.put(_packed(usable(queries), query_rows, "chunk"), "chunks")
    # A stated query set against all rows, in blocks: a chunk is sent to every block of its dimension, by a list of
    # block numbers that has 8 bytes for each ``block_rows`` rows.
    lists = blocks.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    meetings = chunks.join(lists, "dim").select(F.explode("blocks").alias("block"), "chunk_ids", "chunk_rows")
    pairs = blocks.hint("shuffle_merge").join(meetings, "block")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, forest = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if last != r.block:
                    forest = Forest(np.frombuffer(r.block_ids, np.int64), np.frombuffer(r.block_rows).reshape(-1, r.dim), trees, seed)
                    last = r.block
                found = list(forest.nearest(np.frombuffer(r.chunk_ids, np.int64), np.frombuffer(r.chunk_rows).reshape(-1, r.dim), k, share))
                if found:
                    sizes = [len(x) for _, x, _, _ in found]
                    # A query's work in this block stands in its first row here.
                    work_done = np.zeros(sum(sizes), np.int64)
                    work_done[np.cumsum([0, *sizes[:-1]])] = [n for _, _, _, n in found]
                    yield pd.DataFrame({
                        "query_id": np.repeat([q for q, _, _, _ in found], sizes).astype(np.int64),
                        "vec_id": np.concatenate([x for _, x, _, _ in found]),
                        "score": np.concatenate([s for _, _, s, _ in found]),
                        "compared": work_done,
                    })

    found = work.put(pairs.mapInPandas(search, "query_id long, vec_id long, score double, compared long"), "found")
    compared = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    # Repeated rows of one id count once.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.join(compared, "query_id").select("query_id", "rank", "vec_id", "score", "compared")
