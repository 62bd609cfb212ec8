"""Similarity joins of vectors: exact top-k, threshold and all-pairs joins over pivot cells, and an approximate join over a kd-forest.

Exact joins: rows go to the cell of their nearest pivot, cells lie in blocks of
bounded size, and a row meets a cell only if the cell's ball can hold what it
asks for: x . y <= x . pivot + |x| radius for every y of the cell.  A threshold
join asks for its threshold; a top-k join first meets the row's own cell and then
asks for its k-th similarity found there.  A meeting is one matrix product, and
only what a row needs leaves the task.

Where a sample says that balls leave a row more than half of all others to meet,
they are of no use: rows then lie in few large blocks, every two of which meet once
(grid).

Equal vectors are one row in top-k joins, whatever their number.  Similarities
are rounded to 6 decimals before anything is compared, ties go to the smaller
partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.operators import kdforest
from vistaspark.operators.grid import Grid
from vistaspark.sources.workspace import Workspace

DECIMALS = 6
#: Pivots, which every task is sent, are at most so many rows, and what they are fitted on at most so many bytes.
MOST_PIVOTS, SAMPLE_BYTES = 1024, 1 << 26
_SLACK = 2e-6
_PAIRS = "i long, j long, sim double"


def _rows(vectors: DataFrame, index: str, vector: str) -> DataFrame:
    return vectors.select(F.col(index).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("i").isNotNull())


def sample_rows(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` rows, and ``SAMPLE_BYTES`` bytes, the first by a hash of their index."""
    head = rows.select(F.size("v").alias("d")).first()
    if head is None:
        return np.zeros((0, 1))
    most = max(1, min(most, SAMPLE_BYTES // (8 * max(1, head["d"]))))
    taken = rows.select("v", F.xxhash64("i").alias("h"), "i").orderBy("h", "i").limit(most).select("v").toPandas()
    return np.array(taken["v"].tolist(), np.float64)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """``count`` means of the sample's rows (Lloyd's rounds from evenly taken rows)."""
    pivots = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        near = np.argmin((pivots**2).sum(1) - 2 * sample @ pivots.T, axis=1)
        for c in np.unique(near):
            pivots[c] = sample[near == c].mean(0)
    return pivots


#: Rows that tell what balls leave to meet, and the share of all from which on they are of no use.
_PROBES, _USELESS = 128, 0.5


def _kth_similarity(rows: DataFrame, probes: np.ndarray, k: int) -> np.ndarray:
    """Each probe's similarity that k rows besides itself reach, from one pass over the table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(probes), k + 1), -np.inf)
        for frame in frames:
            if len(frame):
                s = probes @ np.array(frame["v"].tolist(), np.float64).T
                best = np.partition(np.hstack([best, s]), s.shape[1], axis=1)[:, -k - 1 :]
        yield pd.DataFrame({"best": [best.tobytes()]})

    parts = rows.select("v").mapInPandas(run, "best binary").toPandas()["best"]
    best = np.hstack([np.frombuffer(b).reshape(len(probes), -1) for b in parts])
    return np.sort(best, axis=1)[:, -k - 1]


class Cells:
    """Rows (i, v) in blocks (cell, part, ids, rows, dim), the pivots, and each cell's radius and number of rows."""

    def __init__(self, rows: DataFrame, work: Workspace, name: str, block_rows: int, kind: type = np.float64):
        self.rows, self.work, self.name, self.block_rows, self.kind = rows, work, name, block_rows, kind
        self.count = rows.count()
        wanted = min(MOST_PIVOTS, max(1, -(-self.count // block_rows)))
        self.sample = sample_rows(rows, 32 * wanted) if wanted > 1 else np.zeros((0, 1))
        self.pivots = fit_pivots(self.sample, min(wanted, len(self.sample))) if wanted > 1 else self.sample

    def rules_out(self, least: float | None = None, k: int | None = None) -> bool:
        """Whether balls rule out half of all pairs or more, by the sample: of rows that ask for ``least``, or for their k-th similarity."""
        sample, pivots = self.sample, self.pivots
        if not len(pivots) or least is None and k is None:
            return False
        square = (sample**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * sample @ pivots.T
        cell, radius = square.argmin(1), np.full(len(pivots), -np.inf)
        np.maximum.at(radius, cell, np.linalg.norm(sample - pivots[cell], axis=1))
        probes = sample[:_PROBES]
        floor = np.full(len(probes), least) if k is None else _kth_similarity(self.rows, probes, k)
        meets = probes @ pivots.T + np.linalg.norm(probes, axis=1)[:, None] * radius >= (floor - _SLACK)[:, None]
        return float((meets @ np.bincount(cell, minlength=len(pivots))).mean()) <= _USELESS * len(sample)

    def grid(self, distance: bool = False) -> Grid:
        """The same rows in few large blocks."""
        return Grid(self.rows, self.count, self.sample.shape[1], self.work, self.block_rows, self.kind, distance)

    def build(self) -> Cells:
        """Rows to their cells, cells to their blocks."""
        rows, work, name, block_rows, kind, pivots = self.rows, self.work, self.name, self.block_rows, self.kind, self.pivots

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.array(frame["v"].tolist(), np.float64)
                    square = np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)
                    cell = square.argmin(1)
                    yield frame.assign(cell=cell.astype(np.int32), off=np.linalg.norm(x - pivots[cell], axis=1))

        if len(pivots):
            placed = work.put(rows.mapInPandas(place, "i long, v array<double>, cell int, off double"), f"{name}-placed")
            told = placed.groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
            self.radius, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
            for r in told:
                self.radius[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
        else:
            placed, self.radius, sizes = rows.withColumn("cell", F.lit(0)), np.full(1, np.inf), np.array([self.count])
        self.sizes = sizes
        self.parts = np.maximum(1, -(-sizes // block_rows))
        parts = F.get(F.lit([int(p) for p in self.parts]), F.col("cell"))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("i")
            x = np.array(frame["v"].tolist(), np.float64)
            return pd.DataFrame({"cell": [int(frame["cell"].iloc[0])], "part": [int(frame["part"].iloc[0])], "ids": [frame["i"].to_numpy(np.int64).tobytes()], "rows": [x.astype(kind).tobytes()], "dim": [x.shape[1]]})

        dealt = placed.select("i", "v", "cell", F.pmod(F.xxhash64("i"), parts).cast("int").alias("part"))
        self.blocks = work.put(dealt.groupBy("cell", "part").applyInPandas(pack, "cell int, part int, ids binary, rows binary, dim int"), f"{name}-blocks")
        return self

    def _bound(self) -> tuple[Callable, np.ndarray]:
        """What tasks need of the cells: pivots, radii and parts, no more than MOST_PIVOTS rows."""
        pivots, radius, parts = self.pivots, self.radius, self.parts

        def reach(x: np.ndarray) -> np.ndarray:
            return x @ pivots.T + np.linalg.norm(x, axis=1)[:, None] * radius if len(pivots) else np.full((len(x), 1), np.inf)

        return reach, parts

    def own(self, keep: Callable, once: bool = False) -> DataFrame:
        """(cell, part, i, j, sim) of rows of one cell that ``keep(ids, ids, products)`` chooses; ``once``: i < j, each pair of blocks meets once."""
        kind, (_, parts) = self.kind, self._bound()
        last = F.get(F.lit([int(p) for p in parts]), F.col("cell")) - 1
        left = self.blocks.withColumn("other", F.explode(F.sequence(F.col("part") if once else F.lit(0), last.cast("int"))))
        right = self.blocks.select("cell", F.col("part").alias("other"), F.col("ids").alias("ids_b"), F.col("rows").alias("rows_b"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    for a, b, s, _ in _products(r, kind):
                        if once and r.part == r.other:
                            s[a[:, None] >= b[None, :]] = -np.inf
                        u, v = keep(a, b, s)
                        i, j = (np.minimum(a[u], b[v]), np.maximum(a[u], b[v])) if once else (a[u], b[v])
                        yield pd.DataFrame({"cell": np.int32(r.cell), "part": np.int32(r.part), "i": i, "j": j, "sim": s[u, v]})

        return left.join(right, ["cell", "other"]).mapInPandas(run, f"cell int, part int, {_PAIRS}")

    def visits(self, asked: DataFrame | None, least: float | None, onwards: bool) -> DataFrame:
        """Packs of rows for the blocks of other cells that can hold what they ask for.

        ``asked``: (cell, part, i, least); else all ask for ``least`` (None: for all).
        ``onwards``: cells after the row's own alone.
        """
        kind, (reach, parts) = self.kind, self._bound()

        def packs(cell: int, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> Iterator[pd.DataFrame]:
            meets = reach(x) >= (floor - _SLACK)[:, None]
            meets[:, : cell + 1 if onwards else 0] = False
            meets[:, cell] = False
            for c in np.flatnonzero(meets.any(0)):
                some = meets[:, c]
                for p in range(parts[c]):
                    yield pd.DataFrame({"cell": [np.int32(c)], "part": [np.int32(p)], "ids": [ids[some].tobytes()], "rows": [x[some].astype(kind).tobytes()], "floor": [floor[some].tobytes()], "dim": [x.shape[1]]})

        schema = "cell int, part int, ids binary, rows binary, floor binary, dim int"
        if asked is None:
            floor = -np.inf if least is None else least

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for r in frame.itertuples(index=False):
                        ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, kind).reshape(-1, r.dim).astype(np.float64)
                        yield from packs(r.cell, ids, x, np.full(len(ids), floor))

            return self.blocks.mapInPandas(run, schema)

        def told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            r = left.iloc[0]
            ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], kind).reshape(-1, r["dim"]).astype(np.float64)
            floor = np.full(len(ids), -np.inf)
            floor[np.searchsorted(ids, right["i"].to_numpy())] = right["least"].to_numpy()
            out = list(packs(int(r["cell"]), ids, x, floor))
            return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("cell", "part", "ids", "rows", "floor", "dim")})

        return self.blocks.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(told, schema)

    def meet(self, visits: DataFrame, keep: Callable) -> DataFrame:
        """(i, j, sim) that ``keep(ids, ids, products)`` chooses of what visitors find and asked for.

        A block's visitors are dealt over slots, about eight packs each, and a block is
        sent once a slot; so neither its visitors nor copies of it come together.
        """
        kind, slots = self.kind, max(1, -(-int(self.parts.sum()) // 8))
        keys = ["cell", "part", "slot"]
        asking = visits.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
        other = self.blocks.select("cell", "part", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("ids").alias("ids_b"), F.col("rows").alias("rows_b"))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "sim": np.zeros(0)})]
            for block in right.itertuples(index=False):
                for r in left.itertuples(index=False):
                    for a, b, s, floor in _products(r, kind, block):
                        s[s < floor[:, None]] = -np.inf
                        u, v = keep(a, b, s)
                        out.append(pd.DataFrame({"i": a[u], "j": b[v], "sim": s[u, v]}))
            return pd.concat(out)

        return asking.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(run, _PAIRS)

    def share(self, visits: DataFrame) -> float:
        """The share of all pairs of rows (both ways) that were multiplied: own cells and visits."""
        sizes = self.blocks.select("cell", "part", (F.octet_length("ids") / 8).alias("n"))
        met = visits.select("cell", "part", (F.octet_length("ids") / 8).alias("m")).join(sizes, ["cell", "part"]).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
        return (float((self.sizes.astype(float) ** 2).sum()) + (met or 0)) / max(1, self.count) ** 2


def _products(r, kind: type, block=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(ids, other ids, products, what the rows ask for), some rows at a time."""
    block = r if block is None else block
    a, b = np.frombuffer(r.ids, np.int64), np.frombuffer(block.ids_b, np.int64)
    x = np.frombuffer(r.rows, kind).reshape(-1, r.dim).astype(np.float64)
    y = np.frombuffer(block.rows_b, kind).reshape(-1, r.dim).astype(np.float64)
    floor = np.frombuffer(r.floor) if hasattr(r, "floor") else None
    for lo in range(0, len(a), 1024):
        some = slice(lo, lo + 1024)
        yield a[some], b, np.round(x[some] @ y.T, DECIMALS) + 0.0, None if floor is None else floor[some]


def _kind(vectors: DataFrame, vector: str) -> type:
    """What vectors are packed as: single precision where they are given so, which loses nothing."""
    return np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def _best(k: int) -> Callable:
    """Chooses each row's k best products with others and all equal to the k-th."""
    def keep(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s[a[:, None] == b[None, :]] = -np.inf
        if b.size <= k:
            return np.nonzero(s > -np.inf)
        kth = np.partition(s, b.size - k, axis=1)[:, b.size - k]
        return np.nonzero((s >= kth[:, None]) & (s > -np.inf))

    return keep


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy(F.col("sim").desc(), F.col("j"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, min_similarity: float | None, index: str = "index", vector: str = "descriptor", block_rows: int = 4096, report: dict | None = None) -> DataFrame:
    """(i, j, sim) with i < j and sim >= min_similarity; None: all pairs.  ``report`` gets the share of pairs that were multiplied."""
    work = Workspace(vectors.sparkSession, "similar")
    cells = Cells(_rows(vectors, index, vector), work, "cells", block_rows, _kind(vectors, vector))
    if len(cells.pivots) and min_similarity is not None and not cells.rules_out(min_similarity):
        grid = cells.grid()
        if report is not None:
            report["share"] = grid.share
        return grid.similar(min_similarity)
    cells.build()
    floor = -np.inf if min_similarity is None else min_similarity

    def enough(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((s >= floor) & (s > -np.inf))

    found = cells.own(enough, once=True).select("i", "j", "sim")
    if len(cells.pivots):
        visits = cells.visits(None, min_similarity, True)
        other = cells.meet(visits, enough)
        found = found.unionByName(other.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim"))
        if report is not None:
            report["share"] = cells.share(visits)
    return found


def similar_forest(
    vectors: DataFrame, levels: list[float], like: str, within: float, index: str = "index", vector: str = "descriptor", block_rows: int = 4096, report: dict | None = None,
) -> DataFrame:
    """(i, j, sim), i < j: of the pairs whose ``like`` differ by at most ``within``, enough for the components at each level.

    For components alone: those of the pairs here that reach a level are those of all
    that do.  Where balls rule out most pairs, all pairs are given.
    """
    work = Workspace(vectors.sparkSession, "forest")
    asking = vectors.select(F.col(index).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(like).cast("double").alias("like"))
    asking = asking.where(F.col("v").isNotNull() & F.col("i").isNotNull() & F.col("like").isNotNull())
    cells = Cells(asking, work, "cells", block_rows, _kind(vectors, vector))
    if len(cells.pivots) and cells.rules_out(min(levels)):
        pairs = similar_pairs(vectors, min(levels), index, vector, block_rows, report)
        side = lambda i, l: asking.select(F.col("i").alias(i), F.col("like").alias(l))
        return pairs.join(side("i", "a"), "i").join(side("j", "b"), "j").where(F.abs(F.col("a") - F.col("b")) <= within).select("i", "j", "sim")
    grid = cells.grid()
    if report is not None:
        report["share"] = grid.share
    return grid.forest(levels, within)


def distinct_vectors(rows: DataFrame, keep: int, work: Workspace) -> tuple[DataFrame, DataFrame, bool]:
    """Equal vectors as one: (i, v, ids) with the least index and the ``keep`` least; (copy, i) for all rows; whether any are equal.

    Vectors are told apart by two 64-bit hashes.
    """
    keyed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), F.col("v")))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("i"))
    few = keyed.select("h1", "h2", "i").withColumn("place", place).where(F.col("place") <= keep)
    heads = work.put(few.groupBy("h1", "h2").agg(F.min("i").alias("head"), F.array_sort(F.collect_list("i")).alias("ids")), "heads")
    if heads.where(F.size("ids") > 1).isEmpty():
        return rows, rows.select(F.col("i").alias("copy"), "i"), False
    one = rows.join(heads.select(F.col("head").alias("i"), "ids"), "i")
    return one, keyed.select(F.col("i").alias("copy"), "h1", "h2").join(heads, ["h1", "h2"]).select("copy", F.col("head").alias("i")), True


def _to_copies(near: DataFrame, heads: DataFrame, copies: DataFrame, k: int, own: DataFrame) -> DataFrame:
    """Neighbours of distinct vectors handed to all rows: a vector's k + 1 first partners hold the k first of each of its copies."""
    ids = heads.select(F.col("i").alias("j"), "ids")
    each = near.select("i", "j", "sim").unionByName(own).join(ids, "j").select("i", F.explode("ids").alias("j"), "sim")
    lists = _ranked(each, k + 1).groupBy("i").agg(F.collect_list(F.struct("j", "sim")).alias("near"))
    told = copies.join(lists, "i").select(F.col("copy").alias("i"), F.explode("near").alias("n")).where(F.col("i") != F.col("n.j"))
    return _ranked(told.select("i", "n.j", "n.sim"), k)


def _own_products(heads: DataFrame) -> DataFrame:
    square = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return heads.where(F.size("ids") > 1).select("i", F.col("i").alias("j"), F.round(square, DECIMALS).alias("sim"))


def top_k(vectors: DataFrame, k: int, index: str = "index", vector: str = "descriptor", block_rows: int = 4096, report: dict | None = None) -> DataFrame:
    """(i, j, sim, rank): each row's k most similar others.  ``report`` gets the share of pairs that were multiplied."""
    work = Workspace(vectors.sparkSession, "top-k")
    heads, copies, some = distinct_vectors(_rows(vectors, index, vector), k + 1, work)
    if some:
        heads = work.put(heads, "distinct")
    cells = Cells(heads.select("i", "v"), work, "cells", block_rows, _kind(vectors, vector))
    if len(cells.pivots) and not cells.rules_out(k=k):
        grid = cells.grid()
        if report is not None:
            report["share"] = grid.share
        near = grid.top_k(k)
        return _to_copies(near, heads, copies, k, _own_products(heads)) if some else near
    cells.build()
    near = _ranked(cells.own(_best(k)), k)
    if len(cells.pivots):
        first = work.put(near, "first")
        kth = first.groupBy("cell", "part", "i").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(float("-inf"))).alias("least"))
        visits = cells.visits(kth, None, False)
        near = _ranked(first.select("i", "j", "sim").unionByName(cells.meet(visits, _best(k))), k)
        if report is not None:
            report["share"] = cells.share(visits)
    return _to_copies(near, heads, copies, k, _own_products(heads)) if some else near.select("i", "j", "sim", "rank")


def undirected(pairs: DataFrame) -> DataFrame:
    """(i, j, sim) with i < j, once each, with the larger similarity."""
    return pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("sim").alias("sim"))


def candidate_pairs(vectors: DataFrame, max_candidates: int, disable_pruning: bool = False, **kw) -> DataFrame:
    """Pairs worth scoring: the union of both directions of a top-k join; all pairs if k does not prune."""
    count = vectors.count()
    if disable_pruning or max_candidates <= 0 or max_candidates >= count - 1:
        return similar_pairs(vectors, None, **kw)
    return undirected(top_k(vectors, max_candidates, **kw))


def neighbor_pairs(vectors: DataFrame, neighbors: int, min_similarity: float | None, **kw) -> DataFrame:
    """Top-k first, then the similarity floor, then one row a pair."""
    found = top_k(vectors, neighbors, **kw)
    return undirected(found if min_similarity is None else found.where(F.col("sim") >= min_similarity))


def approximate_top_k(vectors: DataFrame, k: int, index: str = "index", vector: str = "descriptor", recall: float = 0.9, report: dict | None = None, **kw) -> DataFrame:
    """(i, j, sim, rank): about ``recall`` of each row's k nearest others by Euclidean distance d, sim = 1 - d^2 / 2, without a floor.

    Equal vectors are one in the forest.  ``kw`` and ``report``: see ``kdforest.search``.
    """
    work = Workspace(vectors.sparkSession, "approximate")
    heads, copies, some = distinct_vectors(_rows(vectors, index, vector), k + 1, work)
    heads = work.put(heads, "distinct")
    near = _ranked(kdforest.search(heads.select("i", "v"), k, sample_rows, work, recall=recall, report=report, kind=_kind(vectors, vector), **kw), k)
    own = heads.where(F.size("ids") > 1).select("i", F.col("i").alias("j"), F.lit(1.0).alias("sim")) if some else None
    return _to_copies(near, heads, copies, k, own) if some else near


def approximate_neighbor_pairs(vectors: DataFrame, neighbors: int, **kw) -> DataFrame:
    """Approximate form of ``neighbor_pairs`` without a floor: one row a pair of ``approximate_top_k``."""
    return undirected(approximate_top_k(vectors, neighbors, **kw))
