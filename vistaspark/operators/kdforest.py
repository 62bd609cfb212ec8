"""Approximate nearest neighbours: a forest of randomised kd-trees, searched best bin first under a budget of checks.

Trees are fitted on a bounded sample, every row is placed in one leaf of each, and
leaves are the keys by which rows meet: nothing meets every block.  A row's leaves,
those of all trees together, are taken by their distance bounds, nearest first,
until they hold as many rows as the budget allows; a leaf's visitors and members
are one matrix product.

The budget is measured, not guessed: for a bounded set of probe rows the true
neighbours are found in one pass over the table, each is as many checks away as
the leaves before its own hold, and the budget is the quantile of those numbers
that the wanted recall asks for.  Vectors in clusters need few checks; vectors
without structure need a large share of the table, and get it: where that is over
half of all rows, all rows meet in the blocks of a grid, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.operators.grid import Grid
from vistaspark.sources.workspace import Workspace

DECIMALS = 6
#: A split's dimension is drawn from so many of largest variance.
_WIDEST = 5
#: Leaves a tree at most, and sampled rows a leaf; rows of a leaf in one part at most.
MOST_LEAVES, _PER_LEAF, _PART = 1 << 14, 16, 4096


@dataclass
class Tree:
    """A complete binary tree: node k has children 2k + 1 and 2k + 2; the last ``leaves`` places are leaves."""

    dims: np.ndarray
    cuts: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.dims) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
        """Medians of the sample, level by level, in dimensions drawn among the widest of each node."""
        dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        held = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for k, rows in enumerate(held):
                x = sample[rows] if rows.size else sample
                wide = np.argsort(-x.var(0), kind="stable")[:_WIDEST]
                dim = int(rng.choice(wide))
                cut = float(np.median(x[:, dim]))
                dims[2**level - 1 + k], cuts[2**level - 1 + k] = dim, cut
                right = sample[rows, dim] > cut
                below += [rows[~right], rows[right]]
            held = below
        return cls(dims, cuts)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while at.size and at[0] < len(self.dims):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.dims[at]] > self.cuts[at])
        return at - len(self.dims)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Summed squares of what parts each row from each leaf; a child's bound is never below its parent's, so sorting leaves by it is best bin first."""
        out, first = np.zeros((len(x), 1)), 0
        while first < len(self.dims):
            n = out.shape[1]
            gap = x[:, self.dims[first : first + n]] - self.cuts[first : first + n]
            both = np.stack([out + np.maximum(gap, 0) ** 2, out + np.maximum(-gap, 0) ** 2], axis=2)
            out, first = both.reshape(len(x), 2 * n), first + n
        return out


def leaf_order(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Leaves of all trees (tree by tree numbered on), nearest first, for each row."""
    return np.argsort(np.hstack([t.bounds(x) for t in forest]), axis=1, kind="stable")


def _similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T
    return np.round(1 - np.maximum(square, 0) / 2, DECIMALS) + 0.0


def _k_best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s[a[:, None] == b[None, :]] = -np.inf
    if b.size <= k:
        return np.nonzero(s > -np.inf)
    kth = np.partition(s, b.size - k, axis=1)[:, b.size - k]
    return np.nonzero((s >= kth[:, None]) & (s > -np.inf))


def measured_checks(placed: DataFrame, probes: pd.DataFrame, forest: list[Tree], sizes: np.ndarray, k: int, recall: float) -> tuple[int, int]:
    """(checks, trees) that bring ``recall`` of the probes' true k nearest with fewest checks, from one pass over the table.

    Rows met in several trees are checked several times, so few trees are best for
    vectors without structure, many for vectors in clusters.
    """
    ids, x = probes["i"].to_numpy(), np.array(probes["v"].tolist(), np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                b = frame["i"].to_numpy()
                s = _similarity(x, np.array(frame["v"].tolist(), np.float64))
                u, v = _k_best(ids, b, s, k)
                yield pd.DataFrame({"q": u, "j": b[v], "sim": s[u, v], "leaves": pd.Series([list(frame["leaves"].iloc[n]) for n in v], dtype=object)})

    order = Window.partitionBy("q").orderBy(F.col("sim").desc(), "j")
    near = placed.mapInPandas(run, "q long, j long, sim double, leaves array<int>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()
    if near.empty:
        return 1, 1
    found, trees = [], 1
    while trees <= len(forest):
        taken = leaf_order(forest[:trees], x)
        held = np.cumsum(sizes[taken], axis=1)
        place = np.argsort(taken, axis=1)
        needed = [held[q, min(place[q, leaf] for leaf in leaves[:trees])] for q, leaves in zip(near["q"], near["leaves"])]
        found.append((int(np.quantile(needed, recall, method="higher")), trees))
        trees *= 2
    return min(found)


def search(
    rows: DataFrame, k: int, sampled: Callable[[DataFrame, int], np.ndarray], work: Workspace, trees: int = 4, leaf_rows: int = 64,
    recall: float = 0.9, checks: int | None = None, probes: int = 128, seed: int = 1, report: dict | None = None,
    kind: type = np.float64,
) -> DataFrame:
    """(i, j, sim): candidates among which each row's nearest are, over distinct rows (i, v).

    ``checks``: rows looked at for each row, over all trees; None: measured for
    ``recall`` (with 0.03 on top for what probes leave open) on ``probes`` rows.
    ``report`` gets the checks, the trees that were used, the leaves of each, and the
    share of all pairs that were multiplied.  ``kind``: what vectors are packed as where all meet.
    """
    count = rows.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(MOST_LEAVES, count / leaf_rows))))))
    sample = sampled(rows, _PER_LEAF << depth)
    rng = np.random.default_rng(seed)
    forest = [Tree.fit(sample, depth, rng) for _ in range(trees if depth else 1)]
    leaves = 1 << depth
    first = np.arange(len(forest)) * leaves

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame["v"].tolist(), np.float64)
                yield frame.assign(leaves=pd.Series((np.stack([t.leaf(x) for t in forest], axis=1) + first).tolist(), index=frame.index))

    placed = work.put(rows.mapInPandas(place, "i long, v array<double>, leaves array<int>"), "placed")
    sizes = np.zeros(len(forest) * leaves, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    if checks is None:
        asked = placed.select("i", "v", F.xxhash64(F.lit("probe"), F.col("i")).alias("h")).orderBy("h", "i").limit(probes).select("i", "v").toPandas()
        checks, used = measured_checks(placed, asked, forest, sizes, k, min(1.0, recall + 0.03)) if len(asked) else (1, 1)
        forest, sizes = forest[:used], sizes[: used * leaves]
        if 2 * checks > count:
            grid = Grid(rows, count, sample.shape[1], work, _PART, kind, distance=True)
            if report is not None:
                report |= {"checks": checks, "trees": 0, "leaves": 1, "share": grid.share}
            return grid.top_k(k).select("i", "j", "sim")
    at = F.slice("leaves", 1, len(forest))
    parts = np.maximum(1, -(-sizes // _PART))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 22) // max(sizes.size, min(_PART, int(sizes.max(initial=1)))))
        for frame in frames:
            for lo in range(0, len(frame), step):
                some = frame.iloc[lo : lo + step]
                ids, x = some["i"].to_numpy(), np.array(some["v"].tolist(), np.float64)
                order = leaf_order(forest, x)
                held = np.cumsum(sizes[order], axis=1)
                # A leaf is taken as long as those before it hold fewer rows than the budget.
                taken = (held - sizes[order] < checks) & (sizes[order] > 0)
                u, v = np.nonzero(taken)
                leaf = order[u, v]
                by = np.argsort(leaf, kind="stable")
                u, leaf = u[by], leaf[by]
                starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if leaf.size else []
                for a, b in zip(starts, [*starts[1:], leaf.size]):
                    for p in range(parts[leaf[a]]):
                        yield pd.DataFrame({"leaf": [np.int32(leaf[a])], "part": [np.int32(p)], "ids": [ids[u[a:b]].tobytes()], "rows": [x[u[a:b]].tobytes()], "dim": [x.shape[1]]})

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["v"].tolist(), np.float64)
        return pd.DataFrame({"leaf": [frame["leaf"].iloc[0]], "part": [frame["part"].iloc[0]], "ids_b": [frame["i"].to_numpy(np.int64).tobytes()], "rows_b": [x.tobytes()]})

    part = F.pmod(F.xxhash64("i"), F.get(F.lit([int(p) for p in parts]), F.col("leaf"))).cast("int")
    members = placed.select("i", "v", F.explode(at).alias("leaf")).withColumn("part", part).groupBy("leaf", "part").applyInPandas(pack, "leaf int, part int, ids_b binary, rows_b binary")
    visits = work.put(placed.select("i", "v").mapInPandas(visit, "leaf int, part int, ids binary, rows binary, dim int"), "visits")
    members = work.put(members, "members")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                a, b = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids_b, np.int64)
                s = _similarity(np.frombuffer(r.rows).reshape(-1, r.dim), np.frombuffer(r.rows_b).reshape(-1, r.dim))
                u, v = _k_best(a, b, s, k)
                yield pd.DataFrame({"i": a[u], "j": b[v], "sim": s[u, v]})

    if report is not None:
        met = visits.join(members, ["leaf", "part"]).agg(F.sum(F.octet_length("ids") / 8 * F.octet_length("ids_b") / 8)).first()[0] or 0
        report |= {"checks": checks, "trees": len(forest), "leaves": leaves, "share": met / max(1, count) ** 2}
    # One pair can be found in several trees.
    return visits.join(members, ["leaf", "part"]).mapInPandas(meet, "i long, j long, sim double").groupBy("i", "j").agg(F.max("sim").alias("sim"))
