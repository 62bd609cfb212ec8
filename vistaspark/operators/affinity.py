"""Affinity between groups of vectors: 0.55 * best member similarity + 0.45 * similarity of the means.

Groups lie in cells by the pivot nearest to their mean.  A cell's ball holds all
its members, a second ball its means, so a source's affinity to any group of a
cell is at most 0.55 (x . pivot + |x| radius) + 0.45 (mean . pivot + |mean| radius'),
x its best member.  Sources first meet their own cell; the k-th affinity found
there (or the least that counts) is what a cell's bound must reach to be met.

Groups larger than a block's share are split; parts of one pair are folded by
maximum, so no group is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.operators.knn import MOST_PIVOTS, fit_pivots, sample_rows
from vistaspark.sources.workspace import Workspace

_SLACK = 2e-6
_FOUND = "src long, dst long, best double, means double, src_n long, dst_n long, whole boolean"


def centroids(members: DataFrame) -> DataFrame:
    """(group_id, centroid): the mean descriptor, scaled to length 1 unless it is nearly zero.  Sums are taken batch by batch before they are exchanged."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("group_id", kind="stable")
            g = frame["group_id"].to_numpy()
            if g.size:
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                total = np.add.reduceat(np.array(frame["d"].tolist(), np.float64), starts)
                yield pd.DataFrame({"group_id": g[starts], "n": np.diff(np.append(starts, g.size)), "total": [t.tobytes() for t in total]})

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.sum([np.frombuffer(t) for t in frame["total"]], axis=0) / frame["n"].sum()
        norm = np.sqrt(m @ m)
        return pd.DataFrame({"group_id": [frame["group_id"].iloc[0]], "centroid": [(m / norm if norm > 1e-8 else m).tolist()]})

    plain = members.where("group_id IS NOT NULL").select(F.col("group_id").cast("long").alias("group_id"), F.col("descriptor").cast("array<double>").alias("d"))
    return plain.mapInPandas(sums, "group_id long, n long, total binary").groupBy("group_id").applyInPandas(mean, "group_id long, centroid array<double>")


class _Block:
    """Rows of some groups: each group's number, size, first row, mean, and whether all of it is here."""

    def __init__(self, ids: bytes, n: bytes, rows: bytes, means: bytes, dim: int):
        g = np.frombuffer(ids, np.int64)
        self.starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if g.size else np.zeros(0, np.int64)
        self.ids, self.n = g[self.starts], np.frombuffer(n, np.int64)[self.starts]
        self.rows, self.means = np.frombuffer(rows).reshape(-1, dim), np.frombuffer(means).reshape(-1, dim)
        self.whole = np.diff(np.append(self.starts, g.size)) == self.n

    def by_group(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.starts, axis=0)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["group_id", "index"])
    g = frame["group_id"].to_numpy(np.int64)
    first = np.concatenate([[True], g[1:] != g[:-1]])
    x, c = np.array(frame["d"].tolist(), np.float64), np.array(frame["centroid"][first].tolist(), np.float64)
    return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "part": [frame["part"].iloc[0]], "ids": [g.tobytes()], "n": [frame["n"].to_numpy(np.int64).tobytes()], "rows": [x.tobytes()], "means": [c.tobytes()], "dim": [x.shape[1]]})


_BLOCK = "cell int, part int, ids binary, n binary, rows binary, means binary, dim int"


def group_affinity(
    members: DataFrame, source: Column, target: Column, least: float | None = None, ratio: float | None = None, k: int | None = None,
    block_rows: int = 2048, report: dict | None = None,
) -> DataFrame:
    """(src, dst, affinity, src_n, dst_n) of pairs of enough affinity (``least``) and like size (``ratio``); with ``k``, those among which each source's k best are.

    ``source`` and ``target`` are conditions on (group_id, n).  ``report`` gets the
    share of pairs of rows that were multiplied.
    """
    work = Workspace(members.sparkSession, "affinity")
    chosen = members.where(source | target)
    named = work.put(
        chosen.select("group_id", "n", "index", F.col("descriptor").cast("array<double>").alias("d"), source.alias("is_source"), target.alias("is_target"))
        .join(centroids(chosen), "group_id"), "named")
    count = named.where("is_target").count()
    wanted = min(MOST_PIVOTS, max(1, -(-count // block_rows)))
    pivots = np.zeros((0, 1))
    if wanted > 1:
        one = named.where("is_target").groupBy("group_id").agg(F.first("centroid").alias("v")).select(F.col("group_id").alias("i"), "v")
        sample = sample_rows(one, 32 * wanted)
        pivots = fit_pivots(sample, min(wanted, len(sample)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, c = np.array(frame["d"].tolist(), np.float64), np.array(frame["centroid"].tolist(), np.float64)
                cell = ((pivots**2).sum(1) - 2 * c @ pivots.T).argmin(1)
                yield frame.assign(cell=cell.astype(np.int32), off=np.linalg.norm(x - pivots[cell], axis=1), mean_off=np.linalg.norm(c - pivots[cell], axis=1))

    schema = "group_id long, n long, index long, d array<double>, is_source boolean, is_target boolean, centroid array<double>"
    cells = max(1, len(pivots))
    radius, mean_radius, sizes = np.full(cells, -np.inf), np.full(cells, -np.inf), np.zeros(cells, np.int64)
    source_sizes = np.zeros(cells, np.int64)
    if len(pivots):
        plain = named.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
        placed = work.put(plain.mapInPandas(place, f"{schema}, cell int, off double, mean_off double"), "placed")
    else:
        placed = named.withColumn("cell", F.lit(0)).withColumn("off", F.lit(float("inf"))).withColumn("mean_off", F.lit(float("inf")))
    only = lambda c: F.when(F.col("is_target"), F.col(c))
    for r in placed.groupBy("cell").agg(F.max(only("off")).alias("a"), F.max(only("mean_off")).alias("b"), F.count(only("n")).alias("t"), F.count(F.when(F.col("is_source"), 1)).alias("s")).collect():
        if r["t"]:
            radius[r["cell"]], mean_radius[r["cell"]], sizes[r["cell"]] = r["a"], r["b"], r["t"]
        source_sizes[r["cell"]] = r["s"]
    parts, source_parts = (np.maximum(1, -(-n // block_rows)) for n in (sizes, source_sizes))
    # A group of more rows than a block's is dealt by row, others whole.
    spread = F.when(F.col("n") > block_rows, F.xxhash64("group_id", "index")).otherwise(F.xxhash64("group_id"))

    def blocks(rows: DataFrame, of: np.ndarray, name: str) -> DataFrame:
        dealt = rows.withColumn("part", F.pmod(spread, F.get(F.lit([int(p) for p in of]), F.col("cell"))).cast("int"))
        return work.put(dealt.select("cell", "part", "group_id", "n", "index", "d", "centroid").groupBy("cell", "part").applyInPandas(_pack, _BLOCK), name)

    sources, targets = blocks(placed.where("is_source"), source_parts, "sources"), blocks(placed.where("is_target"), parts, "targets")

    def bound(b: _Block) -> np.ndarray:
        """The most that each group's affinity to a group of each cell can be."""
        if not len(pivots):
            return np.full((len(b.ids), 1), np.inf)
        best = b.by_group(b.rows @ pivots.T + np.linalg.norm(b.rows, axis=1)[:, None] * radius)
        return 0.55 * np.maximum(best, -1.0) + 0.45 * (b.means @ pivots.T + np.linalg.norm(b.means, axis=1)[:, None] * mean_radius)

    def visits(r, floor: np.ndarray, others: bool) -> Iterator[pd.DataFrame]:
        """A source block's groups for the target blocks that can hold what they ask for."""
        b = _Block(r.ids, r.n, r.rows, r.means, r.dim)
        meets = (bound(b) >= (floor - _SLACK)[:, None]) & (sizes > 0)
        if others:
            meets[:, r.cell] = False
        each = np.diff(np.append(b.starts, len(b.rows)))
        g, n = np.frombuffer(r.ids, np.int64), np.frombuffer(r.n, np.int64)
        for c in np.flatnonzero(meets.any(0)):
            some, row = meets[:, c], np.repeat(meets[:, c], each)
            for p in range(parts[c]):
                yield pd.DataFrame({"cell": [np.int32(c)], "part": [np.int32(p)], "ids": [g[row].tobytes()], "n": [n[row].tobytes()], "rows": [b.rows[row].tobytes()], "means": [b.means[some].tobytes()], "dim": [r.dim]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                a, b = _Block(r.ids, r.n, r.rows, r.means, r.dim), _Block(r.ids_b, r.n_b, r.rows_b, r.means_b, r.dim)
                best = np.maximum.reduceat(a.by_group(a.rows @ b.rows.T), b.starts, axis=1)
                means = a.means @ b.means.T
                affinity = 0.55 * np.maximum(best, -1.0) + 0.45 * means
                whole = a.whole[:, None] & b.whole
                keep = a.ids[:, None] != b.ids
                if ratio is not None:
                    keep &= np.maximum(a.n[:, None], b.n) <= ratio * np.minimum(a.n[:, None], b.n)
                if least is not None:
                    keep &= ~whole | (affinity >= least)
                if k is not None and b.ids.size > k:
                    shown = np.where(keep & whole, affinity, -np.inf)
                    keep &= ~whole | (shown >= np.partition(shown, b.ids.size - k, axis=1)[:, b.ids.size - k][:, None])
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"src": a.ids[i], "dst": b.ids[j], "best": best[i, j], "means": means[i, j], "src_n": a.n[i], "dst_n": b.n[j], "whole": whole[i, j]})

    def found(asking: DataFrame) -> DataFrame:
        other = targets.select("cell", "part", *[F.col(c).alias(f"{c}_b") for c in ("ids", "n", "rows", "means")])
        pairs = asking.join(other, ["cell", "part"]).mapInPandas(meet, _FOUND)
        # Pairs with a split group are folded over its parts.
        split = pairs.where("NOT whole").groupBy("src", "dst", "src_n", "dst_n").agg(F.max("best").alias("best"), F.first("means").alias("means"))
        both = pairs.where("whole").select("src", "dst", "best", "means", "src_n", "dst_n").unionByName(split)
        scored = both.select("src", "dst", (0.55 * F.greatest("best", F.lit(-1.0)) + 0.45 * F.col("means")).alias("affinity"), "src_n", "dst_n")
        return scored if least is None else scored.where(F.col("affinity") >= least)

    lowest = -np.inf if least is None else least
    if k is None or not len(pivots):
        def all_visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    yield from visits(r, np.full(1, lowest), False)

        asking = work.put(sources.mapInPandas(all_visits, _BLOCK), "visits")
        out = found(asking)
    else:
        near = sources.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.lit([int(p) - 1 for p in parts]), F.col("cell"))))).select(*[c.split()[0] for c in _BLOCK.split(", ")])
        first = work.put(found(near), "first")
        order = Window.partitionBy("src").orderBy(F.col("affinity").desc(), F.col("dst").desc())
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("src").alias("group_id"), F.col("affinity").alias("floor"))
        homes = sources.select("cell", "part", "ids").mapInPandas(_homes, "cell int, part int, group_id long").join(kth, "group_id")

        def further(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            r = next(left.itertuples(index=False))
            ids = np.unique(np.frombuffer(r.ids, np.int64))
            floor = np.full(ids.size, lowest)
            floor[np.searchsorted(ids, right["group_id"].to_numpy())] = right["floor"].to_numpy()
            out = list(visits(r, floor, True))
            return pd.concat(out) if out else left.iloc[:0]

        asking = work.put(sources.groupBy("cell", "part").cogroup(homes.groupBy("cell", "part")).applyInPandas(further, _BLOCK), "visits")
        out = first.unionByName(found(asking))
    if report is not None:
        rows = lambda t, name: t.select("cell", "part", (F.octet_length("ids") / 8).alias(name))
        met = rows(asking, "a").join(rows(targets, "b"), ["cell", "part"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        own = float((sizes.astype(float) * source_sizes).sum()) if k is not None and len(pivots) else 0.0
        report["share"] = (met + own) / max(1.0, float(sizes.sum()) * float(source_sizes.sum()))
    return out


def _homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            ids = np.unique(np.frombuffer(r.ids, np.int64))
            yield pd.DataFrame({"cell": np.int32(r.cell), "part": np.int32(r.part), "group_id": ids})
