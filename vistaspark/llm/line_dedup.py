"""Removal of lines that many documents share.

Method: levelled sorted runs of line hashes.  Documents arrive in batches; a
batch's line counts are merge-anti-joined against the settled run (keys found in
enough documents, whose fate does not change any more), the rest becomes a new
sorted run at level 0, and a level that has collected ``fanout`` runs is merged
into one run of the next level.  A batch's keys are looked up in all runs, and
those that reach the threshold are merged into the settled run.

Runs are tables bucketed and sorted by key, with as many buckets as a shuffle has
partitions: batches are exchanged once, when they are counted, and every
anti-join, lookup and merge after that is a merge join bucket by bucket.
DataFrame functions only: no Python touches a row.

A line's key is held as two 64-bit hashes, so runs have fixed-width rows
whatever the lines' lengths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace

#: Code points stripped from both ends of a line: U+0020, U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased (no other letter changes)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


_KEY = ["h1", "h2"]


@dataclass
class LineRuns:
    """Sorted runs of (h1, h2, n_docs), by level, and the settled run; each run covers other documents than the rest."""

    spark: SparkSession
    work: Workspace
    min_docs: int
    buckets: int
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=lambda: [[]])
    settled: str | None = None
    _made: list[str] = field(default_factory=list)

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._made.append(name)
        run.select(*_KEY, "n_docs").write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.work.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.work.drop(name)

    def _merge(self, names: list[str]) -> str:
        """One run of several, by full merge joins."""
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n_docs", "more").hint("merge"), _KEY, "full_outer")
            return both.select(*_KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

        return self._write(reduce(two, map(self.spark.table, names)))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's counts against the settled run, add what is left as a run, settle, compact."""
        if self.settled:
            batch = batch.join(self.spark.table(self.settled).hint("merge"), _KEY, "left_anti")
        new = self._write(batch)
        total = self.spark.table(new)
        for name in [n for level in self.levels for n in level]:
            other = self.spark.table(name).withColumnRenamed("n_docs", "more").hint("merge")
            total = total.join(other, _KEY, "left").select(*_KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))
        ripe = self._write(total.where(F.col("n_docs") >= self.min_docs))
        if self.settled:
            before = [self.settled, ripe]
            self.settled = self._merge(before)
            self._drop(before)
        else:
            self.settled = ripe
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(old))
            self.levels[level] = []
            self._drop(old)
            level += 1

    def close(self) -> DataFrame:
        """The settled keys, read from their files; all other runs go."""
        path = f"{self.work.path}/{self.settled}"
        self._drop([n for level in self.levels for n in level])
        for name in self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(path).select(*_KEY)


def drop_shared_lines(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """docs with every line dropped whose key occurs in at least ``min_docs`` documents.

    Adds ``line_count`` (before dropping), ``line_dropped`` and ``line_kept`` (what
    is left, joined by \\n); the input's columns stay as they are, an input column
    of one of these three names gives way.

    Null or empty text: one empty line, kept (its key is shorter than
    ``min_chars``).  Null ids are ids like any other.  Rows that agree in id and
    text are one document and all get its result; rows that share only the id are
    different documents.  An empty table gives an empty table.  All rows count;
    ties do not arise, since a key's lines all stay or all go.  Lines of a key that
    is in very many documents are one side of a semi-join that adaptive execution
    splits; nothing is grouped by key alone.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "line-dedup")
    own = ["line_count", "line_dropped", "line_kept"]
    docs = docs.drop(*own)
    body = F.coalesce(F.col(text), F.lit(""))
    me = [F.col(id_col).alias("doc"), F.xxhash64(body).alias("th")]
    key = line_key(F.col("line"))
    lines = (
        docs.select(*me, F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
        .select("doc", "th", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            F.pmod(F.xxhash64("doc", "th"), F.lit(batches)).cast("int").alias("batch"),
            "doc", "th", "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), F.col("key")).alias("h2"),
        )
    )
    lines = work.put(lines, "lines", ["batch"])
    runs = LineRuns(spark, work, min_docs, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for b in range(batches):
        batch = (
            lines.where(F.col("batch") == b).select("doc", "th", "h1", "h2").distinct()
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        )
        runs.add(batch)
    dropped = (
        lines.join(runs.close(), _KEY, "left_semi")
        .groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    )
    th = F.xxhash64(body)
    joined = docs.join(dropped, docs[id_col].eqNullSafe(F.col("__doc")) & (th == F.col("__th")), "left")
    parts = F.split(body, "\n", -1)
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.size(parts).cast("long").alias("line_count"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("line_dropped"),
        F.when(F.col("__gone").isNull(), body).otherwise(kept).alias("line_kept"),
    )


