"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, twice over (a document may
be taken twice at most).  A queued copy's virtual finish time is the source's
cumulative words up to its end divided by the source's target; all copies are
range-sorted by that time and the sort is cut where the words taken reach the
total budget.

Both orders (by source and shuffle hash, by finish time) are range sorts whose
ranges Spark draws from samples, so a source that holds most rows, or a time at
which many copies finish, is spread like any other.  A running sum is the sum of
the ranges before, one number a range, plus a window within the range; no task
holds a whole source or the whole sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace

#: A word: no U+0020, no U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to targets: share * total words by cycled weight, no target above most * size.

    Capped sources are those with the smallest most * size / weight; the level of
    the rest follows from what the capped ones leave.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    everyone = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        ranked.withColumn("budget", share * F.sum("source_size").over(everyone))
        .withColumn("before", most * (F.sum("source_size").over(by_ratio) - F.col("source_size")))
        .withColumn("weight_left", F.sum("weight").over(everyone) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio")))
    return filled.withColumn("level", level.over(everyone)).select(
        "source", "source_size", "budget",
        F.coalesce(F.least(most * F.col("source_size"), F.col("level") * F.col("weight")), most * F.col("source_size")).alias("target"),
    )


def _running(work: Workspace, df: DataFrame, name: str, order: list[Column], value: str, by: str | None = None) -> DataFrame:
    """df with ``run``: the running sum of ``value`` in the given order, of each ``by`` on its own.

    ``order`` must begin with ``by`` and leave no two rows equal.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written at once: what a range holds must not change if a task runs again.
    ranged = work.put(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), name)
    keys = [by] if by else []
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    # At most one row a range, and one more a source.
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col("__range").alias("__r"), *[F.col(k).alias("__by") for k in keys], F.coalesce(before, F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("__by"))
    summed = ranged.withColumn("__own", F.sum(value).over(within)).join(F.broadcast(before) if ranges <= 100_000 and not keys else before, same)
    return summed.withColumn("run", F.col("__base") + F.col("__own")).drop("__range", "__r", "__by", "__base", "__own")


def text_hash(text: Column) -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size).

    The row's text hash ``text_hash`` comes along, so that (id, text_hash) finds a
    row's text again.  Null text has size 0; documents of size 0 are taken 0
    times.  Texts of any length count whole.  A null source is a source, last in
    order.  Shuffling is by a hash of id and text, hence the same in every run;
    rows equal in both are interchangeable.  Copies are taken whole: the one that
    would pass the budget is the first left out.  Other columns of docs, whatever
    their names, are not looked at.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    sizes = docs.select(
        docs[id_col].alias("doc"), docs[source].alias("source"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_hash(docs[text]).alias("text_hash"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc", "text_hash")).withColumn("row", F.monotonically_increasing_id())
    # Row numbers tell equal rows apart; once written they stay as they are.
    sizes = work.put(sizes, "sizes")
    targets = work.put(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    budget = (targets.agg(F.max("budget")).first() or [None])[0] or 0.0

    # Cumulative words of each source in shuffled order, and the copies' finish times.
    shuffled = [F.col("source").asc_nulls_last(), F.col("h"), F.col("row")]
    queue = _running(work, sizes, "shuffled", shuffled, "size", by="source")
    of = targets.select(F.col("source").alias("s"), "source_size", "target")
    queue = work.put(queue.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "queue")
    copies = (
        queue.where((F.col("size") > 0) & (F.col("target") > 0))
        .select("row", "h", "size", F.explode(F.array(*[F.lit(k) for k in range(most)])).alias("copy"), ((F.col("copy") * F.col("source_size") + F.col("run")) / F.col("target")).alias("finish"))
    )
    # The range sort, cut where the budget is reached.
    by_time = [F.col(c) for c in ("finish", "h", "row", "copy")]
    taken = _running(work, copies, "finish", by_time, "size").where(F.col("run") <= budget).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return queue.join(taken, "row", "left").select(
        F.col("doc").alias(id_col), "text_hash", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"),
    ).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
