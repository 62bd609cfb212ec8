"""Consecutive numbers over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace


def with_ordinal(rows: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with ``name`` (long): the row's place in the order of ``keys``, counted from ``start``.

    Rows are range-sorted into parts that are written once; a row's number is its
    place in its part plus the sizes of the parts before, one number a part.
    ``keys`` should tell rows apart, else equal rows share an order by chance and
    one part; nulls come first; an empty table gives an empty table.
    """
    work = Workspace(rows.sparkSession, "ordinal")
    parts = work.put(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = sizes.select("__part", (upto - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    numbered = parts.withColumn("__place", place).join(before, "__part")
    return numbered.withColumn(name, (F.col("__before") + F.col("__place") + F.lit(start)).cast("long")).select(*rows.columns, name)
