"""CSV and Parquet tables: predictions, manifests, the pair-score cache, reports."""

from __future__ import annotations

import hashlib
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaspark.config import Thresholds
from vistaspark.operators.order import with_ordinal
from vistaspark.schemas import PAIR_SCORE, REPORT


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, filename) of a predictions or manifest CSV, read by column name, as text."""
    rows = spark.read.option("header", "true").csv(path)
    missing = {"group_id", "filename"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path}: no column {sorted(missing)}")
    return rows.select("group_id", "filename")


def write_predictions(groups: DataFrame, path: str) -> None:
    """filename, group_id by group, then filename; groups numbered from 0 by least filename."""
    least = groups.groupBy("group_id").agg(F.min("filename").alias("least_name"))
    number = with_ordinal(least, ["least_name", "group_id"], "number").drop("least_name")
    out = groups.join(number, "group_id").select("filename", F.col("number").alias("group_id"))
    out.orderBy("group_id", "filename").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.select(*REPORT).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_pair_scores(scores: DataFrame, path: str) -> None:
    """All metrics but the indexes; confidence, inlier ratio and both structure scores with 4 decimals."""
    four = {"confidence", "inlier_ratio", "edge_score", "gradient_score"}
    names = [c.strip().split()[0] for c in PAIR_SCORE.split(",")][2:]
    cols = [F.format_string("%.4f", c).alias(c) if c in four else F.col(c) for c in names]
    scores.orderBy("i", "j").select(*cols).write.mode("overwrite").option("header", "true").option("positiveInf", "inf").csv(path)


def fingerprint(thresholds: Thresholds, max_size: int, features: int) -> str:
    """Settings that a cached score depends on."""
    return hashlib.sha256(repr((sorted(asdict(thresholds).items()), max_size, features)).encode()).hexdigest()[:16]


class PairCache:
    """Append-only Parquet folder of scored pairs; later rows win, other settings' rows are not seen."""

    def __init__(self, spark: SparkSession, path: str, settings: str):
        self.spark, self.path, self.settings = spark, path, settings

    def append(self, scores: DataFrame) -> None:
        stamped = scores.select("*", F.lit(self.settings).alias("settings"), F.current_timestamp().alias("written"))
        stamped.write.mode("append").parquet(self.path)

    def load(self, pairs: DataFrame, images: DataFrame) -> DataFrame:
        """Scores of the wanted pairs whose filenames still match, the last written of each."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], PAIR_SCORE)
        rows = self.spark.read.schema(PAIR_SCORE + ", settings string, written timestamp").parquet(self.path).where(F.col("settings") == self.settings)
        return expected(rows.dropna(subset=["i", "j", "filename_a", "filename_b", "decision", "confidence"]), pairs, images, "written")


def expected(rows: DataFrame, pairs: DataFrame, images: DataFrame, order: str) -> DataFrame:
    """Rows of wanted pairs whose filenames match by the row's own orientation; the last by ``order`` of each pair."""
    names = lambda i, f: images.select(F.col("index").alias(i), F.col("filename").alias(f))
    keyed = rows.withColumn("__i", F.least("i", "j")).withColumn("__j", F.greatest("i", "j"))
    wanted = pairs.select(F.least("i", "j").alias("__i"), F.greatest("i", "j").alias("__j")).distinct()
    fits = keyed.join(wanted, ["__i", "__j"], "left_semi").join(names("i", "__a"), "i").join(names("j", "__b"), "j").where("filename_a = __a and filename_b = __b")
    last = fits.withColumn("rn", F.row_number().over(Window.partitionBy("__i", "__j").orderBy(F.col(order).desc()))).where("rn = 1")
    return last.select(*[c.strip().split()[0] for c in PAIR_SCORE.split(",")])


def read_pair_scores(spark: SparkSession, path: str, report: dict | None = None) -> DataFrame:
    """A pair-score CSV with indexes, read by column name; infinite values by name.

    A row is left out where a number does not parse or is missing; empty texts are
    texts.  ``report`` gets the number of such rows as ``malformed``.
    """
    fields = [c.split() for c in PAIR_SCORE.split(",")]
    raw = spark.read.option("header", "true").option("nullValue", "\u0000").csv(path)
    have = {c for c in raw.columns}
    text = lambda n: F.trim(F.col(n)) if n in have else F.lit(None).cast("string")
    number = {
        "double": lambda n: F.expr(f"try_cast(trim(`{n}`) AS double)") if n in have else F.lit(None).cast("double"),
        "string": lambda n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit(None).cast("string"),
    }
    # Whole numbers are digits: "3.0" is none.
    whole = lambda n, kind: F.when(text(n).rlike(r"^[+-]?[0-9]+$"), F.expr(f"try_cast(trim(`{n}`) AS {kind})") if n in have else F.lit(None))
    rows = raw.select(*[(number[kind](n) if kind in number else whole(n, kind)).cast(kind).alias(n) for n, kind in fields])
    # NaN is a number here.
    sound = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n, _ in fields])
    if report is not None:
        report["malformed"] = rows.where(~sound).count()
    return rows.where(sound)
