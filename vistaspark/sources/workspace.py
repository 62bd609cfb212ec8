"""Places for intermediate tables, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Whether a query's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); where unset, a temporary one if all of Spark is on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master: {master})")
        root = "file://" + tempfile.mkdtemp(prefix="vistaspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let DataFrame.checkpoint() write to the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


class Workspace:
    """A fresh folder below the shared one; tables written here cut lineage and outlive executors.

    Results are read from these tables lazily, so the folder stays until the
    application ends; tables that nothing reads any more can be dropped before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        # Shuffle files go with the query that made them: every result here is written and read again.
        if spark.conf.get(_CLEANUP, "false") != "true":
            spark.conf.set(_CLEANUP, "true")
        path, files = self._at("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
        """Write df as Parquet and give it back read from there."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if compression:
            writer = writer.option("compression", compression)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        by = set(partition_by or ())
        fields = sorted(df.schema.fields, key=lambda f: f.name in by)
        return self.spark.read.schema(StructType(fields)).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, files = self._at(name)
        files.delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="vistaspark-ship-"), "vistaspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("vistaspark", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(out)
