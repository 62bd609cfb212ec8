"""Image folders as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.operators.order import with_ordinal
from vistaspark.sources.exif import orientation

CORE_SUFFIXES = ("jpg", "jpeg")
WRAPPER_SUFFIXES = ("jpg", "jpeg", "png")


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def with_index(paths: DataFrame, key: str = "path") -> DataFrame:
    """paths with ``index``: its place from 0 in the order of ``key``."""
    return with_ordinal(paths, [key], "index").select("index", *paths.columns)


def list_images(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = CORE_SUFFIXES) -> DataFrame:
    """(index, path, filename) of the folder's images, sorted by path; raises if there are none."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(map(_any_case, suffixes)) + "}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    found = reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))
    found = found.where(F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(*suffixes))
    if found.isEmpty():
        raise ValueError(f"no images in {folder}")
    return with_index(found)


def _orientations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"origin": frame["origin"], "orientation": [orientation(bytes(x)) for x in frame["content"]]})


def read_images(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = CORE_SUFFIXES) -> DataFrame:
    """(index, path, filename, height, width, channels, data, orientation): decoded pixels in BGR order, as stored.

    ``orientation`` (1 to 8, from a JPEG's EXIF segment) says how they are to be turned;
    what takes the pixels does so.  A file that cannot be decoded has height -1; the
    feature stage raises on it.
    """
    index = list_images(spark, folder, recursive, suffixes)

    def files(kind: str, of: tuple[str, ...]) -> DataFrame:
        reader = spark.read.format(kind).option("pathGlobFilter", "*.{" + ",".join(map(_any_case, of)) + "}")
        return (reader.option("recursiveFileLookup", "true") if recursive else reader).option("dropInvalid", "false").load(folder)

    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    pixels = files("image", suffixes).select(
        plain("image.origin").alias("__origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    found = index.join(pixels, plain("path") == F.col("__origin"), "left").drop("__origin")
    jpeg = tuple(x for x in suffixes if x in CORE_SUFFIXES)
    if not jpeg:
        return found.withColumn("orientation", F.lit(1))
    turned = files("binaryFile", jpeg).select(plain("path").alias("origin"), "content").mapInPandas(_orientations, "origin string, orientation int")
    return found.join(turned, plain("path") == F.col("origin"), "left").withColumn("orientation", F.coalesce("orientation", F.lit(1))).drop("origin")
