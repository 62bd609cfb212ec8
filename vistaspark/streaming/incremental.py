"""Scoring as a stream of pair requests: each micro-batch scores what the cache lacks and appends it.

A batch is idempotent: a rerun finds its pairs in the cache, and of two rows for
a pair the last wins, so restarts neither lose nor double scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vistaspark.config import Thresholds
from vistaspark.operators.scoring import score_pairs
from vistaspark.sources.tables import PairCache


def score_stream(requests: DataFrame, features: DataFrame, images: DataFrame, cache: PairCache, checkpoint: str, t: Thresholds = Thresholds(), once: bool = True) -> StreamingQuery:
    """Start scoring a stream of (i, j) into the cache; ``once``: what is there now, then stop."""

    def batch(pairs: DataFrame, number: int) -> None:
        score_pairs(pairs.select("i", "j").distinct(), features, images, t, cache).count()

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
