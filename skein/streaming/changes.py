"""Keeping derived tables fresh from a log of committed changes.

A candidate state or an index table is a function of the graph; a refresh
recomputes it for the touched nodes alone. As a stream, ``follow`` does so for
each micro-batch of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refreshed(old: DataFrame, touched: DataFrame, recompute: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """``old`` with the rows of the touched keys computed anew. Null keys touch nothing; a key that yields no row goes."""
    keys = touched.select(F.col(key)).filter(F.col(key).isNotNull()).distinct()
    return old.join(keys, key, "left_anti").unionByName(recompute(keys), allowMissingColumns=True)


def follow(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply(touched, epoch)`` for each micro-batch of a streaming change log (a column id)."""
    return log.writeStream.foreachBatch(lambda batch, epoch: apply(batch.select("id").distinct(), epoch)).option("checkpointLocation", checkpoint).start()
