"""Request rate rule over logs of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RATE_LIMIT


def rate_violations(
    hits: DataFrame, limit: int = RATE_LIMIT, length: str = "5 minutes", step: str = "1 minute"
) -> DataFrame:
    """Windows in which a key has more than ``limit`` hits. ``hits`` has ``ts`` and ``key``."""
    counted = hits.groupBy(F.window("ts", length, step).alias("w"), "key").agg(F.count(F.lit(1)).alias("hits"))
    return counted.where(F.col("hits") > limit).select(
        "key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits"
    )
