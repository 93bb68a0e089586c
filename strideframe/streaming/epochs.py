"""Epochs of a stream of samples: an extension, for live data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_stream(samples: DataFrame, epoch_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Sums by subject and epoch of ``samples`` (subject, timestamp, axis1..3); an epoch is done when the watermark has passed it."""
    w = F.window("timestamp", f"{epoch_seconds} seconds")
    sums = samples.withWatermark("timestamp", late).groupBy("subject", w).agg(*[F.sum(a).alias(a) for a in ("axis1", "axis2", "axis3")], F.count("*").alias("n_samples"))
    return sums.select("subject", F.col("window.start").alias("timestamp"), "axis1", "axis2", "axis3", "n_samples")
