"""The driver's ``events`` as an epoch series; the same as SQL is in ``plans/sql/_epochs.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUBJECTS = 4
#: How lively each quarter of an hour is, in turn.
PACE = [5, 30, 150, 20, 60]
MASS, AGE = 70.0, 12.0


def epochs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes in order of event_id for each of four subjects: still before seven and in some stretches, else paced by quarter hours."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    subject = F.concat(F.lit("s"), (F.col("user_id") % SUBJECTS).cast("string"))
    e = e.select(subject.alias("subject"), "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    e = e.withColumn("epoch", F.row_number().over(Window.partitionBy("subject").orderBy("event_id")).cast("long"))
    i, h = F.col("epoch") - 1, F.col("event_id") * 7919 % 1000
    pace = F.element_at(F.array(*[F.lit(float(p)) for p in PACE]), (F.floor(i / 15) % len(PACE) + 1).cast("int"))
    still = F.when(h < 30, h * 3.0).otherwise(0.0)
    axis1 = F.when((i % 1440 < 420) | (F.floor(i / 200) % 4 == 1), still).otherwise(F.floor(F.col("value") * pace).cast("double"))
    ts = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + i * 60000000)
    out = e.select("subject", "epoch", ts.alias("timestamp"), F.to_date(ts).alias("date"), axis1.alias("axis1"), h.alias("h"))
    return out.select(
        "subject", "epoch", "timestamp", "date", "axis1", F.floor(F.col("axis1") * 0.5 + F.col("h") % 50).cast("double").alias("axis2"),
        F.floor(F.col("axis1") * 0.25 + F.col("h") % 30).cast("double").alias("axis3"), F.floor(F.col("axis1") / 50).cast("double").alias("steps"),
    )


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples about one g on y, still but where the epochs are lively."""
    e = epochs_from_events(spark, sf_dir)
    k = F.col("epoch")
    move = F.when(F.col("axis1") > 500, F.col("axis1") / 10000).otherwise(0.0)
    return e.select("subject", k.alias("sample"), "timestamp", (0.02 + move * (k % 3)).alias("x"), (1.01 + move * (k % 5 - 2)).alias("y"), (0.01 - move * (k % 2)).alias("z"))

