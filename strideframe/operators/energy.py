"""METs over a window, and sums of energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import level_rank
from .islands import series


def crouter(axis1: Column) -> Column:
    """METs by the two-regression model, over an epoch with two before it and three after it."""
    frame = series().rowsBetween(-2, 3)
    cpe = axis1 / 6
    mean, sd, n = F.avg(cpe).over(frame), F.stddev_samp(cpe).over(frame), F.count(cpe).over(frame)
    cv = F.when(n < 3, 100.0).otherwise(F.when(mean > 0, sd / mean * 100).otherwise(0.0))
    log = F.ln(cpe)
    lifestyle = 0.749395 + 0.716431 * log - 0.179874 * log * log + 0.033173 * log * log * log
    return F.when(cpe <= 8, 1.0).when(cv <= 10, 2.294275 * F.exp(0.00084679 * cpe)).otherwise(lifestyle)


def energy_by_intensity(df: DataFrame) -> DataFrame:
    """By subject and class: kcal of wear epochs, and their share of all wear, epochs without a class included in the whole."""
    sums = df.where("wear_time").groupBy("subject", "intensity").agg(F.sum("kcal").alias("total_kcal"))
    out = sums.withColumn("percent_kcal", 100 * F.col("total_kcal") / F.sum("total_kcal").over(Window.partitionBy("subject")))
    return out.where("intensity is not null").withColumn("level", level_rank(F.col("intensity")))


def average_mets(df: DataFrame, daily: bool = False) -> DataFrame:
    """Mean METs of wear epochs by subject, or by subject and date."""
    return df.where("wear_time").groupBy(*(["subject", "date"] if daily else ["subject"])).agg(F.avg("mets").alias("average_mets"))
