"""Data quality, and agreement of two measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import vector_magnitude


def quality(df: DataFrame, limit: float = 10.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples, those missing by axis, their share of all values, the mean magnitude, and magnitudes above ``limit``."""
    v = vector_magnitude(F.col("x"), F.col("y"), F.col("z"))
    missing = [F.count_if(F.col(a).isNull() | F.isnan(a)).alias(f"missing_{a}") for a in "xyz"]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_samples"), *missing, F.avg(F.when(~F.isnan(v), v)).alias("mean_magnitude"), F.count_if(v > limit).alias("outliers"))
    lost = F.col("missing_x") + F.col("missing_y") + F.col("missing_z")
    return out.withColumn("percent_missing", F.try_divide(100.0 * lost, 3 * F.col("n_samples")))


def sample_rate(df: DataFrame, order: str = "epoch") -> DataFrame:
    """By subject: samples a second, from the median step of the timestamps."""
    step = (F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(Window.partitionBy("subject").orderBy(order))) / 1e6
    return df.withColumn("step", step).groupBy("subject").agg(F.try_divide(F.lit(1.0), F.median("step")).alias("sample_rate"), F.median("step").alias("median_step"))


def icc(x: Column, y: Column) -> Column:
    """An aggregate: variance of pairs' means against the mean variance within pairs."""
    between, within = F.var_samp((x + y) / 2), F.avg((x - y) * (x - y) / 2)
    within = F.when(within == 0, 1e-10).otherwise(within)
    return between / (between + within)


def validation(df: DataFrame, measured: str, reference: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of pairs that both are there: bias, errors, correlation, agreement and its limits."""
    x, y = F.col(measured), F.col(reference)
    d = x - y
    out = df.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.avg(F.when(y != 0, 100.0 * d / y)).alias("mpe"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.corr(x, y).alias("pearson_r"), icc(x, y).alias("icc"), F.stddev_samp(d).alias("sd"),
    )
    return out.withColumn("loa_lower", F.col("bias") - 1.96 * F.col("sd")).withColumn("loa_upper", F.col("bias") + 1.96 * F.col("sd")).drop("sd")


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the four outcomes and their ratios; null for 0/0."""
    out = df.where(predicted.isNotNull() & actual.isNotNull()).groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn")
    )
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return out.select(
        *keys, "tp", "tn", "fp", "fn", ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
