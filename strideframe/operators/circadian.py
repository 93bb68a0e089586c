"""Circadian measures: hourly profile, L5 and M10, stability and variability, cosinor.

All of them follow from one table with a row for each subject, date and hour (a cube of
sums). What an hour or a subject has in all is a window over that table, and days and
subjects are groups of it, so the epochs are gone through once for all measures together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS = 24


def worn_counts(df: DataFrame, counts: str = "axis1") -> Column:
    """The counts of wear epochs; null elsewhere, and for NaN."""
    return F.when(F.col("wear_time") & ~F.isnan(counts), F.col(counts))


def hourly_profile(df: DataFrame, value: Column) -> DataFrame:
    """By subject, all 24 hours: mean, standard deviation (null under two values) and number of values."""
    n = F.sum("k")
    mean = F.try_divide(F.sum("sy"), n)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.sum("syy") - n * mean * mean, F.lit(0.0)) / (n - 1)))
    hours = by_hour(df, value).groupBy("subject", "hour").agg(mean.alias("mean_activity"), spread.alias("sd_activity"), n.alias("n"))
    known = hours.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("hour", F.struct("mean_activity", "sd_activity", "n")))).alias("h"))
    whole = known.select("subject", "h", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour")).withColumn("h", F.try_element_at("h", F.col("hour")))
    return whole.select("subject", "hour", "h.mean_activity", "h.sd_activity", F.coalesce("h.n", F.lit(0)).alias("n"))


def extreme(means: Column, x: int, least: bool) -> Column:
    """Of 24 hourly means the mean over the ``x`` hours in a row, around midnight if need be, that is least (or largest), and their first hour as (v, start); of equal ones the first. Null without a mean."""
    known = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.lit(x - 1)), lambda i: F.get(means, (s + i) % HOURS)), F.isnotnull)
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, v: t + v), F.size(a))
    windows = F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda s: F.struct(mean(known(s)).alias("v"), s.alias("start")))
    ordered = F.transform(F.filter(windows, lambda w: w["v"].isNotNull()), lambda w: F.struct((w["v"] if least else -w["v"]).alias("order"), w["start"].alias("start"), w["v"].alias("v")))
    return F.array_min(ordered)


def _rest(means: Column) -> list[Column]:
    """L5 and M10 with their first hours, and the relative amplitude, of 24 hourly means."""
    l5, m10 = extreme(means, 5, True), extreme(means, 10, False)
    clock = lambda e: F.when(e.isNotNull(), F.format_string("%02d:00", e["start"]))
    return [l5["v"].alias("l5"), clock(l5).alias("l5_start"), m10["v"].alias("m10"), clock(m10).alias("m10_start"), relative_amplitude(m10["v"], l5["v"]).alias("ra")]


def by_hour(df: DataFrame, value: Column) -> DataFrame:
    """The cube: by subject, date and hour the number of values, their sum and mean, and the sums of the cosine's equations."""
    angle = (F.hour("timestamp") + F.minute("timestamp") / 60 + F.second("timestamp") / 3600) * (2 * math.pi / 24)
    v = df.select("subject", "date", F.hour("timestamp").alias("hour"), value.alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    y, c, s = F.col("y"), F.when(F.col("y").isNotNull(), F.col("c")), F.when(F.col("y").isNotNull(), F.col("s"))
    sums = {"sy": y, "sc": c, "ss": s, "syy": y * y, "scc": c * c, "sss": s * s, "syc": y * c, "sys": y * s, "scs": c * s}
    return v.groupBy("subject", "date", "hour").agg(F.count(y).alias("k"), F.avg(y).alias("x"), *[F.sum(e).alias(n) for n, e in sums.items()])


SUMS = ("sy", "sc", "ss", "syy", "scc", "sss", "syc", "sys", "scs")


def by_day(cube: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject and date the 24 means of its hours, and what of the subject's measures is a sum over days."""
    hours, whole = Window.partitionBy("subject", "hour"), Window.partitionBy("subject")
    slots = cube.withColumn("mean", F.avg("x").over(whole))
    # Of an hour over all days: the mean of its values, and the mean of its means.
    slots = slots.withColumn("all", F.try_divide(F.sum("sy").over(hours), F.sum("k").over(hours))).withColumn("xh", F.avg("x").over(hours))
    # The step from the present hour before, over hours without values.
    before = F.last("x", True).over(whole.orderBy("date", "hour").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("step", F.col("x") - before)
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct("hour", v)))  # noqa: E731  a day has 24 at most
    days = slots.groupBy("subject", "date").agg(
        entries("x").alias("own"), entries("all").alias("all"), entries("xh").alias("xh"), F.first("mean").alias("mean"), F.sum("k").alias("k"),
        F.count("x").alias("slots"), F.sum((F.col("x") - F.col("mean")) ** 2).alias("total"), F.sum(F.col("step") ** 2).alias("steps"), *[F.sum(n).alias(n) for n in SUMS],
    )
    means = F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.try_element_at("own", h))
    return days.withColumn("own", means).withColumn("enough", F.col("k") >= 12 * 3600 / epoch_seconds)


def by_subject(days: DataFrame) -> DataFrame:
    """By subject: days, those with enough values, the means of its hours (24 of values as ``all``, 24 of means as ``xh``), and the sums."""
    hourly = lambda name: F.array(*[F.max(F.try_element_at(name, F.lit(h))) for h in range(HOURS)])
    return days.groupBy("subject").agg(
        F.count("*").alias("n_days"), F.count_if("enough").alias("n_valid_days"), hourly("all").alias("all"), hourly("xh").alias("xh"), F.first("mean").alias("mean"),
        *[F.sum(n).alias(n) for n in ("k", "slots", "total", "steps", *SUMS)],
    )


def relative_amplitude(m10: Column, l5: Column) -> Column:
    return F.when(m10 + l5 != 0, (m10 - l5) / (m10 + l5))


def rest_activity(df: DataFrame, value: Column) -> DataFrame:
    """By subject L5 and M10 with their first hours, and the relative amplitude; a subject without values has no row."""
    hours = by_hour(df, value).groupBy("subject", "hour").agg(F.try_divide(F.sum("sy"), F.sum("k")).alias("m")).where("m is not null")
    means = hours.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("hour", "m"))).alias("m"))
    return means.select("subject", *_rest(F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.try_element_at("m", h))))


def daily_rest_activity(df: DataFrame, value: Column, epoch_seconds: float = 60) -> DataFrame:
    """The same for each date; null where under twelve hours have values."""
    return _daily(by_day(by_hour(df, value), epoch_seconds))


def _daily(days: DataFrame) -> DataFrame:
    return days.select("subject", "date", *_rest(F.when(F.col("enough"), F.col("own"))))


def stability_and_variability(df: DataFrame, value: Column, least: int = 48) -> DataFrame:
    """By subject: interdaily stability and intradaily variability of the means by date and hour; null under ``least`` values."""
    return by_subject(by_day(by_hour(df, value))).select("subject", *_stability(least))


def _stability(least: int = 48) -> list[Column]:
    n = F.col("slots")
    between = F.aggregate(F.filter("xh", F.isnotnull), F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean")))
    ok = (F.col("k") >= least) & (F.col("total") > 0)
    stability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n * between / (HOURS * F.col("total"))))
    variability = F.when(n > 1, F.try_divide(n * F.col("steps"), (n - 1) * F.col("total")))
    return [F.when(ok, stability).alias("interdaily_stability"), F.when(ok, variability).alias("intradaily_variability")]


def cosinor(df: DataFrame, value: Column, least: int = 24) -> DataFrame:
    """By subject, the least-squares cosine of 24 hours: mesor, amplitude, acrophase (hours), peak hour, R squared and p of the F test.

    The normal equations come from one aggregate. With two degrees of freedom the tail of F is a power of 1 - R squared.
    """
    sums = by_hour(df, value).groupBy("subject").agg(*[F.sum(n).alias(n) for n in ("k", *SUMS)])
    fitted = sums.select("subject", F.col("k").alias("n"), *_wave(least))
    return fitted.where("mesor is not null")


def _wave(least: int = 24) -> list[Column]:
    """The cosine's measures from the sums; null under ``least`` values, or where they don't tell it."""
    n = F.col("k")
    mean = lambda a: F.try_divide(F.col(f"s{a}"), n)
    both = lambda a, b: F.try_divide(F.col(f"s{a}{b}"), n) - mean(a) * mean(b)
    vy, vc, vs, yc, ys, cs = both("y", "y"), both("c", "c"), both("s", "s"), both("y", "c"), both("y", "s"), both("c", "s")
    det = vc * vs - cs * cs
    ok = (n >= least) & (det > 1e-12)
    solved = lambda c: F.when(ok, c)
    beta, gamma = F.try_divide(yc * vs - ys * cs, det), F.try_divide(ys * vc - yc * cs, det)
    # A constant has none of its variance explained; rounding mustn't make some of it.
    r2 = F.when(vy > 1e-12 * F.greatest(F.lit(1.0), F.try_divide(F.col("syy"), n)), (beta * yc + gamma * ys) / vy)
    acrophase = F.pmod(F.atan2(-gamma, beta) * (24 / (2 * math.pi)), F.lit(24.0))
    return [
        solved(mean("y") - beta * mean("c") - gamma * mean("s")).alias("mesor"), solved(F.sqrt(beta**2 + gamma**2)).alias("amplitude"),
        solved(acrophase).alias("acrophase"), solved(F.pmod(F.lit(24.0) - acrophase, F.lit(24.0))).alias("peak_hour"),
        solved(r2).alias("r_squared"), solved(F.pow(1 - r2, (n - 3) / 2)).alias("p_value"),
    ]


@dataclass
class Rhythm:
    """A row of measures for each subject, the hourly profile and the daily rows; none computed before it is asked for."""

    summary: DataFrame
    hourly: DataFrame
    daily: DataFrame


def rhythm(df: DataFrame, value: Column, epoch_seconds: float = 60) -> Rhythm:
    """All measures: rest and activity, stability and variability, the cosine, days and those with enough values; one pass over the epochs."""
    days = by_day(by_hour(df, value), epoch_seconds)
    summary = by_subject(days).select("subject", "n_days", "n_valid_days", *_rest(F.col("all")), *_stability(), *_wave())
    return Rhythm(summary, hourly_profile(df, value), _daily(days))


def group_profile(df: DataFrame, value: Column) -> DataFrame:
    """By hour: the mean over subjects of their means, and how many subjects have one."""
    return hourly_profile(df, value).groupBy("hour").agg(F.avg("mean_activity").alias("mean_activity"), F.count("mean_activity").alias("n_subjects"))


def group_rest_activity(df: DataFrame, value: Column) -> DataFrame:
    """Means over subjects of L5, M10 and the relative amplitude."""
    return rest_activity(df, value).agg(F.count("*").alias("n_subjects"), *[F.avg(c).alias(f"mean_{c}") for c in ("l5", "m10", "ra")])
