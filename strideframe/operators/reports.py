"""Conditional sums over epochs in the layouts of the reports.

A policy says which epochs count: whether those of valid days only, whether
non-wear counts as sedentary, whether wear is looked at at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import LEVELS, vector_magnitude


@dataclass(frozen=True)
class Policy:
    keys: tuple[str, ...]
    valid_days_only: bool = False
    non_wear_is_sedentary: bool = False
    ignore_wear: bool = False


SUMMARY = Policy(("subject",), valid_days_only=True)
DAILY = Policy(("subject", "date"), non_wear_is_sedentary=True)
HOURLY = Policy(("subject", "date", "hour"), non_wear_is_sedentary=True)
BATCH = Policy(("subject",), ignore_wear=True)


def _stats(name: str, value: Column, worn: Column) -> list[Column]:
    v = F.when(worn, value)
    return [F.coalesce(f(v), F.lit(0.0)).alias(f"{name}_{what}") for what, f in (("counts", F.sum), ("average", F.avg), ("max", F.max))]


def activity_stats(df: DataFrame, policy: Policy, epoch_seconds: float = 60) -> DataFrame:
    """Minutes by class, their share of all the policy's epochs, and sums, means and maxima of counts over wear."""
    df = df.withColumn("hour", F.hour("timestamp"))
    rows = df.where("is_valid_day") if policy.valid_days_only else df
    worn = F.lit(True) if policy.ignore_wear else F.col("wear_time")
    minutes = epoch_seconds / 60
    classes = []
    for level in LEVELS:
        inside = F.coalesce(F.col("intensity") == level, F.lit(False)) & worn
        if level == "sedentary" and policy.non_wear_is_sedentary:
            inside = inside | ~worn
        classes.append((F.count_if(inside) * minutes).cast("double").alias(level))
    magnitude = vector_magnitude(F.col("axis1"), F.col("axis2"), F.col("axis3"))
    values = [("axis1", F.col("axis1")), ("axis2", F.col("axis2")), ("axis3", F.col("axis3")), ("vm", magnitude), ("steps", F.col("steps"))]
    values += [("lux", F.col("lux"))] if "lux" in df.columns else []
    out = rows.groupBy(*policy.keys).agg(*classes, F.count("*").alias("n_epochs"), F.countDistinct("date").alias("calendar_days"), *[c for n, v in values for c in _stats(n, v, worn)])
    out = out.withColumn("total_mvpa", F.col("moderate") + F.col("vigorous") + F.col("very_vigorous"))
    all_minutes = F.col("n_epochs") * minutes
    for c in [*LEVELS, "total_mvpa"]:
        out = out.withColumn(f"{c}_percent", 100.0 * F.col(c) / all_minutes)
    if "date" in policy.keys:
        return out.withColumn("mvpa_per_hour", F.col("total_mvpa") / (all_minutes / 60))
    return out.withColumn("mvpa_per_day", F.col("total_mvpa") / F.greatest("calendar_days", F.lit(1)))


def hourly_report(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """Hours of valid days; those of other days are there with zeros."""
    stats = activity_stats(df, HOURLY, epoch_seconds)
    days = df.select("subject", "date", "is_valid_day").distinct()
    joined = stats.join(days, ["subject", "date"])
    zeroed = [c for c, t in stats.dtypes if c not in HOURLY.keys and c != "calendar_days"]
    return joined.select(*HOURLY.keys, *[F.when(F.col("is_valid_day"), F.col(c)).otherwise(F.lit(0).cast(t)).alias(c) for c, t in stats.dtypes if c in zeroed], "calendar_days")


def merged_intervals(filters: DataFrame) -> DataFrame:
    """Each subject's intervals (start_time to stop_time, both included) as disjoint ones."""
    order = Window.partitionBy("subject").orderBy("start_time", "stop_time")
    reach = F.max("stop_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    f = filters.select("subject", "start_time", "stop_time").where("start_time <= stop_time")
    f = f.withColumn("_new", F.when(F.col("start_time") <= reach, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy("subject", "_n").agg(F.min("start_time").alias("start_time"), F.max("stop_time").alias("stop_time")).drop("_n")


def in_filters(epochs: DataFrame, filters: DataFrame) -> DataFrame:
    """Epochs in any interval (start_time to stop_time, both included) of their subject; all epochs of a subject that has none.

    A sweep: the intervals, made disjoint, go among the epochs in order of time, and an
    epoch lies in the last one that has begun or in none. The work grows with epochs and
    intervals together, not with their product.
    """
    mark = lambda start, stop: [F.col("subject"), start.alias("_at"), F.lit(0).alias("_is"), stop.alias("_stop")]
    none = F.lit(None).cast("timestamp")
    marks = merged_intervals(filters).select(*mark(F.col("start_time"), F.col("stop_time"))).unionByName(filters.select("subject").distinct().select(*mark(none, none)))
    own = epochs.select("*", F.col("timestamp").alias("_at"), F.lit(1).alias("_is"), none.alias("_stop"))
    both = own.unionByName(marks, allowMissingColumns=True)
    swept = Window.partitionBy("subject").orderBy("_at", "_is")  # times that aren't known come first, before any interval
    begun = both.withColumn("_stop", F.last("_stop", True).over(swept)).withColumn("_has", F.min("_is").over(Window.partitionBy("subject")) == 0)
    return begun.where((F.col("_is") == 1) & (~F.col("_has") | (F.col("timestamp") <= F.col("_stop")))).select(*epochs.columns)


def batch_report(df: DataFrame, valid: DataFrame, epoch_seconds: float = 60, filters: DataFrame | None = None) -> DataFrame:
    """One row for each subject of ``valid`` over its epochs in ``filters``, with activity a day by valid days (at least one).

    Valid days are those of all epochs; a subject with no epoch in its intervals has zeros.
    """
    rows = df if filters is None else in_filters(df, filters)
    out = activity_stats(rows, BATCH, epoch_seconds).drop("calendar_days", "mvpa_per_day")
    days = valid.groupBy("subject").agg(F.count_if("is_valid").alias("valid_days"))
    joined = days.join(out, "subject", "left").fillna(0, [c for c in out.columns if c != "subject"]).select(*out.columns, "valid_days")
    return joined.withColumn("mvpa_per_day", F.col("total_mvpa") / F.greatest("valid_days", F.lit(1)))


def _title(level: str) -> str:
    return level.replace("_", " ").title()


def in_layout(stats: DataFrame, policy: Policy, epoch_seconds: float = 60, info: DataFrame | None = None) -> DataFrame:
    """``stats`` in the layout of the policy's report: shares as text with two digits, means with one, names in words.

    ``info`` has a row for each subject: subject, and any of filename, weight_lbs, age and gender; without it they are empty or 0.
    """
    own = {"filename": F.lit(""), "weight_lbs": F.lit(0.0), "age": F.lit(0.0), "gender": F.lit("")}
    if info is not None:
        stats = stats.join(info.select("subject", *[F.col(c).alias(f"_{c}") for c in own if c in info.columns]), "subject", "left")
        own |= {c: F.coalesce(F.col(f"_{c}"), own[c]) for c in own if c in info.columns}
    rounded = lambda c, scale=1.0: F.bround(F.col(c) * scale, 1)
    share = lambda c: F.format_string("%.2f%%", F.bround(F.coalesce(F.col(c), F.lit(0.0)), 2))
    per_minute, minutes = 60 / epoch_seconds, F.col("n_epochs") * (epoch_seconds / 60)
    out = [F.col("subject").alias("Subject"), own["filename"].alias("Filename"), F.lit(float(epoch_seconds)).alias("Epoch"), own["weight_lbs"].alias("Weight (lbs)"), own["age"].alias("Age"), own["gender"].alias("Gender")]
    if "date" in policy.keys:
        hour = F.col("hour") if "hour" in policy.keys else F.lit(0)
        clock = F.format_string("%02d:00 %s", F.when(hour % 12 == 0, 12).otherwise(hour % 12), F.when(hour < 12, "AM").otherwise("PM")).alias("Hour")
        out += [F.date_format("date", "MM/dd/yyyy").alias("Date"), *([clock] if "hour" in policy.keys else []), F.date_format("date", "EEEE").alias("Day of Week"), (F.weekday("date") + 1).cast("long").alias("Day of Week Num")]
    out += [F.col(c).alias(_title(c)) for c in LEVELS] + [share(f"{c}_percent").alias(f"% in {_title(c)}") for c in LEVELS]
    out += [F.col("total_mvpa").alias("Total MVPA"), share("total_mvpa_percent").alias("% in MVPA")]
    if "hour" not in policy.keys:
        per = "hour" if "date" in policy.keys else "day"
        out.append(rounded(f"mvpa_per_{per}").alias("Average MVPA Per " + ("Hour" if per == "hour" else "day")))
    axes = (1, 2, 3)
    out += [F.col(f"axis{k}_counts").alias(f"Axis {k} Counts") for k in axes] + [rounded(f"axis{k}_average").alias(f"Axis {k} Average Counts") for k in axes]
    out += [F.col(f"axis{k}_max").alias(f"Axis {k} Max Counts") for k in axes] + [rounded(f"axis{k}_average", per_minute).alias(f"Axis {k} CPM") for k in axes]
    out += [rounded("vm_counts").alias("Vector Magnitude Counts"), rounded("vm_average").alias("Vector Magnitude Average Counts"), rounded("vm_max").alias("Vector Magnitude Max Counts"), rounded("vm_average", per_minute).alias("Vector Magnitude CPM")]
    out += [F.col("steps_counts").alias("Steps Counts"), rounded("steps_average").alias("Steps Average Counts"), F.col("steps_max").alias("Steps Max Counts"), rounded("steps_average", per_minute).alias("Steps Per Minute")]
    lux = "lux_average" in stats.columns
    out += [(rounded(f"lux_{what}") if lux else F.lit(0.0)).alias(f"Lux {what.title()} Counts") for what in ("average", "max")]
    out += [F.col("n_epochs").alias("Number of Epochs"), (F.bround(minutes / 60, 1) if policy.ignore_wear else minutes.cast("double")).alias("Time")]
    out.append((F.col("valid_days") if policy.ignore_wear else F.col("calendar_days")).cast("long").alias("Calendar Days"))
    return stats.select(*out)


def group_stats(batch: DataFrame, columns: list[str]) -> DataFrame:
    """Means over subjects."""
    return batch.agg(F.count("*").alias("n_subjects"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def overall_summary(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject over wear: minutes and shares of the classes."""
    worn = df.where("wear_time")
    out = worn.groupBy("subject").agg((F.count("*") * epoch_seconds / 60).alias("wear_minutes"), *[(F.count_if(F.col("intensity") == x) * epoch_seconds / 60).alias(x) for x in LEVELS])
    out = out.withColumn("mvpa", F.col("moderate") + F.col("vigorous") + F.col("very_vigorous"))
    for c in [*LEVELS, "mvpa"]:
        out = out.withColumn(f"{c}_percent", 100.0 * F.col(c) / F.col("wear_minutes"))
    return out


def daily_summary(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject and date: wear, then what intensity adds (a left join, so days without wear stay)."""
    minutes = epoch_seconds / 60
    wear = df.groupBy("subject", "date").agg((F.count_if("wear_time") * minutes).alias("wear_minutes"), F.max("is_valid_day").alias("is_valid"))
    worn = df.where("wear_time").groupBy("subject", "date").agg(
        *[(F.count_if(F.col("intensity") == x) * minutes).alias(f"{x}_min") for x in LEVELS], F.avg("cpm").alias("mean_cpm"), F.avg("mets").alias("mean_mets"), F.sum("kcal").alias("total_kcal")
    )
    return wear.join(worn, ["subject", "date"], "left")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many have them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def plot_daily(df: DataFrame) -> DataFrame:
    """By subject and date, for plots: sums over all epochs, wear or not."""
    return df.groupBy("subject", "date").agg(
        F.sum("counts_used").alias("counts"), F.sum("steps").alias("steps"),
        F.count_if(F.col("intensity").isin("moderate", "vigorous", "very_vigorous")).alias("mvpa_minutes"), F.count_if(F.col("intensity") == "sedentary").alias("sedentary_minutes"),
    )


def overview(df: DataFrame, epoch_seconds: float = 60, least_hours: float = 10) -> DataFrame:
    """By subject: days, valid days, hours of wear and their mean a day."""
    days = df.groupBy("subject", "date").agg((F.count_if("wear_time") * epoch_seconds / 3600).alias("hours"))
    return days.groupBy("subject").agg(F.count("*").alias("n_days"), F.count_if(F.col("hours") >= least_hours).alias("valid_days"), F.sum("hours").alias("wear_hours"), F.avg("hours").alias("mean_wear_hours"))


def activity_per_day(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject over wear: minutes a day of each class; very vigorous ones count as vigorous. Days are those with any wear."""
    worn = df.where("wear_time")
    minutes = lambda *names: F.count_if(F.col("intensity").isin(*names)) * epoch_seconds / 60 / F.countDistinct("date")
    return worn.groupBy("subject").agg(F.countDistinct("date").alias("n_days"), minutes("sedentary").alias("sedentary"), minutes("light").alias("light"), minutes("moderate").alias("moderate"), minutes("vigorous", "very_vigorous").alias("vigorous"))
