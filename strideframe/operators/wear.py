"""Wear and non-wear detection, wear periods, valid days.

Whether a non-wear window may begin at an epoch, and where its extension ends, are
windows over the series. Only the choice of windows, each after the end of the one
before, goes through a subject's candidates one by one, those that end alike at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import renumber, run_number, runs, series


@dataclass(frozen=True)
class WearRule:
    """``neighbours``: epochs that must be zero on one side of each spike; None asks for none above ``stop`` instead."""

    window: int
    tolerance: int
    stop: int
    neighbours: int | None = None


TROIANO = WearRule(60, 2, 100)
CHOI = WearRule(90, 2, 100, 30)
LONG_WINDOW = WearRule(120, 3, 150, 45)
RULES = {"troiano": TROIANO, "choi": CHOI, "long_window": LONG_WINDOW}


def candidates(epochs: DataFrame, rule: WearRule, counts: Column) -> DataFrame:
    """For each epoch: whether a non-wear window qualifies from it, the last epoch of its extension, and where the search goes on.

    Windows of many epochs are differences of running sums, and what comes next is a
    running minimum from the end, so each pass takes time in proportion to the series.
    """
    w = series()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("subject").orderBy(F.desc("epoch"))
    onward = back.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("subject")
    number = lambda flag: F.sum(flag.cast("int")).over(upto)
    df = epochs.select("subject", "epoch", F.coalesce(counts, F.lit(0.0)).alias("c"))
    df = df.withColumn("n", F.max("epoch").over(whole)).withColumn("spike", (F.col("c") > 0) & (F.col("c") <= rule.stop))
    df = df.withColumn("new", ~F.lag("spike").over(w).eqNullSafe(F.col("spike"))).withColumn("moving", number(F.col("c") != 0))
    own = (F.col("c") != 0).cast("int")
    if rule.neighbours is None:
        df = df.withColumn("_bad", F.col("c") > rule.stop)
    else:
        k = rule.neighbours
        still_before = (F.col("moving") - own - F.coalesce(F.lag("moving", k + 1).over(w), F.lit(0)) == 0) & (F.col("epoch") > 1)
        still_after = (F.coalesce(F.lead("moving", k).over(w), F.max("moving").over(whole)) == F.col("moving")) & (F.col("epoch") < F.col("n"))
        df = df.withColumn("_bad", F.col("spike") & ~still_before & ~still_after)
    df = df.withColumn("bad", number(F.col("_bad")))
    ahead = lambda name, first: F.lead(name, rule.window - 1).over(w) - F.col(name) + first
    qualifies = (ahead("moving", own) <= rule.tolerance) & (ahead("bad", F.col("_bad").cast("int")) == 0)
    df = df.withColumn("qualifies", F.coalesce(qualifies, F.lit(False)))
    far = F.col("n") + 1
    next_run = F.min(F.when(F.col("new"), F.col("epoch"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("run_end", F.coalesce(next_run, far) - 1).withColumn("above", F.min(F.when(F.col("c") > rule.stop, F.col("epoch"))).over(onward))
    blocked = F.col("spike") & (F.col("run_end") - F.col("epoch") + 1 > rule.tolerance)
    df = df.withColumn("long", F.min(F.when(blocked & F.col("new"), F.struct("epoch", "run_end"))).over(onward))
    stop = F.least(F.coalesce("above", far), F.coalesce("long.epoch", far))
    resume = F.when(blocked, F.col("run_end") + 1).when(F.col("long.epoch") == stop, F.col("long.run_end") + 1).otherwise(stop)
    df = df.withColumn("stop_here", F.when(blocked, F.col("epoch")).otherwise(stop)).withColumn("resume_here", resume)
    beyond = lambda c: F.coalesce(F.lead(c, rule.window).over(w), far)
    return df.select("subject", "epoch", "qualifies", (beyond("stop_here") - 1).alias("end"), beyond("resume_here").alias("resume"))


def non_wear(epochs: DataFrame, rule: WearRule = CHOI, counts: str = "axis1") -> DataFrame:
    """The non-wear stretches that are found one after another: subject, start, end.

    Neighbouring starts whose windows end alike are one row, so what the choice goes
    through is about as many rows as there are stretches, not epochs.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        out, at = [], 0
        for first, last, end, resume in zip(*(rows[c].tolist() for c in ("first", "last", "end", "resume"))):
            while (start := max(first, at)) <= last:
                out.append((start, end))
                at = resume
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "start": [a for a, _ in out], "end": [b for _, b in out]})

    w = series()
    found = candidates(epochs, rule, F.col(counts)).where("qualifies")
    same = (F.col("epoch") == F.lag("epoch").over(w) + 1) & (F.col("end") == F.lag("end").over(w)) & (F.col("resume") == F.lag("resume").over(w))
    found = found.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = found.groupBy("subject", "_n").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.first("end").alias("end"), F.first("resume").alias("resume"))
    return starts.groupBy("subject").applyInPandas(choose, "subject string, start long, end long")


def wear(epochs: DataFrame, rule: WearRule = CHOI, counts: str = "axis1", name: str = "wear_time") -> DataFrame:
    """``epochs`` with whether the device was worn."""
    stretches = non_wear(epochs, rule, counts)
    edges = stretches.select("subject", F.explode(F.array(F.struct(F.col("start").alias("epoch"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("epoch"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy("subject", F.col("e.epoch").alias("epoch")).agg(F.sum("e.step").alias("_step"))
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    joined = epochs.join(steps, ["subject", "epoch"], "left")
    return joined.withColumn(name, F.sum(F.coalesce("_step", F.lit(0))).over(w) == 0).drop("_step")


def wear_periods(worn: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """Stretches of wear; the end is the last epoch's time, the duration in minutes."""
    found = runs(worn, F.col("wear_time")).withColumn("duration", F.col("n_epochs") * epoch_seconds / 60)
    return renumber(found, "period")


def non_wear_periods(worn: DataFrame, least: int = 1) -> DataFrame:
    found = runs(worn, ~F.col("wear_time")).where(F.col("n_epochs") >= least)
    return renumber(found, "period")


def valid_days(worn: DataFrame, least_hours: float = 10, epoch_seconds: float = 60) -> DataFrame:
    """By subject and date: epochs, wear epochs, minutes, hours, and whether the hours suffice."""
    days = worn.groupBy("subject", "date").agg(F.count("*").alias("total_epochs"), F.sum(F.col("wear_time").cast("int")).alias("wear_epochs"))
    minutes = F.col("wear_epochs") * epoch_seconds / 60
    return days.withColumn("wear_minutes", minutes).withColumn("wear_hours", minutes / 60).withColumn("is_valid", minutes / 60 >= least_hours)


def mark_valid_days(worn: DataFrame, least_hours: float = 10, epoch_seconds: float = 60) -> DataFrame:
    """``worn`` with whether the epoch's day is valid; a window, no join."""
    minutes = F.sum(F.col("wear_time").cast("int")).over(Window.partitionBy("subject", "date")) * epoch_seconds / 60
    return worn.withColumn("is_valid_day", minutes / 60 >= least_hours)


def wear_criteria(worn: DataFrame, least_minutes: float = 600, days: int = 4, weekdays: int = 3, weekend_days: int = 1, epoch_seconds: float = 60, least_non_wear: float = 90, least_wear: float = 0) -> DataFrame:
    """By subject: valid days, those of the week and of the weekend, all days, the share of wear, periods and their mean length in seconds, and whether all minimums are met.

    Periods of non-wear count from ``least_non_wear`` minutes, those of wear from ``least_wear``.
    """
    pieces = run_number(worn, F.col("wear_time")).groupBy("subject", "run", "date").agg(F.first("flag").alias("wear"), F.count("*").alias("n"))
    # Runs and days in the same pass: each one's sum, at one of its pieces.
    of_run, of_day = Window.partitionBy("subject", "run"), Window.partitionBy("subject", "date")
    once = lambda w, by: F.row_number().over(w.orderBy(by)) == 1
    pieces = pieces.withColumn("seconds", F.when(once(of_run, "date"), F.sum("n").over(of_run) * epoch_seconds))
    minutes = F.sum(F.when(F.col("wear"), F.col("n")).otherwise(0)).over(of_day) * epoch_seconds / 60
    pieces = pieces.withColumn("ok", F.when(once(of_day, "run"), minutes >= least_minutes)).withColumn("weekend", F.weekday("date") >= 5)
    count = lambda c: F.count_if(F.col("ok") & c)
    lengths = lambda wear, least: F.when((F.col("wear") == wear) & (F.col("seconds") >= least * 60), F.col("seconds"))
    out = pieces.groupBy("subject").agg(
        count(F.lit(True)).alias("valid_days"), count(~F.col("weekend")).alias("valid_weekdays"), count(F.col("weekend")).alias("valid_weekend_days"),
        F.count("ok").alias("total_days"), (100.0 * F.sum(F.when(F.col("wear"), F.col("n")).otherwise(0)) / F.sum("n")).alias("wear_percent"),
        F.count(lengths(True, least_wear)).alias("wear_periods"), F.coalesce(F.avg(lengths(True, least_wear)), F.lit(0.0)).alias("mean_wear_seconds"),
        F.count(lengths(False, least_non_wear)).alias("non_wear_periods"), F.coalesce(F.avg(lengths(False, least_non_wear)), F.lit(0.0)).alias("mean_non_wear_seconds"),
    )
    met = (F.col("valid_days") >= days) & (F.col("valid_weekdays") >= weekdays) & (F.col("valid_weekend_days") >= weekend_days)
    return out.withColumn("meets_criteria", met)


def hourly_wear(worn: DataFrame) -> DataFrame:
    """By subject and hour of the day: the share of epochs that are wear, in percent."""
    return worn.groupBy("subject", F.hour("timestamp").alias("hour")).agg((F.avg(F.col("wear_time").cast("double")) * 100).alias("wear_percent"))
