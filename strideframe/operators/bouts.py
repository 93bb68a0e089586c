"""Bouts of activity and of sitting, and how sitting is broken up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import LEVELS, MVPA, is_mvpa
from .islands import joined, pieces, renumber, run_number, runs, series, stretch_size

BINS = [(5, "1-5 min"), (10, "5-10 min"), (20, "10-20 min"), (30, "20-30 min"), (60, "30-60 min"), (None, ">60 min")]


def intensity_summary(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject and class: minutes of wear, and their share of all wear; classes without any have a row."""
    worn = df.where("wear_time")
    counts = worn.groupBy("subject").agg(F.count("*").alias("total"), *[F.count_if(F.col("intensity") == x).alias(x) for x in LEVELS])
    pairs = F.array(*[F.struct(F.lit(x).alias("intensity"), F.col(x).alias("n")) for x in LEVELS])
    one = counts.select("subject", "total", F.explode(pairs).alias("p"))
    return one.select("subject", "p.intensity", (F.col("p.n") * epoch_seconds / 60).alias("minutes"), (100.0 * F.col("p.n") / F.col("total")).alias("percent"))


def mvpa_minutes(df: DataFrame, include_vigorous: bool = True, epoch_seconds: float = 60) -> DataFrame:
    """By subject: minutes of wear that are moderate or more, or moderate alone."""
    levels = MVPA if include_vigorous else MVPA[:1]
    n = F.count_if(F.col("wear_time") & is_mvpa(F.col("intensity"), levels))
    return df.groupBy("subject").agg((n * epoch_seconds / 60).alias("mvpa_minutes"))


def _with_shares(bouts: DataFrame) -> DataFrame:
    """Bouts (subject, start_index, end_index, mvpa_minutes) with their length, share and number."""
    length = F.col("end_index") - F.col("start_index") + 1
    out = bouts.select("subject", "start_index", "end_index", length.alias("bout_length"), "mvpa_minutes")
    return renumber(out.withColumn("mvpa_percent", 100.0 * F.col("mvpa_minutes") / F.col("bout_length")), "bout_number")


def mvpa_bouts(df: DataFrame, least: int = 10, allowed: int = 2, levels: tuple[str, ...] = MVPA) -> DataFrame:
    """Bouts whose active epochs have at most ``allowed`` others between them; wear is not looked at.

    A bout ends with its last active epoch, but at the end of the data up to ``allowed`` others still count.
    """
    if least < 1 or allowed < 0:
        raise ValueError("a bout has at least one epoch, and drops aren't negative")
    active = is_mvpa(F.col("intensity"), levels)
    marked = df.select("subject", "epoch", active.alias("active"))
    # The last epoch of each stretch goes along, so the series' end is known without its inactive epochs.
    here = Window.partitionBy("subject", F.floor((F.col("epoch") - 1) / stretch_size()))
    parts = pieces(marked.withColumn("last", F.max("epoch").over(here)), F.col("active") | (F.col("epoch") == F.col("last")), "active")
    parts = joined(parts, ["subject", "_stretch", "active"], allowed).withColumn("n", F.max("end_index").over(Window.partitionBy("subject")))
    bouts = joined(parts.where("active"), ["subject"], allowed, F.max("n").alias("n"))
    end = F.when(F.col("n") - F.col("end_index") <= allowed, F.col("n")).otherwise(F.col("end_index"))
    found = bouts.select("subject", "start_index", end.alias("end_index"), F.col("n_epochs").alias("mvpa_minutes"))
    return _with_shares(found.where(F.col("end_index") - F.col("start_index") + 1 >= least))


def share_bouts(active: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """First epoch, last epoch and active epochs of the bouts of which 80 percent is active, one after another.

    With five for an active epoch less four for each, a bout may go on until the sum falls
    below where it began; so each bout is one search in an array.
    """
    upto = np.concatenate(([0], np.cumsum(active, dtype=np.int64)))
    level = 5 * upto - 4 * np.arange(len(upto))
    starts, at, out = np.flatnonzero(level[least:] >= level[:-least]) if len(active) >= least else np.zeros(0, int), 0, []
    while (k := int(np.searchsorted(starts, at))) < len(starts):
        first, at, step = int(starts[k]), int(starts[k]) + least + 1, 64
        while at < len(level) and not (below := level[at : at + step] < level[first]).any():
            at, step = at + step, 2 * step
        at = at + int(below.argmax()) - 1 if at < len(level) else len(active)
        out.append((first + 1, at, int(upto[at] - upto[first])))
    return out


def mvpa_bouts_80(df: DataFrame, least: int = 10, levels: tuple[str, ...] = MVPA) -> DataFrame:
    """Bouts of which 80 percent is active: the earliest window of ``least`` epochs, made longer while the share holds, and so on after it.

    The choice goes through a subject's bouts one by one, over an array of its epochs.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("epoch")
        found = share_bouts(rows["active"].to_numpy(), least)
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "start_index": [a for a, _, _ in found], "end_index": [b for _, b, _ in found], "mvpa_minutes": [n for _, _, n in found]})

    marked = df.select("subject", "epoch", is_mvpa(F.col("intensity"), levels).cast("int").alias("active"))
    return _with_shares(marked.groupBy("subject").applyInPandas(choose, "subject string, start_index long, end_index long, mvpa_minutes long"))


def bout_summary(bouts: DataFrame) -> DataFrame:
    length = F.col("bout_length")
    return bouts.groupBy("subject").agg(
        F.count("*").alias("total_bouts"), F.sum(length).alias("total_bout_minutes"), F.avg(length).alias("mean_bout_length"),
        F.median(length).alias("median_bout_length"), F.min(length).alias("min_bout_length"), F.max(length).alias("max_bout_length"),
    )


def sedentary(df: DataFrame) -> Column:
    return F.coalesce((F.col("intensity") == "sedentary") & F.col("wear_time"), F.lit(False))


def sedentary_bouts(df: DataFrame, least: float = 1, epoch_seconds: float = 60) -> DataFrame:
    found = runs(df, sedentary(df)).withColumn("duration", F.col("n_epochs") * epoch_seconds / 60)
    return renumber(found.where(F.col("duration") >= least), "bout_id")


def alpha(x: Column, least: float = 1.0) -> Column:
    """An aggregate: the exponent of a power law from ``least`` on; null with under two values or no spread."""
    inside = F.when(x >= least, x)
    logs = F.sum(F.log(inside / least))
    return F.when((F.count(inside) > 1) & (logs > 0), 1 + F.count(inside) / logs)


def gini(bouts: DataFrame, value: str = "duration") -> DataFrame:
    """By subject; null with under two values or a sum of zero."""
    ranked = bouts.withColumn("i", F.row_number().over(Window.partitionBy("subject").orderBy(value, "start_index")))
    n, total = F.count("*"), F.sum(value)
    index = (2 * F.sum(F.col("i") * F.col(value)) - (n + 1) * total) / (n * total)
    return ranked.groupBy("subject").agg(F.when((n > 1) & (total != 0), index).alias("gini"))


def fragmentation(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject, how sitting is spread over bouts and broken up; subjects without sitting have a row as well.

    One pass: runs of sitting and of all else with what they add to the totals, ranked by length for the index, and grouped by subject.
    """
    minutes = epoch_seconds / 60
    day = F.row_number().over(Window.partitionBy("subject", "date").orderBy("epoch")) == 1
    found = run_number(df.withColumn("_day", day), sedentary(df)).groupBy("subject", "run").agg(
        F.first("flag").alias("sitting"), F.max("epoch").alias("end_index"), F.min("epoch").alias("start_index"),
        (F.count("*") * minutes).alias("minutes"), (F.count_if("wear_time") * minutes).alias("wear_min"), F.count_if("_day").alias("days"),
    )
    found = found.withColumn("duration", F.when(F.col("sitting") & (F.col("minutes") >= 1), F.col("minutes")))
    rank = F.row_number().over(Window.partitionBy("subject", F.col("duration").isNull()).orderBy("duration", "start_index"))
    found = found.withColumn("i", rank)
    n, total = F.count("duration"), F.sum("duration")
    index = (2 * F.sum(F.col("i") * F.col("duration")) - (n + 1) * total) / (n * total)
    out = found.groupBy("subject").agg(
        F.coalesce(F.sum(F.when(F.col("sitting"), F.col("minutes"))), F.lit(0.0)).alias("total_sedentary_min"), F.sum("wear_min").alias("total_wear_min"),
        F.sum("days").alias("n_days"), F.max_by("sitting", "end_index").alias("ends_sedentary"),
        n.alias("total_bouts"), F.avg("duration").alias("mean_bout_duration"), F.median("duration").alias("median_bout_duration"),
        F.max("duration").alias("max_bout_duration"), alpha(F.col("duration")).alias("alpha"), F.when((n > 1) & (total != 0), index).alias("gini"),
    )
    breaks = F.when((F.col("total_bouts") > 1) | ((F.col("total_bouts") == 1) & ~F.col("ends_sedentary")), F.col("total_bouts")).otherwise(0)
    out = out.withColumn("breaks_total", breaks).drop("ends_sedentary")
    hours = F.when(F.col("total_bouts") > 0, F.try_divide(F.col("breaks_total"), F.col("total_sedentary_min") / 60))
    return out.withColumn("breaks_per_sed_hour", hours).withColumn("sedentary_percent", F.try_divide(100.0 * F.col("total_sedentary_min"), F.col("total_wear_min")))


def bout_distribution(bouts: DataFrame) -> DataFrame:
    """By subject and bin of duration (closed above): bouts and their share; empty bins have a row."""
    low, cases = 0.0, []
    for high, name in BINS:
        inside = F.col("duration") > low if high is None else (F.col("duration") > low) & (F.col("duration") <= high)
        cases.append(F.count_if(inside).alias(name))
        low = high
    counts = bouts.groupBy("subject").agg(F.count("*").alias("n"), *cases)
    pairs = F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"`{name}`").alias("n_bouts")) for _, name in BINS])
    return counts.select("subject", "n", F.explode(pairs).alias("p")).select("subject", "p.category", "p.n_bouts", (100.0 * F.col("p.n_bouts") / F.col("n")).alias("percent"))


def hourly_breaks(df: DataFrame, epoch_seconds: float = 60) -> DataFrame:
    """By subject and hour: minutes of sitting and of wear, changes from sitting to not, and those an hour of sitting."""
    minutes = epoch_seconds / 60
    marked = df.withColumn("sed", sedentary(df))
    marked = marked.withColumn("break", F.coalesce(F.lag("sed").over(series()), F.lit(False)) & ~F.col("sed"))
    out = marked.groupBy("subject", F.hour("timestamp").alias("hour")).agg((F.count_if("sed") * minutes).alias("sedentary_min"), F.count_if("break").alias("breaks"), (F.count_if("wear_time") * minutes).alias("wear_min"))
    return out.withColumn("breaks_per_sed_hour", F.coalesce(F.try_divide(F.col("breaks").cast("double"), F.col("sedentary_min") / 60), F.lit(0.0)))


def accumulation_curve(bouts: DataFrame) -> DataFrame:
    """Bouts from the longest: the share of time and of bouts up to each, in percent."""
    order = Window.partitionBy("subject").orderBy(F.desc("duration"), "start_index")
    whole = Window.partitionBy("subject")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return bouts.select(
        "subject", "start_index", "duration", F.row_number().over(order).alias("rank"),
        (100.0 * F.sum("duration").over(upto) / F.sum("duration").over(whole)).alias("time_percent"),
        (100.0 * F.row_number().over(order) / F.count("*").over(whole)).alias("bout_percent"),
    )


def bout_timeline(bouts: DataFrame) -> DataFrame:
    """Where bouts lie on their day, in hours."""
    hours = lambda t: F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600
    return bouts.select("subject", "bout_id", F.to_date("start_time").alias("date"), hours("start_time").alias("start_hour"), hours("end_time").alias("end_hour"), "duration")
