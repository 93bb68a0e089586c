"""Sleep and wake by epoch, sleep periods and their measures; all of it windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import circular_minutes, clock_12h, device_datetime
from .islands import overlapped, own_of, renumber, stretch, stretch_size

#: The weights of the counts from four epochs before to two after.
COLE_KRIPKE = [106, 54, 58, 76, 230, 74, 67]


#: Epochs back and ahead that a rule of Webster's may look: a run and the runs beside it, no farther than they count.
REACH = 64


def cole_kripke(df: DataFrame, counts: str = "axis1", rescore: bool = False) -> DataFrame:
    """``df`` with sleep_wake, S or W, from weighted counts; ``rescore`` applies Webster's rules."""
    reach = REACH if rescore else 0
    w = stretch()
    c = F.least(F.coalesce(F.col(counts), F.lit(0.0)) / 100, F.lit(300.0))
    out = overlapped(df, 4 + reach, 2 + reach).withColumn("_c", c)
    terms = [weight * F.lag("_c", -offset, 0.0).over(w) for offset, weight in zip(range(-4, 3), COLE_KRIPKE)]
    index = 0.001 * sum(terms[1:], terms[0])
    out = out.withColumn("sleep_wake", F.when(index < 1, F.lit("S")).otherwise(F.lit("W")))
    return own_of(_rescored(out) if rescore else out, [c for c in df.columns if c != "sleep_wake"] + ["sleep_wake"])


def webster(df: DataFrame) -> DataFrame:
    """The first epochs of a sleep run become wake, as many as the runs around it ask for; the rules read the states before any of them."""
    return own_of(_rescored(overlapped(df, REACH, REACH)), df.columns)


def _rescored(df: DataFrame) -> DataFrame:
    """Webster's rules over stretches: where a run begins, its length, and those of the runs beside it, from the changes before and after an epoch."""
    w = stretch()
    back = Window.partitionBy("subject", "_stretch").orderBy(F.desc("epoch"))
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    beyond, onward = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    changes = ~F.lag("sleep_wake").over(w).eqNullSafe(F.col("sleep_wake"))
    # All that looks back comes before all that looks ahead: one sort for each.
    out = df.withColumn("_at", F.when(changes, F.col("epoch")))
    out = out.withColumn("_run", F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("first"), (F.col("_at") - F.coalesce(F.last("_at", True).over(before), F.col("_at"))).alias("before"))))
    out = out.withColumn("_run", F.last("_run", True).over(upto))
    # The epoch from which the next run begins, or the one after the last.
    out = out.withColumn("_next", F.coalesce(F.last("_at", True).over(beyond), F.first("epoch").over(onward) + 1))
    out = out.withColumn("_after", F.coalesce(F.last(F.col("_next") - F.col("_at"), True).over(beyond), F.lit(0)))
    length, earlier, later = F.col("_next") - F.col("_run.first"), F.col("_run.before"), F.col("_after")
    whole = ((length <= 6) & (earlier >= 15) & (later >= 15)) | ((length <= 10) & (earlier >= 20) & (later >= 20))
    changed = F.when(whole, length).when((earlier >= 15) & (length >= 4), 4).when((earlier >= 10) & (length >= 3), 3).when(earlier >= 4, 1).otherwise(0)
    waking = (F.col("sleep_wake") == "S") & (F.col("epoch") < F.col("_run.first") + changed)
    return out.withColumn("sleep_wake", F.when(waking, F.lit("W")).otherwise(F.col("sleep_wake")))


def sadeh(df: DataFrame, counts: str = "axis1") -> DataFrame:
    """``df`` with sleep_wake by Sadeh's index; frames that leave the series are filled with zeros."""
    w = stretch()
    out = overlapped(df, 5, 5).withColumn("_c", F.least(F.coalesce(F.col(counts), F.lit(0.0)), F.lit(300.0)))
    around, before = w.rowsBetween(-5, 5), w.rowsBetween(-5, 0)
    mean = F.sum("_c").over(around) / 11
    nats = F.sum(((F.col("_c") >= 50) & (F.col("_c") < 100)).cast("int")).over(around)
    total, squares = F.sum("_c").over(before), F.sum(F.col("_c") * F.col("_c")).over(before)
    sd = F.sqrt(F.greatest((squares - total * total / 6) / 5, F.lit(0.0)))
    index = 7.601 - 0.065 * mean - 1.08 * nats - 0.056 * sd - 0.703 * F.log(F.col("_c") + 1)
    return own_of(out.withColumn("sleep_wake", F.when(index > -4, F.lit("S")).otherwise(F.lit("W"))), [c for c in df.columns if c != "sleep_wake"] + ["sleep_wake"])


def sleep_periods(df: DataFrame, counts: str = "axis1", bedtime: int = 5, waking: int = 10, least: int = 160, most: int = 1440, least_sleep: int = 15, epoch_seconds: float = 60) -> DataFrame:
    """Sleep periods with their measures; the parameters are in epochs, times of sleep and wake in minutes.

    A period begins with ``bedtime`` epochs of sleep and ends before the next ``waking``
    epochs of wake. Starts before one waking share it, so the earliest start whose
    period is of an allowed length is the one that a search from the left takes.
    Periods of over 720 epochs of sleep without awakening and with over 99 percent sleep are left out.
    A period has a bounded length, so a stretch that reaches over by it finds those that begin in it.
    """
    w = stretch()
    reach = most + bedtime + waking
    s = overlapped(df, 1, reach).withColumn("s", (F.col("sleep_wake") == "S").cast("int"))
    s = s.withColumn("upto", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = lambda n: F.lead("upto", n - 1).over(w) - F.col("upto") + F.col("s")
    holds = lambda c: F.coalesce(c, F.lit(False))
    s = s.withColumn("starts", holds(ahead(bedtime) == bedtime)).withColumn("wakes", holds(ahead(waking) == 0))
    # The next waking after the epochs of bedtime is a running minimum from the end.
    later = Window.partitionBy("subject", "_stretch").orderBy(F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -bedtime)
    s = s.withColumn("wake", F.min(F.when(F.col("wakes"), F.struct("epoch", (F.col("upto") - F.col("s")).alias("slept")))).over(later))
    length = F.col("wake.epoch") - F.col("epoch")
    slept = F.col("wake.slept") - F.col("upto") + F.col("s")
    ok = s.where(F.col("_own") & F.col("starts") & (length >= least) & (length < most) & (slept >= least_sleep))
    found = ok.groupBy("subject", F.col("wake.epoch").alias("end_index")).agg(F.min("epoch").alias("start_index"))
    found = found.withColumn("last_index", F.col("end_index") - 1)
    inside = _within(df, found, F.struct("start_index", "last_index"), F.lag("sleep_wake").over(w))
    new_wake = (F.col("sleep_wake") == "W") & ~((F.col("epoch") > F.col("_p.start_index")) & F.col("_before").eqNullSafe(F.lit("W")))
    measured = inside.withColumn("new_wake", new_wake).groupBy("subject", F.col("_p.start_index").alias("start_index")).agg(
        F.max("epoch").alias("last_index"), F.min("timestamp").alias("in_bed_time"), F.max("timestamp").alias("out_bed_time"),
        F.min(F.when(F.col("sleep_wake") == "S", F.col("timestamp"))).alias("onset"),
        F.count_if(F.col("sleep_wake") == "S").alias("sleep_time"), F.count_if(F.col("sleep_wake") == "W").alias("wake_time"),
        F.count_if("new_wake").alias("number_of_awakenings"), F.count("*").alias("_total"), F.sum(F.coalesce(F.col(counts), F.lit(0.0))).alias("total_counts"),
    )
    total, minutes = F.col("_total"), epoch_seconds / 60
    measured = measured.withColumn("average_awakening", F.coalesce(F.try_divide(F.col("wake_time").cast("double"), F.col("number_of_awakenings")), F.lit(0.0)))
    measured = measured.withColumn("average_awakening", F.col("average_awakening") * minutes)
    measured = measured.withColumn("movement_index", 100.0 * F.col("wake_time") / total)
    measured = measured.withColumn("fragmentation_index", (F.col("number_of_awakenings") + F.col("movement_index")) / total)
    measured = measured.withColumn("sleep_efficiency", 100.0 * F.col("sleep_time") / total).drop("_total")
    removal = (F.col("sleep_time") > 720) & (F.col("sleep_efficiency") > 99) & (F.col("number_of_awakenings") == 0)
    scaled = measured.where(~removal).withColumns({c: F.col(c) * minutes for c in ("sleep_time", "wake_time")})
    return renumber(scaled, "period_number")


def _within(df: DataFrame, periods: DataFrame, about: Column, before: Column) -> DataFrame:
    """The epochs of periods (subject, start_index, last_index), which don't overlap, with ``about`` the period as _p and ``before``, over the stretch, as _before.

    A period is told to each stretch that it lies in; there an epoch's is the latest that began, if it hasn't ended.
    """
    size = stretch_size(1, 0)
    of = lambda c: F.floor((F.col(c) - 1) / size)
    told = periods.select("subject", about.alias("_p"), "start_index", F.explode(F.sequence(of("start_index"), of("last_index"))).alias("_stretch"))
    told = told.select("subject", "_stretch", F.greatest("start_index", F.col("_stretch") * size + 1).alias("epoch"), "_p")
    out = overlapped(df, 1, 0).withColumn("_before", before)
    out = out.join(told, ["subject", "_stretch", "epoch"], "left").withColumn("_p", F.last("_p", True).over(stretch().rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("_own") & (F.col("epoch") <= F.col("_p.last_index"))).drop("_stretch", "_own")


def sleep_summary(df: DataFrame, periods: DataFrame) -> DataFrame:
    """By subject: epochs, those of sleep and wake, periods, all sleep, mean efficiency and awakenings (0 without periods)."""
    total = df.groupBy("subject").agg(F.count("*").alias("total_epochs"), F.count_if(F.col("sleep_wake") == "S").alias("sleep_epochs"), F.count_if(F.col("sleep_wake") == "W").alias("wake_epochs"))
    found = periods.groupBy("subject").agg(F.count("*").alias("n_periods"), F.sum("sleep_time").alias("total_sleep_time"), F.avg("sleep_efficiency").alias("mean_efficiency"), F.avg("number_of_awakenings").alias("mean_awakenings"))
    return total.join(found, "subject", "left").fillna(0, ["n_periods", "total_sleep_time", "mean_efficiency", "mean_awakenings"])


ALGORITHMS = {"cole_kripke": "Cole-Kripke", "sadeh": "Sadeh"}
PERIOD_ALGORITHM = "Tudor-Locke Default"


def _about(periods: DataFrame, algorithm: str, epoch_seconds: float, info: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """``periods`` with what the report says of the subject; ``info`` has a row for each, with any of filename, serial_number, weight_lbs, age and gender."""
    own = {"filename": F.lit(""), "serial_number": F.lit(""), "weight_lbs": F.lit(0.0), "age": F.lit(0.0), "gender": F.lit("Undefined")}
    if info is not None:
        periods = periods.join(info.select("subject", *[F.col(c).alias(f"_{c}") for c in own if c in info.columns]), "subject", "left")
        own |= {c: F.coalesce(F.col(f"_{c}"), own[c]) for c in own if c in info.columns}
    names = ("File Name", "Serial Number", "Epoch Length", "Weight", "Age", "Gender", "Sleep/Wake Algorithm", "Sleep Period Detection Algorithm")
    values = (own["filename"], own["serial_number"], F.lit(float(epoch_seconds)), own["weight_lbs"], own["age"], own["gender"], F.lit(ALGORITHMS.get(algorithm, algorithm)), F.lit(PERIOD_ALGORITHM))
    return periods, [F.col("subject").alias("Subject Name"), *[v.alias(n) for v, n in zip(values, names)]]


def _latency() -> Column:
    return (F.unix_micros("onset") - F.unix_micros("in_bed_time")) / 60e6


def sleep_details_report(periods: DataFrame, algorithm: str = "cole_kripke", epoch_seconds: float = 60, info: DataFrame | None = None) -> DataFrame:
    """A row for each period, in the layout of the details report: 22 columns."""
    periods, about = _about(periods, algorithm, epoch_seconds, info)
    shown = lambda c, places: F.bround(F.col(c).cast("double"), places)
    return periods.select(
        *about, device_datetime(F.col("in_bed_time")).alias("In Bed Time"), device_datetime(F.col("out_bed_time")).alias("Out Bed Time"),
        shown("sleep_efficiency", 3).alias("Efficiency"), device_datetime(F.col("onset")).alias("Onset"), F.bround(_latency(), 0).alias("Latency"),
        shown("sleep_time", 0).alias("Total Sleep Time"), shown("wake_time", 0).alias("WASO"), F.col("number_of_awakenings").alias("Number of Awakenings"),
        shown("average_awakening", 2).alias("Length of Awakenings in Minutes"), shown("total_counts", 0).alias("Activity Counts"),
        shown("movement_index", 3).alias("Movement Index"), shown("fragmentation_index", 3).alias("Fragmentation Index"),
        F.bround(F.col("movement_index") + F.col("fragmentation_index"), 3).alias("Sleep Fragmentation Index"),
    )


def sleep_summary_report(periods: DataFrame, algorithm: str = "cole_kripke", epoch_seconds: float = 60, info: DataFrame | None = None) -> DataFrame:
    """A row for each subject with periods: means over them, clock times as means on the circle; 23 columns."""
    minutes = lambda t: F.hour(t) * 60 + F.minute(t) + F.second(t) / 60
    clock = lambda t: clock_12h(circular_minutes(minutes(t)))
    mean = lambda c, places: F.bround(F.avg(c), places)
    found = periods.groupBy("subject").agg(
        F.count("*").alias("Number of Sleep Periods"), clock("in_bed_time").alias("Average In Bed Time"), clock("out_bed_time").alias("Average Out Bed Time"),
        mean("sleep_efficiency", 3).alias("Average Efficiency"), clock("onset").alias("Average Onset"), mean(_latency(), 0).alias("Average Latency"),
        mean("sleep_time", 0).alias("Average Total Sleep Time"), mean("wake_time", 2).alias("Average WASO"), mean("number_of_awakenings", 2).alias("Average Number of Awakenings"),
        mean("average_awakening", 2).alias("Average Length of Awakenings in Minutes"), mean("total_counts", 2).alias("Average Activity Counts"),
        mean("movement_index", 3).alias("Average Movement Index"), mean("fragmentation_index", 3).alias("Average Fragmentation Index"),
        mean(F.col("movement_index") + F.col("fragmentation_index"), 3).alias("Average Sleep Fragmentation Index"),
    )
    measures = [c for c in found.columns if c != "subject"]
    found, about = _about(found, algorithm, epoch_seconds, info)
    return found.select(*about, *[F.col(f"`{c}`") for c in measures])


def _in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """The epochs of each period, with its number and the minutes since going to bed."""
    inside = _within(df, periods, F.struct("period_number", "start_index", "last_index", "in_bed_time"), F.lit(None)).drop("_before")
    return inside.withColumn("period_number", F.col("_p.period_number")).withColumn("minutes", (F.unix_micros("timestamp") - F.unix_micros("_p.in_bed_time")) / 60e6)


def actogram(df: DataFrame, periods: DataFrame) -> DataFrame:
    """The epochs of each period with the minutes since going to bed and the activity against the period's largest."""
    most = F.max("axis1").over(Window.partitionBy("subject", "period_number"))
    return _in_periods(df, periods).select("subject", "period_number", "epoch", "minutes", "sleep_wake", F.coalesce(F.try_divide(F.col("axis1"), most), F.lit(0.0)).alias("activity"))


def inner_wakes(df: DataFrame, periods: DataFrame, least: int = 2) -> DataFrame:
    """Runs of ``least`` or more epochs of wake inside each period, neither its first nor its last epochs, in minutes since going to bed."""
    own = Window.partitionBy("subject", "period_number").orderBy("epoch")
    inside = _in_periods(df, periods).withColumn("wakes", F.col("sleep_wake") == "W")
    inside = inside.withColumn("_change", F.when(F.lag("wakes").over(own).eqNullSafe(F.col("wakes")), 0).otherwise(1))
    inside = inside.withColumn("run", F.sum("_change").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs_ = inside.where("wakes").groupBy("subject", "period_number", "run").agg(
        F.min("epoch").alias("start_index"), F.max("epoch").alias("end_index"), F.min("minutes").alias("start_minutes"), F.max("minutes").alias("end_minutes"),
        F.count("*").alias("n_epochs"), F.first("_p.start_index").alias("_first"), F.first("_p.last_index").alias("_last"),
    )
    inner = runs_.where((F.col("n_epochs") >= least) & (F.col("start_index") > F.col("_first")) & (F.col("end_index") < F.col("_last")))
    return inner.select("subject", "period_number", "start_index", "end_index", "start_minutes", "end_minutes")
