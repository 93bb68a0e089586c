"""Queries by name over the driver's tables, each with the SQL of the same result where SQL has it.

The SQL of a query lies in ``sql/<name>.sql``; its first line names the tables, files
of their own, that it begins with. It holds all its constants as literals. Computed
numbers are compared to six places, rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import activity as A
from ..operators import bouts, circadian, energy, raw, reports, sleep, stats
from ..operators import wear as wear_ops
from ..sources.adapters import AGE, MASS, epochs_from_events, raw_from_events
from .analysis import analyze_sleep, enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLACES = 6
SQL = Path(__file__).parent / "sql"


def sql(name: str) -> str | None:
    """The SQL of a query with the tables that it begins with; None without a file."""
    file = SQL / f"{name}.sql"
    if not file.exists():
        return None
    head, _, body = file.read_text().partition("\n")
    parts = [(SQL / f"_{p.strip()}.sql").read_text().strip() for p in head.removeprefix("-- with ").split(",")]
    if body.startswith("SELECT"):
        return f"WITH RECURSIVE {',\n'.join(parts)}\n{body}"
    return f"WITH RECURSIVE {',\n'.join([*parts, body])}"


def _plain(df: DataFrame) -> DataFrame:
    """Doubles to six places, dates and times as text."""
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        if kind == "double":
            col = F.round(col, PLACES)
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind == "timestamp":
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        out.append(col.alias(c))
    return df.select(*out)


SOURCES = {"epochs": epochs_from_events, "raw": raw_from_events, "rich": lambda s, d: enrich(epochs_from_events(s, d))}


def query(name: str, over: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a function of the epochs, the samples, or the epochs with everything (rich)."""
    QUERIES[name] = lambda spark, sf_dir: _plain(fn(SOURCES[over](spark, sf_dir)))
    if (text := sql(name)) is not None:
        ORACLES[name] = text


_id = ["subject", "epoch"]
_vm = lambda: A.vector_magnitude(F.col("axis1"), F.col("axis2"), F.col("axis3"))
_axis1 = lambda: F.col("axis1")

# Scalar functions.
query("to_cpm", "epochs", lambda d: d.select(*_id, A.to_cpm(_axis1(), 15).alias("cpm")))
query("vector_magnitude", "epochs", lambda d: d.select(*_id, _vm().alias("vm")))
query("enmo", "raw", lambda d: d.select("subject", "sample", A.enmo(F.col("x"), F.col("y"), F.col("z")).alias("enmo")))
query("freedson_levels", "epochs", lambda d: d.select(*_id, A.freedson(_axis1()).alias("level")))
query("freedson_levels_vm", "epochs", lambda d: d.select(*_id, A.freedson(_vm()).alias("level")))
query("broad_levels", "epochs", lambda d: d.select(*_id, A.broad(_axis1()).alias("level")))
query("classify_mets", "epochs", lambda d: d.select(*_id, A.classify_mets(1.602 + 0.000638 * _axis1()).alias("level")))
for _name in A.METS:
    query(f"mets_{_name}", "epochs", lambda d, n=_name: d.select(*_id, A.mets(n, _axis1(), _vm(), F.lit(MASS), F.lit(AGE)).alias("mets")))
query("mets_crouter", "epochs", lambda d: d.select(*_id, energy.crouter(_axis1()).alias("mets")))
for _name in A.ENERGY:
    query(f"ee_{_name}", "epochs", lambda d, n=_name: d.select(*_id, A.energy(n, _axis1(), _vm(), F.lit(MASS), 15).alias("kcal_per_min")))
query("ee_from_mets", "epochs", lambda d: d.groupBy("subject").agg(F.sum(A.energy_from_mets(1.602 + 0.000638 * _axis1(), F.lit(MASS))).alias("kcal")))
query("ee_by_intensity", "rich", lambda d: energy.energy_by_intensity(d).drop("level"))
query("average_mets", "rich", energy.average_mets)
query("average_mets_daily", "rich", lambda d: energy.average_mets(d, True))
query(
    "formats", "epochs",
    lambda d: d.select(
        *_id, A.format_duration((F.col("epoch") - 1) * 60).alias("duration"), A.format_height(_axis1() % 250).alias("height"), A.format_weight(_axis1() % 200).alias("weight"),
        A.format_sex((_axis1() % 4).cast("int").cast("string")).alias("sex"), A.format_gender(F.when(_axis1() % 2 == 0, "female")).alias("gender"), A.device_datetime(F.col("timestamp")).alias("at"),
    ),
)

# Intensity and wear.
query("intensity_summary", "rich", bouts.intensity_summary)
query("mvpa_minutes", "rich", bouts.mvpa_minutes)
query("moderate_minutes", "rich", lambda d: bouts.mvpa_minutes(d, include_vigorous=False))
for _name, _rule in wear_ops.RULES.items():
    query(f"wear_{_name}", "epochs", lambda d, rule=_rule: wear_ops.wear(d, rule).select(*_id, "wear_time"))
query("wear_periods", "rich", wear_ops.wear_periods)
query("nonwear_periods", "rich", lambda d: wear_ops.non_wear_periods(d, 60))
query("valid_days", "rich", wear_ops.valid_days)
query("wear_criteria", "rich", wear_ops.wear_criteria)
query("hourly_wear", "rich", wear_ops.hourly_wear)

# Bouts.
_sitting = bouts.sedentary_bouts
query("mvpa_bouts_drop", "rich", bouts.mvpa_bouts)
query("mvpa_bout_summary", "rich", lambda d: bouts.bout_summary(bouts.mvpa_bouts(d)))
query("mvpa_bouts_80pct", "rich", bouts.mvpa_bouts_80)
query("sedentary_bouts", "rich", _sitting)
query("gini", "rich", lambda d: bouts.gini(_sitting(d)))
query("alpha", "rich", lambda d: _sitting(d).groupBy("subject").agg(bouts.alpha(F.col("duration")).alias("alpha")))
query("fragmentation", "rich", bouts.fragmentation)
query("bout_distribution", "rich", lambda d: bouts.bout_distribution(_sitting(d)))
query("sedentary_breaks_hourly", "rich", bouts.hourly_breaks)
query("accumulation_curve", "rich", lambda d: bouts.accumulation_curve(_sitting(d)))
query("bout_timeline", "rich", lambda d: bouts.bout_timeline(_sitting(d)))


# Sleep.
def _periods(d: DataFrame) -> DataFrame:
    return sleep.sleep_periods(sleep.cole_kripke(d), least=60)


_of_day = lambda c: F.hour(c) * 60 + F.minute(c)
query("cole_kripke", "epochs", lambda d: sleep.cole_kripke(d).select(*_id, "sleep_wake"))
query("cole_kripke_webster", "epochs", lambda d: sleep.cole_kripke(d, rescore=True).select(*_id, "sleep_wake"))
query("sadeh", "epochs", lambda d: sleep.sadeh(d).select(*_id, "sleep_wake"))
query("sleep_periods", "epochs", _periods)
query("sleep_periods_rescored", "epochs", lambda d: analyze_sleep(d, least=60)[1])
query("sleep_summary_rescored", "epochs", lambda d: analyze_sleep(d, least=60)[2])
query("sleep_details", "epochs", lambda d: sleep.sleep_details_report(_periods(d)))
query("sleep_summary", "epochs", lambda d: sleep.sleep_summary(sleep.cole_kripke(d), _periods(d)))
query("circular_mean_time", "epochs", lambda d: _periods(d).groupBy("subject").agg(A.circular_minutes(_of_day("in_bed_time")).alias("in_bed_minutes"), A.circular_minutes(_of_day("out_bed_time")).alias("out_bed_minutes")))
query("sleep_summary_report", "epochs", lambda d: sleep.sleep_summary_report(_periods(d)))
query("actogram", "epochs", lambda d: sleep.actogram(sleep.cole_kripke(d), _periods(d)))
query("actogram_wakes", "epochs", lambda d: sleep.inner_wakes(sleep.cole_kripke(d), _periods(d)))

# Circadian.
_worn = circadian.worn_counts
query("hourly_profile", "rich", lambda d: circadian.hourly_profile(d, _worn(d)))
query("l5_m10", "rich", lambda d: circadian.rest_activity(d, _worn(d)))
query("daily_circadian", "rich", lambda d: circadian.daily_rest_activity(d, _worn(d)))
query("is_iv", "rich", lambda d: circadian.stability_and_variability(d, _worn(d)))
query("cosinor", "rich", lambda d: circadian.cosinor(d, _worn(d)))
query("circadian_bundle", "rich", lambda d: circadian.rhythm(d, _worn(d)).summary)
query("group_profile", "rich", lambda d: circadian.group_profile(d, _worn(d)))
query("group_rest_activity", "rich", lambda d: circadian.group_rest_activity(d, _worn(d)))


# Reports.
def _batch(d: DataFrame) -> DataFrame:
    return reports.batch_report(d, wear_ops.valid_days(d))


query("report_summary", "rich", lambda d: reports.activity_stats(d, reports.SUMMARY))
query("report_daily", "rich", lambda d: reports.activity_stats(d, reports.DAILY))
query("report_hourly", "rich", reports.hourly_report)
query("batch_row", "rich", _batch)
query("export_summary", "rich", lambda d: reports.in_layout(reports.activity_stats(d, reports.SUMMARY), reports.SUMMARY))
query("export_daily", "rich", lambda d: reports.in_layout(reports.activity_stats(d, reports.DAILY), reports.DAILY))
query("export_hourly", "rich", lambda d: reports.in_layout(reports.hourly_report(d), reports.HOURLY))
query("export_batch", "rich", lambda d: reports.in_layout(_batch(d), reports.BATCH))
query("group_stats", "rich", lambda d: reports.group_stats(_batch(d), ["total_mvpa", "sedentary", "mvpa_per_day"]))
query("overall_summary", "rich", reports.overall_summary)
query("daily_left_join", "rich", reports.daily_summary)
query("plot_daily", "rich", reports.plot_daily)
query("overview", "rich", reports.overview)
query("activity_per_day", "rich", reports.activity_per_day)

# Relational primitives.
query("time_range_filter", "epochs", lambda d: d.where(F.col("timestamp").between("2024-01-01 08:00:00", "2024-01-01 12:00:00")).select(*_id, "axis1"))
query("date_range_filter", "epochs", lambda d: d.where(F.col("date").between("2024-01-02", "2024-01-03")).select(*_id, "date", "axis1"))
query("valid_day_semijoin", "rich", lambda d: d.where("is_valid_day").select(*_id, "axis1"))


def _filters(d: DataFrame) -> DataFrame:
    """An hour from every 300th epoch of the first two subjects; the others have no interval."""
    own = d.where(((F.col("epoch") - 1) % 300 == 0) & F.col("subject").isin("s0", "s1"))
    return own.select("subject", F.col("timestamp").alias("start_time"), (F.col("timestamp") + F.expr("INTERVAL 59 MINUTES")).alias("stop_time"))


query("interval_filter_semijoin", "epochs", lambda d: reports.in_filters(d, _filters(d)).select(*_id, "axis1"))
query("first_periods", "rich", lambda d: wear_ops.wear_periods(d).select("subject", "start_index", "n_epochs").orderBy(F.desc("n_epochs"), "subject", "start_index").limit(5))
query("periods_of_both_kinds", "rich", lambda d: wear_ops.wear_periods(d).select("subject", F.lit("wear").alias("kind"), "start_index", "end_index").unionByName(wear_ops.non_wear_periods(d).select("subject", F.lit("non-wear").alias("kind"), "start_index", "end_index")))
query("duplicate_times", "epochs", lambda d: reports.duplicates(d.withColumn("time_of_day", F.date_format("timestamp", "HH:mm")), ["subject", "time_of_day"]))

# Quality and agreement.
query("quality", "raw", lambda d: stats.quality(d, 1.5, ("subject",)))
query("sample_rate", "raw", lambda d: stats.sample_rate(d, "sample"))
query("validation_metrics", "epochs", lambda d: stats.validation(d.withColumn("vm", _vm()), "axis1", "vm", ("subject",)))
query("icc", "epochs", lambda d: d.groupBy("subject").agg(stats.icc(_axis1(), F.col("axis2")).alias("icc")))
query("confusion", "epochs", lambda d: stats.confusion(d.withColumn("vm", _vm()), F.col("vm") > 2000, _axis1() > 1951, ("subject",)))

# Raw signal.
query("mad_blocks", "raw", lambda d: raw.mad_blocks(d, 50))
query("nonmovement_windows", "raw", lambda d: raw.still_windows(d, 10))
query("calibrate", "raw", lambda d: raw.calibration(d, 10, least=10))
query("counts_raw", "raw", lambda d: raw.counts(d, 30, 5))
query("steps_peak", "raw", lambda d: raw.steps(d, 30))
query("steps_autocorr", "raw", lambda d: raw.steps(d, 30, True))
query("process_epochs", "raw", lambda d: raw.process(d, 30, 5))
query("process_intensity", "raw", lambda d: raw.processed(d, 30, 5).intensity)
query("process_totals", "raw", lambda d: raw.processed(d, 30, 5).totals)
