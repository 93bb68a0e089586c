"""A whole analysis of an epoch series, and of a folder of them: each subject is a partition, so one and many are the same plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import activity as A
from ..operators import bouts, circadian, energy, reports, sleep
from ..operators import wear as wear_ops
from ..sources import gt3x, pages, readers, splits


def enrich(epochs: DataFrame, cut_points: str | Callable[[Column], Column] = "freedson", rule: wear_ops.WearRule = wear_ops.CHOI, mets: str = "freedson_adult", mass: float = A.DEFAULT_MASS, epoch_seconds: float = 60, use_magnitude: bool = False, least_hours: float = 10) -> DataFrame:
    """Epochs with counts_used, cpm, wear_time, intensity, is_valid_day, mets and kcal."""
    classify = A.CUT_POINTS[cut_points] if isinstance(cut_points, str) else cut_points
    vm = A.vector_magnitude(F.col("axis1"), F.col("axis2"), F.col("axis3"))
    out = epochs if "date" in epochs.columns else epochs.withColumn("date", F.to_date("timestamp"))
    out = out.withColumn("counts_used", vm if use_magnitude else F.col("axis1"))
    out = wear_ops.wear(out, rule, "counts_used")
    out = out.withColumn("cpm", A.to_cpm(F.col("counts_used"), epoch_seconds))
    out = out.withColumn("intensity", classify(F.col("cpm")))
    out = wear_ops.mark_valid_days(out, least_hours, epoch_seconds)
    value = energy.crouter(F.col("axis1")) if mets == "crouter" else A.mets(mets, F.col("axis1"), vm, F.lit(mass))
    return out.withColumn("mets", value).withColumn("kcal", A.energy_from_mets(F.col("mets"), A.body_mass(F.lit(mass)), epoch_seconds))


@dataclass
class Analysis:
    """Results, none of which is computed before it is asked for."""

    epochs: DataFrame
    wear_periods: DataFrame
    daily: DataFrame
    overall: DataFrame
    intensity: DataFrame
    fragmentation: DataFrame
    rhythm: circadian.Rhythm


def analyze(epochs: DataFrame, **options) -> Analysis:
    """What is made of valid days has their epochs numbered anew, so bouts may span days that are left out."""
    rich = enrich(epochs, **options)
    seconds = options.get("epoch_seconds", 60)
    valid = rich.where("is_valid_day").withColumn("epoch", F.row_number().over(Window.partitionBy("subject").orderBy("epoch")))
    return Analysis(
        rich, wear_ops.wear_periods(rich, seconds), reports.daily_summary(rich, seconds), reports.overall_summary(rich, seconds), bouts.intensity_summary(rich, seconds),
        bouts.fragmentation(valid, seconds), circadian.rhythm(valid, circadian.worn_counts(valid), seconds),
    )


@dataclass
class Folder:
    """A folder's epoch series, what is known of its subjects, their intervals, and the files that can't be read, with the reason."""

    epochs: DataFrame
    info: DataFrame
    filters: DataFrame
    errors: DataFrame


def named_files(paths: DataFrame, own: DataFrame) -> DataFrame:
    """Each file's subject (path, subject): its ``own`` name (path, own), else its own less the extension; whichever others share gives way to the file's name."""
    stem = readers.subject_id(F.col("path"))
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    tried = paths.join(own, "path", "left").withColumn("stem", stem).withColumn("first", F.coalesce("own", "stem"))
    tried = tried.withColumn("second", F.when(alone("first"), F.col("first")).otherwise(F.col("stem")))
    return tried.select("path", F.when(alone("second"), F.col("second")).otherwise(readers.file_name(F.col("path"))).alias("subject"))


def read_folder(spark: SparkSession, folder: str, epoch_seconds: int = 60, extensions: tuple[str, ...] = readers.EXTENSIONS) -> Folder:
    """All files with these extensions under a folder as one series by subject; raw ones are counted.

    A file of another kind that is no report, one that can't be read and one without a whole epoch are rows of ``errors``.
    """
    listed = [(path, e) for e in readers.EXTENSIONS for path, _ in splits.listed(folder, e)]
    paths = spark.createDataFrame(listed, "path string, extension string")
    has = {e for _, e in listed if e in extensions}
    by_path = lambda df: df.withColumn("subject", F.col("path"))
    series, errors = [], [paths.where(~F.col("extension").isin(*extensions)).select("path", F.concat(F.lit("."), F.col("extension"), F.lit(" isn't read here")).alias("error"))]
    rows = readers.read_agd(spark, folder)
    same = rows.select("path", F.col("path").alias("subject")).distinct()
    if "agd" in has:
        series.append(readers.agd_epochs(rows, epoch_seconds, same))
        errors.append(readers.agd_errors(rows).select("path", "error"))
    for extension, read in (("gt3x", gt3x.read_gt3x), ("cwa", readers.read_cwa), ("bin", pages.read_bin)):
        if extension in has:
            samples = read(spark, folder)
            series.append(readers.sample_epochs(by_path(samples.where("error is null")), epoch_seconds))
            errors.append(samples.where("error is not null").select("path", "error"))
    if "csv" in has:
        own, wrong = readers.csv_epochs(spark, f"{folder}/*.[cC][sS][vV]", epoch_seconds)
        series.append(own)
        errors.append(wrong)
    names = readers.agd_names(rows) if "agd" in has else spark.createDataFrame([], "path string, own string")
    settings = rows.where("kind = 'setting'").select("path", "name", "value")
    if "gt3x" in has:
        archives = gt3x.gt3x_settings(paths.where("extension = 'gt3x'").select("path"))
        settings = settings.unionByName(archives)
        named = archives.where("name = 'subjectname' and value not in ('', '0', 'Unknown')").groupBy("path").agg(F.first("value").alias("own"))
        names = names.unionByName(named)
    subjects = named_files(paths.where(F.col("extension").isin(*extensions)).select("path"), names)
    if not series:
        raise ValueError(f"no file of {', '.join(extensions)} in {folder}")
    epochs = series[0]
    for more in series[1:]:
        epochs = epochs.unionByName(more)
    epochs = epochs.withColumnRenamed("subject", "path").join(subjects, "path").drop("path").select("subject", *[c for c in epochs.columns if c != "subject"])
    told = errors[0]
    for more in errors[1:]:
        told = told.unionByName(more)
    empty = subjects.join(epochs.select("subject").distinct(), "subject", "left_anti").select("path").join(told.select("path").distinct(), "path", "left_anti").select("path", F.lit("it has no whole epoch").alias("error"))
    told = told.unionByName(empty).select(readers.file_name(F.col("path")).alias("filename"), "path", "error")
    info_rows = settings.withColumn("kind", F.lit("setting"))
    return Folder(epochs, readers.agd_info(info_rows, subjects), readers.agd_filters(rows, subjects), told)


@dataclass
class Batch:
    """A folder's analysis, its table with a row for each subject, what is known of these, and the files that can't be read."""

    analysis: Analysis
    table: DataFrame
    info: DataFrame
    errors: DataFrame


def analyze_folder(spark: SparkSession, folder: str, **options) -> Batch:
    """All device files of a folder; an unreadable one is a row of ``errors`` and takes nothing from the others."""
    seconds = options.get("epoch_seconds", 60)
    found = read_folder(spark, folder, seconds)
    analysis = analyze(found.epochs, **options)
    valid = wear_ops.valid_days(analysis.epochs, options.get("least_hours", 10), seconds)
    table = reports.batch_report(analysis.epochs, valid, seconds, found.filters)
    return Batch(analysis, table, found.info, found.errors)


def analyze_sleep(epochs: DataFrame, algorithm: str = "cole_kripke", rescore: bool = True, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Epochs with sleep or wake, periods, and a summary by subject; ``rescore`` applies Webster's rules to weighted counts."""
    marked = sleep.cole_kripke(epochs, rescore=rescore) if algorithm == "cole_kripke" else sleep.sadeh(epochs)
    periods = sleep.sleep_periods(marked, **options)
    return marked, periods, sleep.sleep_summary(marked, periods)


@dataclass
class SleepBatch:
    """Sleep of a folder: epochs with sleep or wake, periods, a summary with a row for each subject, what is known of these, and the files that can't be read."""

    epochs: DataFrame
    periods: DataFrame
    summary: DataFrame
    info: DataFrame
    errors: DataFrame


def analyze_sleep_folder(spark: SparkSession, folder: str, algorithm: str = "cole_kripke", rescore: bool = True, **options) -> SleepBatch:
    """Sleep by minutes of all count databases and raw archives of a folder; an unreadable file is a row of ``errors``, and its summary has no epochs."""
    found = read_folder(spark, folder, 60, ("agd", "gt3x"))
    marked, periods, summary = analyze_sleep(found.epochs, algorithm, rescore, **options)
    known = found.info.select("subject", "filename").join(summary, "subject", "left").withColumn("algorithm", F.lit(algorithm)).fillna(0, ["n_periods", "total_sleep_time", "mean_efficiency", "mean_awakenings"])
    return SleepBatch(marked, periods, known, found.info, found.errors)
