"""Readers of device files; each file is a row, and what can't be read is a row of its error."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.activity import ticks_to_timestamp
from ..operators.raw import counts
from . import splits

EXTENSIONS = ("agd", "gt3x", "bin", "cwa", "csv")
#: Words by which a column of times, or of an axis beside its letter, is known; of several columns that with the earlier word is taken.
TIME_WORDS = ["timestamp", "time", "datetime", "date"]
AXIS_WORDS = ["", "accelerometer", "acceleration", "accel", "acc", "axis"]
SKIPPED_LINES = 10
#: Values of raw samples stay below.
RAW_BELOW = 20
#: Names of a raw database's axes, tried in order.
RAW_AXES = [("x", "y", "z"), ("axis1", "axis2", "axis3"), ("accelerometerX", "accelerometerY", "accelerometerZ")]
RAW_RATE, RAW_START = 30.0, (1704067200 + 62135596800) * 10_000_000

def device_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All files with these extensions (in any case) under a folder, with their content."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    pattern = f"*.{{{','.join(map(either, extensions))}}}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def _ticks(value) -> int | None:
    """Ticks of a time as text or as seconds since 1970, in UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value.strip().replace("/", "-")).replace(tzinfo=timezone.utc).timestamp()
    return round((value + 62135596800) * 1e6) * 10


def sample_columns(db: sqlite3.Connection, columns: list[str], settings: dict[str, str | None]) -> tuple[list[str], str | None, Callable, float]:
    """Of the table ``accelerometer`` the axes, the column of times, if any, what makes ticks of a row's number and time, and the rate.

    Of other names than RAW_AXES the first three numeric columns that aren't times are the axes.
    """
    rate = float(settings.get("samplerate") or RAW_RATE)
    names = next((n for n in RAW_AXES if n[0] in columns), None)
    if names is None:
        others = [c for c in columns if c not in ("dataTimestamp", "timestamp")]
        kinds = db.execute("SELECT " + ", ".join(f'(SELECT typeof("{c}") FROM accelerometer WHERE "{c}" IS NOT NULL LIMIT 1)' for c in others)).fetchone() if others else ()  # noqa: S608
        names = tuple(c for c, kind in zip(others, kinds) if kind in ("integer", "real"))[:3]
    if len(names) < 3 or not set(names) <= set(columns):
        raise ValueError(f"no acceleration among {', '.join(columns)}")
    time = next((c for c in ("dataTimestamp", "timestamp") if c in columns), None)
    if time is None:
        start = int(float(settings.get("startdatetime") or RAW_START))
        return list(names), None, lambda row, _: start + round((row - 1) * 1e7 / rate), rate
    return list(names), time, (lambda _, v: _ticks(v)) if time == "timestamp" else (lambda _, v: v), rate


def read_agd(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of databases, each read by as many tasks as its size asks for: kind is epoch, sample (of a raw one, its rate as value), setting, filter or error.

    Options: ``start`` and ``stop`` in ticks, ``axes`` (letters) and ``bytes`` of a share.
    """
    return splits.load(spark, splits.AgdSource, path, **options)


def agd_subjects(rows: DataFrame) -> DataFrame:
    """Each file's subject: its setting ``subjectname`` where one file alone has it, else the file's name."""
    files = agd_names(rows)
    once = F.count("own").over(Window.partitionBy("own")) == 1
    return files.select("path", F.when(once, F.col("own")).otherwise(subject_id(F.col("path"))).alias("subject"))


def agd_names(rows: DataFrame) -> DataFrame:
    """Each file's own name for its subject (path, own), null if it has none."""
    named = F.first(F.when((F.col("name") == "subjectname") & ~F.col("value").isin("", "0"), F.col("value")), True)
    return rows.groupBy("path").agg(named.alias("own"))


def _of_kind(rows: DataFrame, kind: str, subjects: DataFrame | None) -> DataFrame:
    return rows.where(F.col("kind") == kind).join(agd_subjects(rows) if subjects is None else subjects, "path")


def agd_samples(rows: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """The samples of raw databases: subject (of ``subjects``: path, subject), sample, timestamp, x, y, z, rate."""
    axes = [F.col(f"axis{k}").alias(a) for k, a in enumerate("xyz", 1)]
    return _of_kind(rows, "sample", subjects).select("subject", F.col("row").alias("sample"), ticks_to_timestamp(F.col("ticks")).alias("timestamp"), *axes, F.col("value").cast("double").alias("rate"))


def sample_epochs(samples: DataFrame, epoch_seconds: int = 60) -> DataFrame:
    """The canonical series of raw samples (with a column rate): counts from the first sample on, y as axis1, without steps."""
    samples = samples.where("sample is not null")
    first = samples.where("sample = 1").select("subject", F.unix_micros("timestamp").alias("_first"))
    counted = counts(samples, None, epoch_seconds).join(first, "subject", "left")
    time = F.timestamp_micros(F.col("_first") + (F.col("epoch") - 1) * (epoch_seconds * 1_000_000))
    return counted.select("subject", "epoch", time.alias("timestamp"), "axis1", "axis2", "axis3", F.lit(None).cast("double").alias("steps"))


def agd_epochs(rows: DataFrame, epoch_seconds: int = 60, subjects: DataFrame | None = None) -> DataFrame:
    """The canonical series of each file; without ticks the timestamp is null. Samples of a raw one are counted, x as axis1, without steps."""
    own = _of_kind(rows, "epoch", subjects).select("subject", F.col("row").alias("epoch"), ticks_to_timestamp(F.col("ticks")).alias("timestamp"), "axis1", "axis2", "axis3", "steps")
    # Elsewhere axis1 is y; the counts of a raw database keep the order of its axes.
    counted = sample_epochs(agd_samples(rows, subjects), epoch_seconds)
    return own.unionByName(counted.select("subject", "epoch", "timestamp", F.col("axis2").alias("axis1"), F.col("axis1").alias("axis2"), "axis3", F.lit(0.0).alias("steps")))


def agd_filters(rows: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """The intervals of each file."""
    return _of_kind(rows, "filter", subjects).select("subject", ticks_to_timestamp(F.col("ticks")).alias("start_time"), ticks_to_timestamp(F.col("value").cast("long")).alias("stop_time"))


def agd_info(rows: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """What reports say of each subject: subject, filename, serial_number, weight_lbs, age and gender."""
    settings = rows.where("kind = 'setting'")
    serial = settings.where("name = 'deviceserial'").groupBy("path").agg(F.first("value").alias("serial_number"))
    known = subject_info(settings).join(serial, "path", "left").withColumnRenamed("sex", "gender")
    named = agd_subjects(rows) if subjects is None else subjects
    return named.join(known, "path", "left").select("subject", file_name(F.col("path")).alias("filename"), "serial_number", "weight_lbs", "age", "gender")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def agd_errors(rows: DataFrame) -> DataFrame:
    """The files that can't be read, and why."""
    return rows.where("kind = 'error'").select(file_name(F.col("path")).alias("filename"), "path", "error")


def agd_metadata(files: DataFrame) -> DataFrame:
    """By file (``path``), by counting in the database where it lies and without its rows: those of each kind, its tables, and the error, if any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with splits.database(path) as db:
                        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
                        n = [next((db.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ts if t in names), 0) for ts in (("data", "epochs"), ("settings",), ("filters",), ("accelerometer",))]  # noqa: S608
                    row = (path, ",".join(sorted(names)), *n, None)
                except Exception as e:  # one file's fault is its own row
                    row = (path, None, 0, 0, 0, 0, str(e))
                yield pd.DataFrame([row])

    return files.select("path").mapInPandas(run, "path string, tables string, n_epochs long, n_settings long, n_filters long, n_samples long, error string")


def subject_id(path: Column) -> Column:
    """The file's name without extension and what stands in parentheses."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(name, r"\(.*\)", ""))


def subject_info(settings: DataFrame, key: str = "path") -> DataFrame:
    """One row for each ``key`` of settings (name, value): empty text and 0 are missing; weight in pounds; sex M, F, empty or as it is."""
    wanted = ["subjectname", "sex", "age", "height", "mass"]
    value = lambda n: F.first(F.when((F.col("name") == n) & ~F.col("value").isin("", "0"), F.col("value")), True)
    s = settings.groupBy(key).agg(*[value(n).alias(n) for n in wanted])
    sex = F.lower(F.coalesce("sex", F.lit("")))
    sex = F.when(sex.isin("male", "m", "1", "true"), "M").when(sex.isin("female", "f", "2", "false"), "F").when(sex.isin("undefined", ""), "").otherwise(F.upper("sex"))
    mass = F.expr("try_cast(mass AS double)")
    return s.select(
        key, F.col("subjectname").alias("subject_id"), sex.alias("sex"), F.coalesce(F.expr("try_cast(age AS double)"), F.lit(0.0)).alias("age"),
        F.expr("try_cast(height AS double)").alias("height"), mass.alias("mass"), F.coalesce(F.bround(mass * 2.20462, 1), F.lit(0.0)).alias("weight_lbs"),
    )


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def axis_column(columns: list[str], axis: str) -> str | None:
    """The column of the axis's letter alone (or in g), or of the letter after a word for acceleration, whatever else its name says."""
    found = []
    for i, column in enumerate(columns):
        words = _words(column)
        if words in ([axis], [axis, "g"]):
            found.append((0, i))
        found += [(k, i) for k, w in enumerate(AXIS_WORDS) if w and (w + axis in words or (w, axis) in zip(words, words[1:]))]
    return columns[min(found)[1]] if found else None


def time_column(columns: list[str]) -> str | None:
    """The column whose name has a word for times in it."""
    found = [(k, i) for i, c in enumerate(columns) for k, w in enumerate(TIME_WORDS) if w in c.lower()]
    return columns[min(found)[1]] if found else None


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files (file, n, value), numbered from 1 in each.

    A task numbers its own lines of a file; what earlier tasks have of it is added, so a large file needn't pass through one.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")).withColumn("task", F.shiftright("at", 33))
    sizes = lines.groupBy("file", "task").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "task").orderBy("at"))
    return lines.join(sizes.select("file", "task", before.alias("before")), ["file", "task"]).select("file", (F.col("before") + own).alias("n"), "value")


def _csv_lines(spark: SparkSession, path: str, skip: int, columns: Callable[[list[str]], list[str | None]]) -> tuple[DataFrame, DataFrame]:
    """The numbered lines of CSV files, and each file's line of names (file, head) with the places of its time, x, y and z, or an error.

    ``columns`` finds the time (or none), x, y and z among names. The distinct lines of names, a few, are resolved on the driver.
    """
    lines = _numbered_lines(spark, path)
    heads = lines.where(F.col("n") == skip + 1).select("file", F.col("value").alias("head"))
    places = []
    for (head,) in heads.select("head").distinct().collect():
        fields = [f.strip().strip('"') for f in head.split(",")]
        found = columns(fields)
        if None in found[1:]:
            places.append((head, None, None, None, None, f"no acceleration among {', '.join(fields)}"))
        else:
            places.append((head, *[None if c is None else fields.index(c) for c in found], None))
    known = spark.createDataFrame(places, "head string, t int, x int, y int, z int, error string")
    return lines, heads.join(F.broadcast(known), "head").drop("head")


def _csv_samples(lines: DataFrame, known: DataFrame, skip: int, rate: float) -> DataFrame:
    """Samples (file, sample, timestamp, x, y, z) of the lines after the names; without a column of times these are counted at ``rate``."""
    parts, start = F.split("value", ","), F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    body = lines.where((F.col("n") > skip + 1) & (F.trim("value") != "")).join(known.where("error is null").drop("error"), "file").withColumn("sample", F.col("n") - skip - 1)
    field = lambda c: F.trim(F.regexp_replace(F.get(parts, F.col(c)), '"', ""))
    counted = F.timestamp_micros((start + (F.col("sample") - 1) * 1e6 / rate).cast("long"))
    time = F.when(F.col("t").isNull(), counted).otherwise(F.try_to_timestamp(field("t")))
    return body.select("file", "sample", time.alias("timestamp"), *[field(a).try_cast("double").alias(a) for a in "xyz"])


def _strict(lines: DataFrame, known: DataFrame, skip: int, rate: float) -> DataFrame:
    wrong = known.where("error is not null").select("error").first()
    if wrong is not None:
        raise ValueError(wrong.error)
    if known.isEmpty():
        raise ValueError("there is no line of names")
    return _csv_samples(lines, known, skip, rate).select(subject_id(F.col("file")).alias("subject"), "sample", "timestamp", "x", "y", "z")


def _csv_columns(timestamp: str | None = None, x: str | None = None, y: str | None = None, z: str | None = None) -> Callable[[list[str]], list[str | None]]:
    return lambda names: [timestamp or time_column(names), *(given or axis_column(names, a) for a, given in zip("xyz", (x, y, z)))]


def read_csv(spark: SparkSession, path: str, rate: float | None = None, timestamp: str | None = None, x: str | None = None, y: str | None = None, z: str | None = None) -> tuple[DataFrame, bool]:
    """Samples of CSV files (subject, sample, timestamp, x, y, z), and whether they are raw: no value reaches 20."""
    out = _strict(*_csv_lines(spark, path, 0, _csv_columns(timestamp, x, y, z)), 0, rate or 30)
    top = out.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()[0]
    return out, top is not None and top < RAW_BELOW


def csv_epochs(spark: SparkSession, path: str, epoch_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """The canonical series of CSV files, by path in place of a subject, and the files that have none (path, error).

    Each file is raw or has counts by its own values; a raw one's rate is that of the median step of its times.
    """
    lines, known = _csv_lines(spark, path, 0, _csv_columns())
    samples = _csv_samples(lines, known, 0, 30).withColumn("subject", plain_path(F.col("file"))).drop("file")
    step = (F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(Window.partitionBy("subject").orderBy("sample")))) / 1e6
    kinds = samples.withColumn("step", step).groupBy("subject").agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))).alias("top"), F.median("step").alias("step"))
    kinds = kinds.select("subject", (F.col("top") < RAW_BELOW).alias("is_raw"), F.greatest(F.coalesce(F.round(F.try_divide(F.lit(1.0), "step")), F.lit(30.0)), F.lit(1.0)).alias("rate"))
    both = samples.join(kinds, "subject")
    own = both.where("not is_raw").select("subject", F.col("sample").alias("epoch"), "timestamp", F.col("y").alias("axis1"), F.col("x").alias("axis2"), F.col("z").alias("axis3"), F.lit(None).cast("double").alias("steps"))
    return own.unionByName(sample_epochs(both.where("is_raw"), epoch_seconds)), known.where("error is not null").select(plain_path(F.col("file")).alias("path"), "error")


def plain_path(path: Column) -> Column:
    """A file's path as the device sources have it: without the scheme of a shared folder, and decoded."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def read_device_csv(spark: SparkSession, path: str, rate: float = 60, skip: int = SKIPPED_LINES) -> DataFrame:
    """Samples of files with ``skip`` lines before the names ``Accelerometer X``, ``Y``, ``Z`` (and ``Timestamp``)."""
    named = lambda names, wanted: next((n for n in names if n.lower() == wanted), None)
    return _strict(*_csv_lines(spark, path, skip, lambda names: [named(names, "timestamp"), *(named(names, f"accelerometer {a}") or named(names, a) for a in "xyz")]), skip, rate)


def read_cwa(spark: SparkSession, path: str, **options) -> DataFrame:
    """Samples of sector files (subject, path, sample, timestamp, x, y, z, rate, error), numbered one after another; a damaged sector is a row of its error.

    A sample's time lies between its sector's and the next one's. Options: ``start`` and ``stop`` in seconds since 1970, ``axes`` and ``bytes`` of a share.
    """
    return timed(splits.load(spark, splits.CwaSource, path, **options))


def timed(rows: DataFrame) -> DataFrame:
    """Samples with seconds as samples with a subject and a timestamp."""
    time = F.timestamp_micros(F.round(F.col("seconds") * 1e6).cast("long")).alias("timestamp")
    return rows.select(subject_id(F.col("path")).alias("subject"), "path", "sample", time, "x", "y", "z", "rate", "error")


def read_accelerometer(spark: SparkSession, path: str, **options):
    """By the extension: databases as rows of ``read_agd``, the others as samples."""
    from .gt3x import read_gt3x
    from .pages import read_bin

    known = {"agd": read_agd, "gt3x": read_gt3x, "cwa": read_cwa, "bin": read_bin, "csv": lambda *a, **o: read_csv(*a, **o)[0]}
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    if extension not in known:
        raise ValueError(f"no reader for .{extension}")
    return known[extension](spark, path, **options)


def device_support(spark: SparkSession) -> DataFrame:
    rows = [("count database", ".agd"), ("CSV", ".csv"), ("raw archive", ".gt3x"), ("pages of text", ".bin"), ("sectors", ".cwa")]
    return spark.createDataFrame([(*r, "none", True) for r in rows], "device string, extension string, needs string, available boolean")


def synthetic(spark: SparkSession, hours: float = 24, rate: int = 60, bouts: int = 10, step_rate: float = 2.0, subjects: int = 1, seed: int = 1) -> DataFrame:
    """Raw samples: noise about one g on y, and ``bouts`` stretches of a sine."""
    n = int(hours * 3600 * rate)
    ids = spark.range(n * subjects).select((F.col("id") % subjects).alias("s"), (F.floor(F.col("id") / subjects) + 1).alias("sample"))
    bout = F.floor((F.col("sample") - 1) * (2 * bouts) / n) % 2 == 1
    wave = F.when(bout, 0.5 * F.sin(F.col("sample") * (2 * 3.141592653589793 * step_rate / rate))).otherwise(0.0)
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return ids.select(
        F.concat(F.lit("s"), F.col("s")).alias("subject"), "sample", F.timestamp_micros((start + (F.col("sample") - 1) * 1e6 / rate).cast("long")).alias("timestamp"),
        (F.randn(seed) * 0.02).alias("x"), (1 + F.randn(seed + 1) * 0.02 + wave).alias("y"), (F.randn(seed + 2) * 0.02).alias("z"),
    )


def demo_epochs(spark: SparkSession, subjects: int = 3, days: int = 7, seed: int = 1) -> DataFrame:
    """Minutes of counts with a daily course."""
    ids = spark.range(subjects * days * 1440).select((F.col("id") % subjects).alias("s"), (F.floor(F.col("id") / subjects) + 1).alias("epoch"))
    hour = (F.col("epoch") - 1) % 1440 / 60
    base = F.when((hour >= 7) & (hour < 23), 600 * (1 + F.sin((hour - 7) * (3.141592653589793 / 16)))).otherwise(0.0)
    axis1 = F.floor(F.greatest(base * F.exp(F.randn(seed)) - 100, F.lit(0.0)))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return ids.select(
        F.concat(F.lit("demo"), F.col("s")).alias("subject"), "epoch", F.timestamp_micros(F.unix_micros(start) + (F.col("epoch") - 1) * 60000000).alias("timestamp"),
        axis1.alias("axis1"), F.floor(axis1 * 0.6).cast("double").alias("axis2"), F.floor(axis1 * 0.4).cast("double").alias("axis3"), F.floor(axis1 / 50).cast("double").alias("steps"),
    )
