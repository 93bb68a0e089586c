"""Raw recordings as pages of text: a head with the device's calibration, then pages of 300 samples in hex.

Spark reads such a file as text whose lines are pages, so a large one is split over tasks
wherever a page begins, and all of it is column expressions. A damaged page is a row of
its error; the others keep their numbers, which follow from the page's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import plain_path, subject_id

#: Fixed values of the format: what stands before a page, a page's samples, and a sample's hex digits.
PAGE, SAMPLES, DIGITS = "Recorded Data", 300, 12
#: Heads (a hundred bytes of each) up to which they are sent to every task.
BROADCAST_FILES = 100_000


def _after(name: str, kind: str = r"-?\d+(?:\.\d+)?") -> Column:
    """What stands after a name in a page or head, null if it isn't there."""
    return F.nullif(F.regexp_extract("value", rf"(?:^|\n){name}:({kind})", 1), F.lit(""))


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", PAGE).option("recursiveFileLookup", "true").text(path, pathGlobFilter="*.[bB][iI][nN]").select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")


def _heads(pages: DataFrame) -> DataFrame:
    """Each file's calibration: gain and offset of the axes, volts and lux of the light."""
    own = pages.where(F.col("value").contains("Calibration Data"))
    numbers = {f"{a}_{n}": _after(f"{a} {n}").cast("double") for a in "xyz" for n in ("gain", "offset")} | {"volts": _after("Volts").cast("double"), "lux": _after("Lux").cast("double")}
    return own.select("path", *[c.alias(n) for n, c in numbers.items()]).dropDuplicates(["path"])


def bin_settings(spark: SparkSession, path: str) -> DataFrame:
    """The head of each file as rows: path, name, value."""
    head = _pages(spark, path).where(F.col("value").contains("Device Identity"))
    line = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^([^:\r\n]+:[^\r\n]*)"), F.lit(1)))
    return head.select("path", line.alias("line")).select("path", F.substring_index("line", ":", 1).alias("name"), F.expr("substring(line, instr(line, ':') + 1)").alias("value"))


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    """Samples of page files (subject, path, sample, timestamp, x, y, z, rate, light, button, error) in g, as the head calibrates them."""
    pages = _pages(spark, path)
    heads = _heads(pages)
    body = pages.where(F.col("value").contains("Sequence Number:")).select(
        "path", _after("Sequence Number").cast("long").alias("page"), F.try_to_timestamp(_after("Page Time", r"[\d: -]+"), F.lit("yyyy-MM-dd HH:mm:ss:SSS")).alias("time"),
        _after("Measurement Frequency").cast("double").alias("rate"), F.regexp_extract("value", r"\n([0-9A-Fa-f]+)\s*$", 1).alias("hex"),
    )
    known = body.join(F.broadcast(heads) if heads.count() <= BROADCAST_FILES else heads, "path", "left")
    error = (
        F.when(F.col("x_gain").isNull() | F.col("y_gain").isNull() | F.col("z_gain").isNull() | (F.col("x_gain") * F.col("y_gain") * F.col("z_gain") == 0), F.lit("its head has no calibration"))
        .when(F.col("page").isNull() | F.col("time").isNull() | (F.coalesce("rate", F.lit(0.0)) <= 0), F.lit("number, time or rate is missing"))
        .when((F.length("hex") % DIGITS > 0) | (F.length("hex") > SAMPLES * DIGITS) | (F.col("hex") == ""), F.lit("its samples are broken"))
    )
    known = known.withColumn("error", F.when(error.isNotNull(), F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(": "), error)))
    digits = F.regexp_extract_all("hex", F.lit(f"[0-9A-Fa-f]{{{DIGITS}}}"), F.lit(0))
    rows = known.select("*", F.posexplode_outer(F.when(F.col("error").isNull(), digits)).alias("i", "s")).where("error is not null or s is not null")
    bits = lambda at, n: F.conv(F.substring("s", at, n), 16, 10).cast("int")
    signed = lambda c: F.when(c > 2047, c - 4096).otherwise(c)
    axis = lambda a, at: ((signed(bits(at, 3)) * 100 - F.coalesce(f"{a}_offset", F.lit(0.0))) / F.col(f"{a}_gain")).alias(a)
    time = F.timestamp_micros(F.unix_micros("time") + F.round(F.col("i") * 1e6 / F.col("rate")).cast("long"))
    last = bits(10, 3)  # ten bits of light, one of the button, one unused
    return rows.select(
        subject_id(F.col("path")).alias("subject"), "path", (F.col("page") * SAMPLES + F.col("i") + 1).alias("sample"), F.when(F.col("error").isNull(), time).alias("timestamp"),
        *[axis(a, at) for a, at in zip("xyz", (1, 4, 7))], "rate",
        (F.shiftright(last, 2) * F.try_divide("lux", "volts")).alias("light"), (F.shiftright(last, 1) % 2 == 1).alias("button"), "error",
    )
