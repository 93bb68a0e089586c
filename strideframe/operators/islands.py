"""Windows over a subject's epochs, and runs of equal flags.

A series may be longer than a task should take. What looks a bounded way back and ahead
is computed in stretches of a series that reach over into their neighbours that far
(``overlapped``). Runs have no bound: they are told within stretches first, and those that
touch at an edge are one (``runs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str | list[str] = "subject") -> WindowSpec:
    """A subject's epochs in order; ``epoch`` is the only order key."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("epoch")


#: Epochs of a stretch at least.
STRETCH = 1 << 17


def stretch_size(before: int = 0, after: int = 0) -> int:
    """Epochs of a stretch, some times as many as it reaches over into."""
    return max(STRETCH, 4 * (before + after))


def overlapped(df: DataFrame, before: int, after: int) -> DataFrame:
    """``df`` in stretches of a series (_stretch), each with ``before`` epochs of the one before and ``after`` of the one after it; ``_own`` tells its own ones.

    The stretches are dealt out, as windows over them would else stay where a subject's whole series is.
    """
    size = stretch_size(before, after)
    own, at = F.floor((F.col("epoch") - 1) / size), F.pmod(F.col("epoch") - 1, F.lit(size))
    there = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= size - before, own + 1)))
    return df.withColumn("_stretch", F.explode(there)).withColumn("_own", F.col("_stretch") == own).repartition("subject", "_stretch")


def stretch() -> WindowSpec:
    """A stretch's epochs in order."""
    return series(["subject", "_stretch"])


def own_of(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where("_own").select(*[F.col(f"`{c}`") for c in columns])


def run_number(df: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Numbers each run of equal values of ``flag`` (null counts as false), with the flag as ``flag``."""
    w = series()
    marked = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    change = F.when(F.lag("flag").over(w).eqNullSafe(F.col("flag")), 0).otherwise(1)
    return marked.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def pieces(df: DataFrame, flag: Column, *columns: str) -> DataFrame:
    """Each epoch in which ``flag`` holds as a piece of a run: subject, _stretch, start_index, end_index, n_epochs and ``columns``."""
    marked = df.where(F.coalesce(flag, F.lit(False)))
    return marked.select("subject", F.floor((F.col("epoch") - 1) / stretch_size()).alias("_stretch"), F.col("epoch").alias("start_index"), F.col("epoch").alias("end_index"), F.lit(1).cast("long").alias("n_epochs"), *columns)


def joined(parts: DataFrame, keys: list[str], allowed: int = 0, *extra: Column) -> DataFrame:
    """Pieces of runs, those of ``keys`` with at most ``allowed`` epochs between them as one, with ``extra`` aggregates."""
    order = Window.partitionBy(*keys).orderBy("start_index")
    apart = F.when(F.col("start_index") - F.lag("end_index").over(order) <= allowed + 1, 0).otherwise(1)
    numbered = parts.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.sum("n_epochs").alias("n_epochs"), *extra).drop("_run")


def runs(df: DataFrame, flag: Column) -> DataFrame:
    """One row for each run in which ``flag`` holds: subject, start_index, end_index, start_time, end_time and n_epochs."""
    times = [F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")]
    parts = pieces(df.withColumns({"start_time": F.col("timestamp"), "end_time": F.col("timestamp")}), flag, "start_time", "end_time")
    return joined(joined(parts, ["subject", "_stretch"], 0, *times), ["subject"], 0, *times)


def renumber(df: DataFrame, name: str, order: str = "start_index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("subject").orderBy(order)))
