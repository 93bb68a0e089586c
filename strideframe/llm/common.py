"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space, the only separators of words; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACES = " \t\n\x0b\x0c\r"

#: Rows that a function gets at a time, which bounds what a worker holds.
ROWS = 1000

#: What makes a worker give memory back once arrays are freed, unless the session says otherwise.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "2097152", "MALLOC_MMAP_THRESHOLD_": "262144"}

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after a word to the session's Python workers where this package lies, if on their machine, and how to keep memory."""
    environment = df.sparkSession.sparkContext.environment
    for name, value in MEMORY.items():
        environment.setdefault(name, value)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a
    session without executors of its own, as in a test, a temporary folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, which cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def append_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Columns ``fields`` computed from ``inputs``, a batch at a time, beside the kept columns.

    ``make`` runs once in each task and returns what turns a batch's input
    columns into its new columns. ``keep`` (all columns by default) names what
    goes through; a kept column with the name of a new one gives way to it.
    """
    made = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    both = df.select(
        *[F.col(f"`{c}`") for c in names],
        *[F.col(f"`{c}`").alias(f"__input_{i}") for i, c in enumerate(inputs)],
    )
    schema = StructType([*both.schema.fields[: len(names)], *fields])
    n, titles = len(names), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = [batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns[:n], *fn(*columns[n:])], names=titles)
        pa.default_memory_pool().release_unused()  # workers go on to other tasks

    return on_workers(both).mapInArrow(run, schema)


def chunks(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items that hold about ``most`` in all, or one larger item."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)
