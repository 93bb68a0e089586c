"""The functions as SQL: scalar ones whose bodies are expressions, and table functions over a series.

A scalar function's body is the SQL of the same column expression that the Python API
uses, so Spark inlines it and no Python runs. A table function gets a subject's epochs
in order (``TABLE(...) PARTITION BY subject ORDER BY (epoch)``) and holds a few numbers or a
window of them, never the series, whatever its length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import activity as A

Numbers = dict[str, str]
_METS = {"cpm": "DOUBLE", "vm": "DOUBLE", "mass": "DOUBLE", "age": "DOUBLE"}
_ENERGY = {"axis1": "DOUBLE", "vm": "DOUBLE", "mass": "DOUBLE", "epoch_seconds": "DOUBLE"}
_col = F.col


def _energy(name: str) -> Callable[[], Column]:
    def body() -> Column:
        scale = 60.0 / _col("epoch_seconds")
        return A.ENERGY[name](_col("axis1") * scale, _col("vm"), _col("vm") * scale, _col("mass"), scale)

    return body


#: Name: parameters and their types, type of the result, and the expression over columns of the parameters' names.
SCALARS: dict[str, tuple[Numbers, str, Callable[[], Column]]] = {
    "freedson_level": ({"cpm": "DOUBLE"}, "STRING", lambda: A.freedson(_col("cpm"))),
    "broad_level": ({"cpm": "DOUBLE"}, "STRING", lambda: A.broad(_col("cpm"))),
    "mets_level": ({"mets": "DOUBLE"}, "STRING", lambda: A.classify_mets(_col("mets"))),
    "counts_a_minute": ({"counts": "DOUBLE", "epoch_seconds": "DOUBLE"}, "DOUBLE", lambda: _col("counts") * 60.0 / _col("epoch_seconds")),
    "vector_magnitude": ({"x": "DOUBLE", "y": "DOUBLE", "z": "DOUBLE"}, "DOUBLE", lambda: A.vector_magnitude(*map(_col, "xyz"))),
    "enmo": ({"x": "DOUBLE", "y": "DOUBLE", "z": "DOUBLE"}, "DOUBLE", lambda: A.enmo(*map(_col, "xyz"))),
    "kcal_of_mets": ({"mets": "DOUBLE", "mass": "DOUBLE", "epoch_seconds": "DOUBLE"}, "DOUBLE", lambda: _col("mets") * 3.5 * _col("mass") / 200 * (_col("epoch_seconds") / 60)),
    **{f"mets_{n}": (_METS, "DOUBLE", lambda n=n: A.mets(n, *map(_col, _METS))) for n in A.METS},
    **{f"kcal_{n}": (_ENERGY, "DOUBLE", _energy(n)) for n in A.ENERGY},
}


def _sql(spark: SparkSession, parameters: Numbers, body: Callable[[], Column]) -> str:
    """The SQL of an expression over columns of the parameters' names and types."""
    rows = spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {t}) AS {n}' for n, t in parameters.items())}")
    return rows.select(body().alias("result"))._jdf.queryExecution().analyzed().projectList().apply(0).child().sql()


class ActivityRuns:
    """Runs of epochs whose ``flag`` holds (null doesn't); the table has subject, epoch, timestamp and flag."""

    def __init__(self) -> None:
        self.run = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["flag"]:
            if self.run is None:
                self.run = [row, row]
            self.run[1] = row
        elif self.run is not None:
            yield self._row()

    def _row(self) -> tuple:
        (a, b), self.run = self.run, None
        return a["subject"], a["epoch"], b["epoch"], a["timestamp"], b["timestamp"], b["epoch"] - a["epoch"] + 1

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self._row()


class ActiveBouts:
    """Bouts of epochs whose ``flag`` holds, with at most ``allowed`` others between two of them; at the end up to ``allowed`` others still count."""

    def __init__(self) -> None:
        self.first = self.last = self.at = self.subject = None
        self.active = 0

    def eval(self, row: Row, least: int, allowed: int) -> Iterator[tuple]:
        self.subject, self.at, self.least, self.allowed = row["subject"], row["epoch"], least, allowed
        if not row["flag"]:
            return
        if self.first is not None and self.at - self.last > allowed + 1:
            yield from self._bout(self.last)
            self.first = None
        if self.first is None:
            self.first, self.active = self.at, 0
        self.last, self.active = self.at, self.active + 1

    def _bout(self, end: int) -> Iterator[tuple]:
        if end - self.first + 1 >= self.least:
            yield self.subject, self.first, end, self.active

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield from self._bout(self.at if self.at - self.last <= self.allowed else self.last)


class ActiveShareBouts:
    """Bouts of which 80 percent of the epochs hold ``flag``: the earliest window of ``least`` epochs, made longer while the share holds, and so on after it."""

    def __init__(self) -> None:
        self.window: deque[int] = deque()
        self.total = self.active = 0
        self.first = self.at = self.subject = None

    def eval(self, row: Row, least: int) -> Iterator[tuple]:
        self.subject, self.at = row["subject"], row["epoch"]
        flag = int(bool(row["flag"]))
        if self.first is not None:
            if 5 * (self.active + flag) >= 4 * (self.at - self.first + 1):
                self.active += flag
                return
            yield self.subject, self.first, self.at - 1, self.active
            self.first, self.total = None, 0
            self.window.clear()
        self.window.append(flag)
        self.total += flag
        if len(self.window) > least:
            self.total -= self.window.popleft()
        if len(self.window) == least and 5 * self.total >= 4 * least:
            self.first, self.active = self.at - least + 1, self.total

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield self.subject, self.first, self.at, self.active


class SleepPeriods:
    """Periods from ``bedtime`` epochs of sleep to before ``waking`` epochs of wake; the table has subject, epoch and sleep_wake.

    Of the starts that share a waking the earliest whose period is long and short enough counts; those that have become too early are forgotten.
    """

    def __init__(self) -> None:
        self.starts: deque[tuple[int, int]] = deque()
        self.asleep = self.awake = self.slept = self.slept_at_wake = 0

    def eval(self, row: Row, bedtime: int, waking: int, least: int, most: int, least_sleep: int) -> Iterator[tuple]:
        at = row["epoch"]
        if row["sleep_wake"] == "S":
            self.slept, self.asleep, self.awake = self.slept + 1, self.asleep + 1, 0
            if self.asleep >= bedtime:  # a start that many epochs back, and the sleep before it
                self.starts.append((at - bedtime + 1, self.slept - bedtime))
        else:
            if self.awake == 0:
                self.slept_at_wake = self.slept
            self.awake, self.asleep = self.awake + 1, 0
            if self.awake == waking:
                end = at - waking
                good = [s for s, before in self.starts if least <= end + 1 - s < most and self.slept_at_wake - before >= least_sleep]
                if good:
                    yield row["subject"], good[0], end
                self.starts.clear()
        while self.starts and at - self.starts[0][0] > most + waking:
            self.starts.popleft()

    def terminate(self) -> Iterator[tuple]:
        return iter(())


#: Name: what it is made of and its columns.
TABLES = {
    "activity_runs": (ActivityRuns, "subject string, start_index long, end_index long, start_time timestamp, end_time timestamp, n_epochs long"),
    "active_bouts": (ActiveBouts, "subject string, start_index long, end_index long, active_epochs long"),
    "active_share_bouts": (ActiveShareBouts, "subject string, start_index long, end_index long, active_epochs long"),
    "sleep_period_bounds": (SleepPeriods, "subject string, start_index long, last_index long"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        taken = ", ".join(f"{n} {t}" for n, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({taken}) RETURNS {kind} RETURN {_sql(spark, parameters, body)}")
    for name, (made, columns) in TABLES.items():
        spark.udtf.register(name, udtf(made, returnType=columns))
    return [*SCALARS, *TABLES]
