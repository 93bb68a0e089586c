"""Report files: unrounded results are rounded (half to even) only in a report's layout."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reports
from ..operators.sleep import sleep_details_report, sleep_summary_report


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; reports have a row for a subject, a day or an hour."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def export_reports(epochs: DataFrame, folder: str, epoch_seconds: float = 60, info: DataFrame | None = None) -> None:
    """Summary, daily and hourly reports of all subjects; ``info`` as in ``reports.in_layout``."""
    for name, policy in (("summary", reports.SUMMARY), ("daily", reports.DAILY)):
        write_csv(reports.in_layout(reports.activity_stats(epochs, policy, epoch_seconds), policy, epoch_seconds, info), f"{folder}/{name}")
    write_csv(reports.in_layout(reports.hourly_report(epochs, epoch_seconds), reports.HOURLY, epoch_seconds, info), f"{folder}/hourly")


def export_batch(epochs: DataFrame, valid: DataFrame, folder: str, epoch_seconds: float = 60, filters: DataFrame | None = None, info: DataFrame | None = None) -> None:
    """The batch's table, a row for each subject."""
    write_csv(reports.in_layout(reports.batch_report(epochs, valid, epoch_seconds, filters), reports.BATCH, epoch_seconds, info), f"{folder}/batch")


def export_sleep(periods: DataFrame, folder: str, algorithm: str = "cole_kripke", epoch_seconds: float = 60, info: DataFrame | None = None) -> None:
    write_csv(sleep_details_report(periods, algorithm, epoch_seconds, info), f"{folder}/sleep_details")
    write_csv(sleep_summary_report(periods, algorithm, epoch_seconds, info), f"{folder}/sleep_summary")
