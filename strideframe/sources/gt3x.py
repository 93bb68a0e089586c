"""Raw archives of a device: a zip with ``info.txt`` and a log of records.

A record of the log is a separator, a type, a time in seconds, a size, a payload
and a checksum. Two types hold samples of one second: packed 12-bit values in the
order y, x, z, and 16-bit values in the order x, y, z. Seconds without a record,
or with an empty one, are filled with zeros.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import splits
from .readers import timed

#: Fixed values of the format.
SEPARATOR, PACKED, WIDE = 0x1E, 0x00, 0x1A
SCALE = {PACKED: 341.0, WIDE: 256.0}
DEFAULT_RATE = 30

#: Names of settings, and the names in ``info.txt`` that they come from; what stands for them if there is none.
SETTINGS = {
    "subjectname": "Subject Name", "sex": "Sex", "age": "Age", "height": "Height", "mass": "Mass", "race": "Race", "startdatetime": "Start Date", "stopdatetime": "Stop Date", "epochlength": "Epoch Length",
    "deviceserial": "Serial Number", "deviceversion": "Device Type", "filter": "Filter", "actualstartdate": "Start Date", "samplerate": "Sample Rate",
}
DEFAULT_SETTINGS = {"subjectname": "Unknown", "epochlength": "60", "samplerate": "30"}


def info(text: str) -> dict[str, str]:
    """The settings of ``info.txt``, a name and a value by line."""
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in text.splitlines()) if v}


def unpack12(data: bytes) -> np.ndarray:
    """Signed 12-bit values, two in three bytes."""
    a = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).astype(np.int32).reshape(-1, 3)
    values = np.stack((a[:, 0] << 4 | a[:, 1] >> 4, (a[:, 1] & 15) << 8 | a[:, 2]), 1).ravel()
    if len(data) % 3 == 2:
        values = np.append(values, data[-2] << 4 | data[-1] >> 4)
    return np.where(values > 2047, values - 4096, values)


def second_of(kind: int, payload: bytes, rate: int, scale: float | None) -> np.ndarray:
    """The samples of a record in g (x, y, z), filled up with zeros to a second's."""
    if kind == PACKED:
        values = unpack12(payload)
        values = values[: len(values) // 3 * 3].reshape(-1, 3)[:, [1, 0, 2]]
    else:
        values = np.frombuffer(payload[: len(payload) // 6 * 6], "<i2").reshape(-1, 3)
    second = np.zeros((rate, 3))
    second[: len(values)] = values[:rate] / (scale or SCALE[kind])
    return second


def read_gt3x(spark: SparkSession, path: str, **options) -> DataFrame:
    """Samples of archives (subject, path, sample, timestamp, x, y, z, rate, error), each read by as many tasks as its size asks for; a file that can't be read is a row of its error.

    Options: ``start`` and ``stop`` in seconds since 1970, ``axes`` and ``bytes`` of a share.
    """
    return timed(splits.load(spark, splits.Gt3xSource, path, **options))


def gt3x_settings(files: DataFrame) -> DataFrame:
    """The settings of archives (``path``), of which no more is read, as rows: path, name, value; defaults where an archive has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with splits.opened(path) as file, zipfile.ZipFile(file) as z:
                        own = info(z.read("info.txt").decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError, ValueError, OSError):
                    own = {}
                found = {n: own[k] for n, k in SETTINGS.items() if own.get(k)} or DEFAULT_SETTINGS
                yield pd.DataFrame({"path": path, "name": list(found), "value": list(found.values())})

    return files.select("path").mapInPandas(run, "path string, name string, value string")
