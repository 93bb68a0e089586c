"""Device files as Python data sources: a file is read by as many tasks as its size asks for.

A source plans shares of files from their listing alone, small files together in a task.
A task opens its file in the shared store, by the same path as all others, and reads its
share: a range of rowids, of records of an inflated log, or of sectors. What it holds is
a share, or a batch, never a file. A range of times (of ``ticks`` or ``seconds``) may be
an option, or is taken from a query's filters where the session lets sources have them
(``spark.sql.python.filterPushdown.enabled``); axes that aren't asked for stay null.

A file that can't be read is a row of its error, told once.
"""

from __future__ import annotations

import fnmatch
import math
import os
import re
import shutil
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a share at most, and of small files that share a task; rows that are handed on at a time.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 50_000
CHUNK = 1 << 20
FOREVER = (-math.inf, math.inf)


@dataclass(frozen=True)
class Share:
    """The ``part``-th of ``parts`` shares of a file."""

    path: str
    size: int
    part: int
    parts: int

    def of(self, first: int, last: int) -> tuple[int, int]:
        """This share of the numbers from ``first`` up to ``last``, which isn't in it."""
        n = last - first
        return first + n * self.part // self.parts, first + n * (self.part + 1) // self.parts


class Shares(InputPartition):
    def __init__(self, shares: list[Share]) -> None:
        self.shares = shares


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is a shared folder's."""
    plain = re.sub(r"^file:/+", "/", path)
    if re.match(r"^[a-z][a-z0-9+.-]*://", plain):
        return pyarrow.fs.FileSystem.from_uri(plain)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(plain)


def listed(path: str, extension: str) -> list[tuple[str, int]]:
    """Files with the extension (in any case) under a folder, or those that a path or pattern names, and their sizes."""
    fs, at = _store(path)
    scheme = "" if isinstance(fs, pyarrow.fs.LocalFileSystem) else path[: path.index(at)] if at in path else ""
    pattern = None
    if re.search(r"[*?\[]", at):
        at, pattern = re.match(r"(.*?)/([^/]*[*?\[].*)", at).groups()
    found = fs.get_file_info(at)
    if found.type == pyarrow.fs.FileType.File:
        infos = [found]
    else:
        infos = fs.get_file_info(pyarrow.fs.FileSelector(at or "/", recursive=True, allow_not_found=True))
        infos = [i for i in infos if i.type == pyarrow.fs.FileType.File and (fnmatch.fnmatch(i.path[len(at) + 1 :], pattern) if pattern else i.path.lower().endswith(f".{extension}"))]
    return sorted((scheme + i.path, i.size) for i in infos)


def opened(path: str) -> pa.NativeFile:
    fs, at = _store(path)
    return fs.open_input_file(at)


class DeviceReader(DataSourceReader):
    """Plans shares and reads them; ``rows`` is a format's own."""

    fields: pa.Schema
    extension: str
    time: str

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("bytes", SPLIT_BYTES))
        self.axes = options.get("axes", "xyz")
        whole = lambda v: int(v) if re.fullmatch(r"-?\d+", v) else float(v)  # noqa: E731  a double doesn't hold all ticks
        self.start, self.stop = whole(options.get("start", "-inf")), whole(options.get("stop", "inf"))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (self.time,) and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.stop = min(self.stop, f.value)
            yield f  # a share may still hold other rows

    def partitions(self) -> list[Shares]:
        out, small, held = [], [], 0
        for path, size in listed(self.path, self.extension):
            parts = max(1, -(-size // self.bytes))
            if parts > 1:
                out += [Shares([Share(path, size, k, parts)]) for k in range(parts)]
                continue
            if small and held + size > self.bytes:
                out.append(Shares(small))
                small, held = [], 0
            small, held = [*small, Share(path, size, 0, 1)], held + size
        return out + ([Shares(small)] if small else []) or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        for share in partition.shares:
            begun = False
            try:
                for batch in self.rows(share):
                    begun = True
                    yield batch
            except Exception as e:  # one file's fault is its own row
                if begun or share.part == 0:
                    yield self.error(share, str(e))

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def batch(self, n: int, **columns) -> pa.RecordBatch:
        """``n`` rows of these columns; the others are null, and a single value stands for all rows."""
        arrays = []
        for f in self.fields:
            v = columns.get(f.name)
            if v is None:
                arrays.append(pa.nulls(n, f.type))
            elif isinstance(v, (str, int, float)):
                arrays.append(pa.array([v], f.type).take(pa.array(np.zeros(n, np.int32))))
            else:
                arrays.append(pa.array(v, f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.fields)

    def error(self, share: Share, said: str, **columns) -> pa.RecordBatch:
        return self.batch(1, path=share.path, error=said, **columns)


class DeviceSource(DataSource):
    made: type[DeviceReader]

    @classmethod
    def name(cls) -> str:
        return f"device_{cls.made.extension}"

    def schema(self) -> str:
        kinds = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double"}
        return ", ".join(f"{f.name} {kinds[f.type]}" for f in self.made.fields)

    def reader(self, schema) -> DeviceReader:
        return self.made(dict(self.options))


def load(spark: SparkSession, source: type[DeviceSource], path: str, **options):
    """The rows of all files of a source's kind under ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(source.name()).options(**given).load(path)


# Databases


class AgdReader(DeviceReader):
    """Counts or samples by ranges of rowids; the first share has the settings and the intervals as well."""

    extension, time = "agd", "ticks"
    fields = pa.schema([("path", pa.string()), ("kind", pa.string()), ("row", pa.int64()), ("ticks", pa.int64()), ("axis1", pa.float64()), ("axis2", pa.float64()), ("axis3", pa.float64()), ("steps", pa.float64()), ("name", pa.string()), ("value", pa.string()), ("error", pa.string())])

    def error(self, share: Share, said: str, **columns) -> pa.RecordBatch:
        return super().error(share, said, kind="error", row=0, **columns)

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        from .readers import sample_columns

        with database(share.path) as db:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
            source = next((t for t in ("accelerometer", "data", "epochs") if t in names), None)
            if source is None:
                raise ValueError(f"no table of epochs or samples among {', '.join(sorted(names)) or 'none'}")
            pairs = db.execute("SELECT settingName, settingValue FROM settings").fetchall() if "settings" in names else []
            if share.part == 0 and pairs:
                yield self.batch(len(pairs), path=share.path, kind="setting", row=range(1, len(pairs) + 1), name=[n for n, _ in pairs], value=[None if v is None else str(v) for _, v in pairs])
            if share.part == 0 and "filters" in names:
                spans = db.execute("SELECT filterStartTimestamp, filterStopTimestamp FROM filters").fetchall()
                yield self.batch(len(spans), path=share.path, kind="filter", row=range(1, len(spans) + 1), ticks=[a for a, _ in spans], value=[str(b) for _, b in spans])
            columns = [c[0] for c in db.execute(f"SELECT * FROM {source} LIMIT 0").description]  # noqa: S608
            if source == "accelerometer":
                kind, steps = "sample", None
                axes, when, ticks, rate = sample_columns(db, columns, dict(pairs[::-1]))  # the first of a name
            else:
                kind, rate, steps = "epoch", None, "steps" if "steps" in columns else None
                axes, when = [a if a in columns else None for a in ("axis1", "axis2", "axis3")], "dataTimestamp" if "dataTimestamp" in columns else None
                ticks = lambda row, value: value
            axes = [a if k in self.axes else None for k, a in zip("xyz", axes)]
            wanted = [f'"{c}"' if c else "NULL" for c in (when, *axes, steps)]
            first, rows = self._range(db, source, share, when)
            for at in range(rows[0], rows[1], BATCH_ROWS):
                till = min(at + BATCH_ROWS, rows[1])
                got = db.execute(f"SELECT rowid, {', '.join(wanted)} FROM {source} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (at, till)).fetchall()  # noqa: S608
                if not got:
                    continue
                _, time, x, y, z, walked = zip(*got)
                numbers = range(first, first + len(got))
                first += len(got)
                time = [ticks(n, v) for n, v in zip(numbers, time)]
                yield self.batch(len(got), path=share.path, kind=kind, row=numbers, ticks=[None if v is None else int(v) for v in time], axis1=_reals(x, rate), axis2=_reals(y, rate), axis3=_reals(z, rate), steps=_reals(walked, None), value=None if rate is None else str(rate))

    def _range(self, db: sqlite3.Connection, table: str, share: Share, when: str | None) -> tuple[int, tuple[int, int]]:
        """The number of the first row of a share, and its range of rowids, less what lies out of the times asked for."""
        least, most = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()  # noqa: S608
        if least is None:
            return 1, (0, 0)
        a, b = share.of(least, most + 1)
        numeric = when == "dataTimestamp"
        if numeric and (self.start, self.stop) != FOREVER:
            low, high = max(self.start, -9e18), min(self.stop, 9e18)
            inside = db.execute(f'SELECT min(rowid), max(rowid) FROM {table} WHERE rowid >= ? AND rowid < ? AND "{when}" BETWEEN ? AND ?', (a, b, int(low), math.ceil(high))).fetchone()  # noqa: S608
            a, b = (a, a) if inside[0] is None else (inside[0], inside[1] + 1)
        before = db.execute(f"SELECT count(*) FROM {table} WHERE rowid < ?", (a,)).fetchone()[0] if a > least else 0  # noqa: S608
        return before + 1, (a, b)


def _reals(values: tuple, rate: float | None):
    """Numbers as they are; of samples a missing one is not a number."""
    if all(v is None for v in values) and rate is None:
        return None
    return [(None if rate is None else math.nan) if v is None else float(v) for v in values]


class database:  # noqa: N801
    """A database opened where it lies, unchanged; one in a remote store as a copy in the task's scratch folder, deleted as the task ends."""

    def __init__(self, path: str) -> None:
        self.path, self.copy = path, None

    def __enter__(self) -> sqlite3.Connection:
        fs, at = _store(self.path)
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            self.copy = tempfile.NamedTemporaryFile(suffix=".db")
            with fs.open_input_stream(at) as source:
                shutil.copyfileobj(source, self.copy, CHUNK)
            self.copy.flush()
            at = self.copy.name
        self.db = sqlite3.connect("file:" + at.replace("%", "%25").replace("?", "%3f").replace("#", "%23") + "?mode=ro&immutable=1", uri=True)
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        if self.copy:
            self.copy.close()


class AgdSource(DeviceSource):
    made = AgdReader


# Raw archives


def records(stream) -> Iterator[tuple[int, int, int, bytes]]:
    """Place, type, time and payload of each record of a log, which is read a chunk at a time."""
    from .gt3x import SEPARATOR

    held, base, at = b"", 0, 0
    while True:
        while at + 8 <= len(held):
            separator, kind, time, size = struct.unpack_from("<BBIH", held, at)
            if separator != SEPARATOR:
                raise ValueError(f"no record at byte {base + at} of the log")
            if at + 8 + size > len(held):
                break
            yield base + at, kind, time, held[at + 8 : at + 8 + size]
            at += 9 + size
        more = stream.read(CHUNK)
        if not more:
            if at + 8 < len(held):  # cut off in a record: what is there of it
                _, kind, time, _ = struct.unpack_from("<BBIH", held, at)
                yield base + at, kind, time, held[at + 8 :]
            return
        drop = min(at, len(held))
        held, base, at = held[drop:] + more, base + drop, at - drop


class Gt3xReader(DeviceReader):
    """Samples by ranges of the inflated log.

    A share goes through the whole log once, as only that tells where records begin and
    which seconds are missing or come again, and keeps the payloads of its own range.
    """

    extension, time = "gt3x", "seconds"
    fields = pa.schema([("path", pa.string()), ("sample", pa.int64()), ("seconds", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("rate", pa.float64()), ("error", pa.string())])

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        with opened(share.path) as file:
            if file.size() < 22:  # less than a zip's last record
                raise ValueError("File is not a zip file")
            yield from self._archive(share, zipfile.ZipFile(file))

    def _archive(self, share: Share, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        from .gt3x import DEFAULT_RATE, SCALE, info, second_of

        with z:
            settings = info(z.read("info.txt").decode("utf-8", "replace"))
            rate = int(float(settings.get("Sample Rate", DEFAULT_RATE)))
            scale = float(settings["Acceleration Scale"]) if "Acceleration Scale" in settings else None
            low, high = share.of(0, z.getinfo("log.bin").file_size)
            high = math.inf if share.part == share.parts - 1 else high
            times, own = [], {}
            with z.open("log.bin") as log:
                for place, kind, time, payload in records(log):
                    if kind in SCALE:
                        if low <= place < high:
                            own[len(times)] = (kind, payload)
                        times.append(time)
        if not times:
            return
        seen = np.array(times, np.int64)
        order = np.lexsort((np.arange(len(seen)), seen))
        last = order[np.append(seen[order][1:] != seen[order][:-1], True)]  # of each second, in order of time, the record that came last
        known = seen[last]
        first = int(known[0])
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for k, at in enumerate(last.tolist()):
            if at not in own:
                continue
            kind, payload = own[at]
            till = int(known[k + 1]) if k + 1 < len(known) else int(known[k]) + 1
            for t in range(int(known[k]), till):  # its second, and those without a record after it
                if self.start < t + 1 and t <= self.stop:
                    held.append((t, second_of(kind, payload, rate, scale) if t == known[k] else np.zeros((rate, 3))))
                    n += rate
                if n >= BATCH_ROWS:
                    yield self._samples(share, held, first, rate)
                    held, n = [], 0
        if held:
            yield self._samples(share, held, first, rate)

    def _samples(self, share: Share, held: list[tuple[int, np.ndarray]], first: int, rate: int) -> pa.RecordBatch:
        xyz = np.concatenate([s for _, s in held])
        number = (np.repeat([t - first for t, _ in held], rate) * rate + np.tile(np.arange(rate), len(held))).astype(np.int64)
        axes = {a: xyz[:, k] for k, a in enumerate("xyz") if a in self.axes}
        return self.batch(len(xyz), path=share.path, sample=number + 1, seconds=first + number / rate, rate=float(rate), **axes)


class Gt3xSource(DeviceSource):
    made = Gt3xReader


# Sectors

#: Fixed values of the format: a header of two sectors, and where a data sector has its fields.
SECTOR, HEADER_BYTES, SAMPLES_AT = 512, 1024, 30
_SECTOR = np.dtype({
    "names": ["mark", "length", "fraction", "session", "sequence", "time", "light", "rate", "axes", "offset", "count"],
    "formats": ["S2", "<u2", "<u2", "<u4", "<u4", "<u4", "<u2", "u1", "u1", "<i2", "<u2"],
    "offsets": [0, 2, 4, 6, 10, 14, 18, 24, 25, 26, 28],
    "itemsize": SECTOR,
})
#: Sectors that are read at a time.
SECTORS = 2048


def packed_time(value: np.ndarray) -> np.ndarray:
    """Seconds since 1970 of times packed as year, month, day, hour, minute and second."""
    v = value.astype(np.int64)
    year, month, day = (v >> 26 & 0x3F) + 2000, v >> 22 & 0x0F, v >> 17 & 0x1F
    months = ((year - 1970) * 12 + month - 1).astype("datetime64[M]")
    days = months.astype("datetime64[D]").astype(np.int64) + day - 1
    return days * 86400 + (v >> 12 & 0x1F) * 3600 + (v >> 6 & 0x3F) * 60 + (v & 0x3F)


def unpack_dwords(words: np.ndarray) -> np.ndarray:
    """Three signed 10-bit values (x, y, z) of each word, times two to the power of its top two bits."""
    w = words.astype(np.int64)
    values = np.stack([w >> shift & 0x3FF for shift in (0, 10, 20)], -1)
    return np.where(values > 511, values - 1024, values) << (w >> 30)[..., None]


class Sectors:
    """Neighbouring data sectors: which are sound, their samples' numbers, rates and times."""

    def __init__(self, data: bytes) -> None:
        self.n = len(data) // SECTOR
        self.data = data[: self.n * SECTOR]
        self.head = np.frombuffer(self.data, _SECTOR)
        words = np.frombuffer(self.data, "<u2").reshape(self.n, SECTOR // 2)
        marked = (self.head["mark"] == b"AX") & (self.head["length"] == SECTOR - 4)
        self.bytes_a_value = self.head["axes"] & 0x0F
        self.n_axes = self.head["axes"] >> 4
        size = np.where(self.bytes_a_value == 2, 2 * self.n_axes.astype(np.int64), 4)
        known = ((self.bytes_a_value == 2) & np.isin(self.n_axes, (3, 6, 9))) | ((self.bytes_a_value == 0) & (self.n_axes == 3))
        fits = self.head["count"].astype(np.int64) * size <= SECTOR - 2 - SAMPLES_AT
        summed = words.sum(axis=1, dtype=np.uint64) % 65536 == 0
        self.sound = marked & known & fits & summed
        self.why = np.select([~marked, ~summed, ~known | ~fits], ["no data sector", "its checksum is wrong", "its layout is unknown"], "")
        self.count = np.where(self.sound, self.head["count"], 0).astype(np.int64)
        # An early firmware has the rate itself in place of the offset.
        coded = self.head["rate"] > 0
        self.rate = np.where(coded, 3200.0 / 2.0 ** (15 - (self.head["rate"] & 0x0F).astype(np.float64)), np.maximum(self.head["offset"], 1))
        has = (self.head["fraction"] & 0x8000) > 0
        fraction = np.where(has, (self.head["fraction"] & 0x7FFF).astype(np.int64) << 1, 0)
        # The stored offset has taken account of the fraction, for readers that don't know it.
        offset = np.where(coded, self.head["offset"].astype(np.int64) + np.where(has, fraction * self.rate.astype(np.int64) >> 16, 0), 0)
        self.begins = packed_time(self.head["time"]) + fraction / 65536 - offset / self.rate

    def steps(self) -> np.ndarray:
        """Seconds between a sector's samples: up to the beginning of the next one, if that follows it without a gap."""
        plain = 1 / self.rate
        out = plain.copy()
        if self.n > 1:
            whole = self.begins[1:] - self.begins[:-1]
            nominal = self.count[:-1] * plain[:-1]
            follows = self.sound[1:] & self.sound[:-1] & (self.head["sequence"][1:] == self.head["sequence"][:-1] + 1) & (self.head["session"][1:] == self.head["session"][:-1])
            near = follows & (self.count[:-1] > 0) & (np.abs(whole - nominal) < 0.2 * nominal)
            out[:-1] = np.where(near, whole / np.maximum(self.count[:-1], 1), plain[:-1])
        return out

    def samples(self, i: int) -> np.ndarray:
        """x, y and z of a sector in g."""
        n, at = int(self.count[i]), i * SECTOR + SAMPLES_AT
        if self.bytes_a_value[i] == 0:
            return unpack_dwords(np.frombuffer(self.data, "<u4", n, at)) / 256
        axes = int(self.n_axes[i])
        values = np.frombuffer(self.data, "<i2", n * axes, at).reshape(n, axes)
        # With a gyroscope its three axes come first; the light's top bits are the scale.
        values = values[:, 3:6] if axes > 3 else values
        return values / 2.0 ** (8 + (int(self.head["light"][i]) >> 13))


class CwaReader(DeviceReader):
    """Samples by ranges of sectors; a damaged sector is an error of its own and the others stay."""

    extension, time = "cwa", "seconds"
    fields = pa.schema([("path", pa.string()), ("sector", pa.int64()), ("sample", pa.int64()), ("seconds", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("rate", pa.float64()), ("error", pa.string())])

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        with opened(share.path) as file:
            if bytes(file.read_at(2, 0)) != b"MD":
                raise ValueError("no header sector")
            first, last = share.of(0, max(0, file.size() - HEADER_BYTES) // SECTOR)
            number = 1
            for at in range(0, first, SECTORS):  # the samples of earlier sectors
                number += int(Sectors(self._read(file, at, min(first, at + SECTORS))).count.sum())
            for at in range(first, last, SECTORS):
                till = min(last, at + SECTORS)
                # One more, which may belong to the next share, says how long the last one lasts.
                sectors = Sectors(self._read(file, at, till + 1))
                yield from self._batches(share, sectors, at, till - at, number)
                number += int(sectors.count[: till - at].sum())

    @staticmethod
    def _read(file: pa.NativeFile, first: int, last: int) -> bytes:
        return bytes(file.read_at((last - first) * SECTOR, HEADER_BYTES + first * SECTOR))

    def _batches(self, share: Share, sectors: Sectors, at: int, n: int, number: int) -> Iterator[pa.RecordBatch]:
        steps, before = sectors.steps(), np.cumsum(sectors.count) - sectors.count
        for i in np.flatnonzero(~sectors.sound[:n]).tolist():
            yield self.error(share, f"sector {at + i}: {sectors.why[i]}", sector=at + i)
        ends = sectors.begins + steps * sectors.count
        own = np.flatnonzero(sectors.sound[:n] & (sectors.count[:n] > 0) & (sectors.begins[:n] <= self.stop) & (ends[:n] > self.start))
        group = BATCH_ROWS // 120
        for k in range(0, len(own), group):
            part = own[k : k + group]
            count = sectors.count[part]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            xyz = np.concatenate([sectors.samples(i) for i in part.tolist()])
            spread = lambda v, count=count: np.repeat(v, count)
            axes = {a: xyz[:, j] for j, a in enumerate("xyz") if a in self.axes}
            yield self.batch(len(within), path=share.path, sector=spread(at + part), sample=number + spread(before[part]) + within, seconds=spread(sectors.begins[part]) + spread(steps[part]) * within, rate=spread(sectors.rate[part]), **axes)


class CwaSource(DeviceSource):
    made = CwaReader
