"""Files of each device written as their formats say, and read by one task or by many."""

import random
import sqlite3
import struct
import zipfile
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from strideframe.operators.raw import count_signal
from strideframe.plans.analysis import analyze_folder, analyze_sleep, analyze_sleep_folder
from strideframe.sources import pages, readers, splits
from strideframe.sources.gt3x import read_gt3x

BEGIN = datetime(2024, 2, 28, 23, 59, 30, tzinfo=timezone.utc)
TICKS = (int(BEGIN.timestamp()) + 62135596800) * 10_000_000


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def wave(n, rate):
    """x, y and z in g of someone who walks."""
    t = np.arange(n) / rate
    return np.stack([0.1 * np.cos(t), 1 + 0.5 * np.sin(2 * np.pi * 1.8 * t), 0.2 * np.sin(t)], 1)


# Databases


def database(path, rows=5000, raw=False, holes=False):
    db = sqlite3.connect(path)
    table, axes = ("accelerometer", "x REAL, y REAL, z REAL") if raw else ("data", "axis1 REAL, axis2 REAL, axis3 REAL, steps REAL")
    db.execute(f"CREATE TABLE {table} (dataTimestamp INTEGER, {axes})")
    marks = ", ".join("?" * (1 + len(axes.split(","))))
    db.executemany(f"INSERT INTO {table} VALUES ({marks})", [(TICKS + i * 600_000_000, *(None if (i + k) % 17 == 0 else float(i + k) for k in range(len(axes.split(","))))) for i in range(rows)])
    if holes:
        db.execute(f"DELETE FROM {table} WHERE rowid % 7 < 3 OR rowid < 100")
    db.execute("CREATE TABLE settings (settingName TEXT, settingValue TEXT)")
    db.execute("INSERT INTO settings VALUES ('samplerate', '60')")
    db.execute("CREATE TABLE filters (filterStartTimestamp INTEGER, filterStopTimestamp INTEGER)")
    db.execute("INSERT INTO filters VALUES (?, ?)", (TICKS, TICKS + 1))
    db.commit()
    db.close()


@pytest.mark.parametrize(("raw", "holes"), [(False, False), (False, True), (True, True)])
def test_a_database_is_read_by_many_tasks(spark, tmp_path, raw, holes):
    database(tmp_path / "one.agd", raw=raw, holes=holes)
    whole, many = readers.read_agd(spark, str(tmp_path)), readers.read_agd(spark, str(tmp_path), bytes=30_000)
    assert whole.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 4
    order = ("kind", "row")
    plain = lambda rows: [tuple("nan" if x != x else x for x in r) for r in rows]
    found = plain(collected(many, *order))
    assert found == plain(collected(whole, *order))
    db = sqlite3.connect(tmp_path / "one.agd")
    n = db.execute(f"SELECT count(*) FROM {'accelerometer' if raw else 'data'}").fetchone()[0]
    kind = "sample" if raw else "epoch"
    assert [r[2] for r in found if r[1] == kind] == list(range(1, n + 1)) and sum(r[1] == "setting" for r in found) == sum(r[1] == "filter" for r in found) == 1
    assert {r[9] for r in found if r[1] == kind} == {"60.0" if raw else None}


def test_times_and_axes_are_left_out_at_the_source(spark, tmp_path):
    database(tmp_path / "one.agd", holes=True)
    rows = readers.read_agd(spark, str(tmp_path), bytes=30_000)
    low, high = TICKS + 500 * 600_000_000, TICKS + 700 * 600_000_000
    span = (F.col("ticks") >= low) & (F.col("ticks") < high)
    want = collected(rows.where("kind = 'epoch'").where(span.eqNullSafe(F.lit(True)) | F.lit(False)), "row")
    pushed = readers.read_agd(spark, str(tmp_path), bytes=30_000).where(span)
    assert collected(pushed.where("kind = 'epoch'"), "row") == want and len(want) > 100
    reader = splits.AgdReader({"path": str(tmp_path), "bytes": "30000", "start": str(low), "stop": str(high), "axes": "y"})
    read = [b for part in reader.partitions() for b in reader.read(part)]
    got = [r for b in read for r in b.to_pylist() if r["kind"] == "epoch"]
    assert len(got) <= len(want) + 1 and [r["row"] for r in got][: len(want)] == [r[2] for r in want]
    assert all(r["axis1"] is None and r["axis3"] is None for r in got) and any(r["axis2"] is not None for r in got)
    assert reader.pushFilters and list(reader.pushFilters([splits.GreaterThan(("ticks",), 5), splits.LessThan(("row",), 5)])) != []


def test_broken_databases_are_told_once(spark, tmp_path):
    (tmp_path / "bad.agd").write_bytes(b"nothing" * 10_000)
    database(tmp_path / "good.agd", 10)
    (tmp_path / "none.agd").write_bytes(b"")
    rows = readers.read_agd(spark, str(tmp_path), bytes=20_000)
    assert sorted(r.filename for r in readers.agd_errors(rows).collect()) == ["bad.agd", "none.agd"]
    assert rows.where("kind = 'epoch'").count() == 10


# Archives


def archive(path, seconds, rate=30, extra=b"", rng=None, info=""):
    """Records of the seconds given, in that order; each has its own values."""
    log = b""
    for n, t in enumerate(seconds):
        values = [(t * 7 + 3 * k + n) % 512 - 256 for k in range(3 * rate)]
        payload = b"" if t % 11 == 5 else struct.pack(f"<{3 * rate}h", *values)
        log += struct.pack("<BBIH", 0x1E, 0x1A, int(BEGIN.timestamp()) + t, len(payload)) + payload + b"\0"
        if n % 5 == 0:
            log += struct.pack("<BBIH", 0x1E, 0x06, 0, 4) + b"text\0"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("info.txt", f"Serial Number: X\nSample Rate: {rate}\n{info}")
        z.writestr("log.bin", log + extra)


def test_an_archive_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    seconds = [t for t in range(900) if rng.random() < 0.9 or t == 0]
    seconds[40:44] = [seconds[43], seconds[41], seconds[41], seconds[40]]  # out of order, and one that comes again
    archive(tmp_path / "one.gt3x", seconds)
    whole, many = read_gt3x(spark, str(tmp_path)), read_gt3x(spark, str(tmp_path), bytes=900)
    assert many.rdd.getNumPartitions() > 5
    found = collected(many, "sample")
    assert found == collected(whole, "sample")
    assert [r[2] for r in found] == list(range(1, 30 * (max(seconds) - min(seconds) + 1) + 1))
    last = {t: n for n, t in enumerate(seconds)}
    for t in (0, seconds[41], 700, 899):
        x = found[30 * t][4]
        assert x == (0 if t not in last or t % 11 == 5 else ((t * 7 + last[t]) % 512 - 256) / 256)
    assert found[31][3] == (BEGIN + timedelta(seconds=1 + 1 / 30)).replace(tzinfo=None, microsecond=33333)
    start = int(BEGIN.timestamp())
    part = read_gt3x(spark, str(tmp_path), bytes=900, start=start + 100, stop=start + 200)
    assert [r[2:5] for r in collected(part, "sample")] == [r[2:5] for r in found if 3000 < r[2] <= 6030]
    assert read_gt3x(spark, str(tmp_path), axes="z").where("x is not null or z is null").count() == 0


def test_a_damaged_archive(spark, tmp_path):
    archive(tmp_path / "one.gt3x", range(100), extra=b"no record here")
    rows = read_gt3x(spark, str(tmp_path), bytes=500).collect()
    assert [r.error.startswith("no record at byte") for r in rows] == [True]
    archive(tmp_path / "one.gt3x", range(3), extra=struct.pack("<BBIH", 0x1E, 0x1A, int(BEGIN.timestamp()) + 3, 180) + b"\1\1" * 6)  # cut off
    rows = read_gt3x(spark, str(tmp_path)).orderBy("sample").collect()
    assert len(rows) == 120 and rows[90].x == 257 / 256 and rows[92].x == 0


# Sectors


def packed(t):
    return (t.year - 2000) << 26 | t.month << 22 | t.day << 17 | t.hour << 12 | t.minute << 6 | t.second


def sector(sequence, t, values, rate_code=0x4A, light=0, axes=None, offset=0, session=7):
    """A data sector whose first sample is at ``t``, or ``offset`` samples before."""
    body = b""
    for v in values if axes is None else []:
        exponent = max(0, int(max(map(abs, v)) // 512).bit_length())
        body += struct.pack("<I", sum((c >> exponent & 0x3FF) << 10 * k for k, c in enumerate(v)) | exponent << 30)
    if axes is not None:
        body = b"".join(struct.pack(f"<{len(v)}h", *v) for v in values)
    fraction = 0x8000 | int(t.microsecond / 1e6 * 32768)
    rate = 3200 // (1 << (15 - (rate_code & 15)))
    shift = (int(t.microsecond / 1e6 * 32768) << 1) * rate >> 16
    head = struct.pack("<2sHHIIIHHBBBBhH", b"AX", 508, fraction, session, sequence, packed(t), light, 0, 0, 0, rate_code, 0x30 if axes is None else axes << 4 | 2, offset - shift, len(values))
    data = (head + body).ljust(510, b"\0")
    total = sum(struct.unpack("<255H", data)) & 0xFFFF
    return data + struct.pack("<H", -total & 0xFFFF)


def sector_file(path, sectors):
    path.write_bytes((b"MD" + struct.pack("<H", 1020)).ljust(1024, b"\xff") + b"".join(sectors))


def test_sectors_are_read_by_many_tasks(spark, tmp_path):
    xyz = np.round(256 * wave(120 * 60, 100)).astype(int)
    at = lambda n: BEGIN + timedelta(seconds=n * 1.2)
    sector_file(tmp_path / "one.CWA", [sector(n, at(n) + timedelta(seconds=n % 3 * 0.05), xyz[120 * n : 120 * n + 120].tolist(), offset=n % 3 * 5) for n in range(60)])
    whole, many = readers.read_cwa(spark, str(tmp_path)), readers.read_cwa(spark, str(tmp_path), bytes=4096)
    assert many.rdd.getNumPartitions() == 8
    found = collected(many, "sample")
    assert found == collected(whole, "sample") and [r[2] for r in found] == list(range(1, 7201))
    assert np.array([r[4:7] for r in found]).tolist() == (xyz / 256).tolist() and {r[7] for r in found} == {100.0}
    for n in (0, 1, 119, 120, 4000, 7199):
        assert abs((found[n][3].replace(tzinfo=timezone.utc) - BEGIN).total_seconds() - n / 100) < 1e-3
    start = BEGIN.timestamp()
    part = collected(readers.read_cwa(spark, str(tmp_path), start=start + 24, stop=start + 36, bytes=4096), "sample")
    assert part == [r for r in found if part[0][2] <= r[2] <= part[-1][2]] and 1200 <= len(part) <= 1680 and part[0][2] % 120 == 1


def test_damaged_sectors_and_other_layouts(spark, tmp_path):
    good = [sector(n, BEGIN + timedelta(seconds=n), [(256, -256, 100 * n)] * 100) for n in range(6)]
    torn = bytearray(good[2])
    torn[100] ^= 0xFF
    wide = sector(6, BEGIN + timedelta(seconds=60), [(1, 2, 3, 2048, -2048, 1024)] * 40, light=3 << 13, axes=6)
    alone = sector(7, BEGIN + timedelta(seconds=60.5), [(700, -600, 5)] * 40)
    sector_file(tmp_path / "a.cwa", [good[0], good[1], bytes(torn), b"\xff" * 512, good[4], wide, alone])
    (tmp_path / "b.cwa").write_bytes(b"no sectors")
    (tmp_path / "c.cwa").write_bytes(b"MD".ljust(1024, b"\0"))
    rows = readers.read_cwa(spark, str(tmp_path), bytes=1024).collect()
    errors = sorted((r.subject, r.error) for r in rows if r.error)
    assert errors == [("a", "sector 2: its checksum is wrong"), ("a", "sector 3: no data sector"), ("b", "no header sector")]
    samples = sorted((r for r in rows if not r.error), key=lambda r: r.sample)
    assert [r.sample for r in samples] == list(range(1, 381))
    assert (samples[300].x, samples[300].y, samples[300].z) == (1.0, -1.0, 0.5)  # the axes after the gyroscope's
    assert [samples[340][k] for k in (4, 5)] == [(700 >> 1 << 1) / 256, -600 / 256]
    assert (samples[300].timestamp - samples[299].timestamp).total_seconds() > 50


# Pages


def hexed(v):
    return f"{(v[0] & 0xFFF) << 36 | (v[1] & 0xFFF) << 24 | (v[2] & 0xFFF) << 12 | v[3] << 2 | v[4] << 1:012X}"


def page_file(path, n_pages, values, rate=50.0, head=True, end="\r\n", broken=()):
    text = ["Device Identity", "Device Unique Serial Code:012345", "Device Type:X", "", "Subject Info", "Subject Code:S:7", ""]
    text += ["Calibration Data", *[f"{a} gain:{g}{end}{a} offset:{o}" for a, g, o in (("x", 25600, 100), ("y", 25600, -200), ("z", 12800, 0))], "Volts:100", "Lux:500", "", "Memory Status", f"Number of Pages:{n_pages}", ""] if head else []
    for p in range(n_pages):
        t = BEGIN + timedelta(seconds=p * 300 / rate)
        digits = "".join(map(hexed, values[300 * p : 300 * p + 300]))
        text += ["Recorded Data", "Device Unique Serial Code:012345", f"Sequence Number:{p}", f"Page Time:{t:%Y-%m-%d %H:%M:%S}:{t.microsecond // 1000:03d}", "Unassigned:", "Temperature:21.5", "Battery voltage:4.1", "Device Status:Recording", f"Measurement Frequency:{rate}", digits[:-1] if p in broken else digits]
    path.write_text(end.join(text) + end, newline="")


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_pages_of_text(spark, tmp_path, end):
    rng = random.Random(1)
    values = [(rng.randint(-2048, 2047), rng.randint(-2048, 2047), rng.randint(-2048, 2047), rng.randint(0, 1023), rng.randint(0, 1)) for _ in range(300 * 40)]
    page_file(tmp_path / "one.BIN", 40, values, end=end, broken=(3,))
    page_file(tmp_path / "headless.bin", 1, values, head=False, end=end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = pages.read_bin(spark, str(tmp_path))
        found = rows.collect()
        assert pages._pages(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.subject, r.error) for r in found if r.error) == [("headless", "page 0: its head has no calibration"), ("one", "page 3: its samples are broken")]
    samples = sorted((r for r in found if not r.error), key=lambda r: r.sample)
    assert [r.sample for r in samples] == [*range(1, 901), *range(1201, 12_001)]
    for r in samples[::97]:
        x, y, z, light, button = values[r.sample - 1]
        assert (r.x, r.y, r.z, r.light, r.button) == pytest.approx(((x * 100 - 100) / 25600, (y * 100 + 200) / 25600, z * 100 / 12800, light * 5.0, bool(button)))
        assert abs((r.timestamp.replace(tzinfo=timezone.utc) - BEGIN).total_seconds() - (r.sample - 1) / 50) < 1e-4
    settings = {r.name: r.value for r in pages.bin_settings(spark, str(tmp_path)).where("path like '%one%'").collect()}
    assert settings["Subject Code"] == "S:7" and settings["Device Unique Serial Code"] == "012345"


# Folders


def test_a_folder_of_all_formats(spark, tmp_path):
    n, rate = 30 * 125, 30
    xyz = wave(n, rate)
    database(tmp_path / "a.agd", 4)
    log = b"".join(struct.pack("<BBIH", 0x1E, 0x1A, int(BEGIN.timestamp()) + s, 180) + np.round(256 * xyz[30 * s : 30 * s + 30]).astype("<i2").tobytes() + b"\0" for s in range(125))
    with zipfile.ZipFile(tmp_path / "b.gt3x", "w") as z:
        z.writestr("info.txt", "Subject Name: Bee\nSample Rate: 30\n")
        z.writestr("log.bin", log)
    walk = wave(100 * 125, 100)
    sector_file(tmp_path / "c.cwa", [sector(k, BEGIN + timedelta(seconds=k), np.round(256 * walk[100 * k : 100 * k + 100]).astype(int).tolist()) for k in range(125)])
    slow = wave(300 * 25, 60)
    page_file(tmp_path / "d.bin", 25, [(*np.round(v * [256, 256, 128]).astype(int).tolist(), 0, 0) for v in slow], rate=60.0)
    (tmp_path / "c.csv").write_text("Timestamp,Accelerometer X (g),Accelerometer Y (g),Accelerometer Z (g)\n" + "".join(f"{(BEGIN + timedelta(seconds=k / 30)).replace(tzinfo=None)},{v[0]},{v[1]},{v[2]}\n" for k, v in enumerate(xyz)))
    (tmp_path / "counts.csv").write_text("time,x,y,z\n2024-01-01 00:00:00,100,2000,1\n2024-01-01 00:01:00,7,30,1\n")
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.gt3x").write_bytes(b"no archive")
    (tmp_path / "short.cwa").write_bytes(b"MD".ljust(1024, b"\0"))
    batch = analyze_folder(spark, str(tmp_path))
    found = {(r.subject, r.epoch): r for r in batch.analysis.epochs.collect()}
    assert sorted({s for s, _ in found}) == ["Bee", "a", "c.csv", "c.cwa", "counts", "d"]
    assert [e for s, e in sorted(found) if s != "a"] == [1, 2] * 5
    for subject, signal, hz in (("Bee", np.round(256 * xyz) / 256, 30), ("c.csv", xyz, 30), ("c.cwa", np.round(256 * walk) / 256, 100)):
        for axis, k in (("axis1", 1), ("axis2", 0), ("axis3", 2)):
            assert [found[subject, e][axis] for e in (1, 2)] == pytest.approx(count_signal(signal[:, k], hz)[:2].tolist(), abs=60), (subject, axis)
        assert found[subject, 1].axis1 > 500 and found[subject, 2].timestamp.replace(tzinfo=timezone.utc) == BEGIN + timedelta(minutes=1)
    assert (found["counts", 1].axis1, found["counts", 1].axis2, found["counts", 2].axis1) == (2000, 100, 30) and found["d", 1].axis1 > 500
    assert sorted((r.filename, r.error) for r in batch.errors.collect()) == [("bad.gt3x", "File is not a zip file"), ("none.csv", "no acceleration among a, b"), ("short.cwa", "it has no whole epoch")]
    assert batch.table.count() == 6 and {r.subject: r.filename for r in batch.info.collect()}["Bee"] == "b.gt3x"


def test_sleep_of_a_folder(spark, tmp_path):
    rng = random.Random(4)
    counts = [rng.choice([0, 0, 5, 400]) if 300 < i < 800 and i % 40 else 900 + i % 7 for i in range(1300)]
    db = sqlite3.connect(tmp_path / "night.agd")
    db.execute("CREATE TABLE data (dataTimestamp INTEGER, axis1 INTEGER)")
    db.executemany("INSERT INTO data VALUES (?, ?)", [(TICKS + i * 600_000_000, 0 if 320 < i < 780 and i % 50 else c) for i, c in enumerate(counts)])
    db.commit()
    db.close()
    archive(tmp_path / "still.gt3x", range(130))
    (tmp_path / "bad.agd").write_bytes(b"nothing")
    (tmp_path / "other.csv").write_text("x,y,z\n1,2,3\n")
    batch = analyze_sleep_folder(spark, str(tmp_path), least=100)
    summary = {r.subject: r for r in batch.summary.collect()}
    assert set(summary) == {"night", "still", "bad"} and summary["bad"].total_epochs is None and summary["night"].total_epochs == 1300
    assert summary["night"].n_periods >= 1 and summary["still"].n_periods == 0
    assert sorted((r.filename, r.error[:9]) for r in batch.errors.collect()) == [("bad.agd", "file is n"), ("other.csv", ".csv isn'")]
    states = lambda rescore: [r.sleep_wake for r in analyze_sleep(batch.epochs.where("subject = 'night'").select("subject", "epoch", "timestamp", "axis1"), rescore=rescore, least=100)[0].orderBy("epoch").collect()]
    assert [r.sleep_wake for r in batch.epochs.where("subject = 'night'").orderBy("epoch").collect()] == states(True) != states(False)
