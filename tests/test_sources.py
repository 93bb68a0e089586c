import sqlite3

import pytest
from pyspark.sql import functions as F
from strideframe.operators import sleep, wear
from strideframe.plans.analysis import analyze_folder, enrich
from strideframe.sources import gt3x, readers, sinks
from strideframe.streaming.epochs import epoch_stream

START = (1704067200 + 62135596800) * 10_000_000


def _agd(path, epochs=5, subject="P1"):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE data (dataTimestamp INTEGER, axis1 INTEGER, axis2 INTEGER, steps INTEGER)")
    db.executemany("INSERT INTO data VALUES (?, ?, ?, ?)", [(START + i * 600_000_000, i, 2 * i, 1) for i in range(epochs)])
    db.execute("CREATE TABLE settings (settingName TEXT, settingValue TEXT)")
    db.executemany("INSERT INTO settings VALUES (?, ?)", [("subjectname", subject), ("deviceserial", "S9"), ("sex", "Female"), ("age", "0"), ("mass", "80"), ("height", "")])
    db.execute("CREATE TABLE filters (filterStartTimestamp INTEGER, filterStopTimestamp INTEGER)")
    db.execute("INSERT INTO filters VALUES (?, ?)", (START, START + 600_000_000))
    db.commit()
    db.close()


def test_count_databases(spark, tmp_path):
    _agd(tmp_path / "one (60s).agd")
    _agd(tmp_path / "two.AGD", 3)
    _agd(tmp_path / "three.agd", 2, "P3")
    (tmp_path / "bad.agd").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_bytes(b"nothing")
    files = readers.device_files(spark, str(tmp_path), ("agd",))
    rows = readers.read_agd(spark, str(tmp_path)).cache()
    epochs = readers.agd_epochs(rows)
    assert {r.subject: r["count"] for r in epochs.groupBy("subject").count().collect()} == {"one": 5, "two": 3, "P3": 2}  # a name that two files have tells neither
    first = epochs.where("subject = 'one' and epoch = 1").select(F.col("timestamp").cast("string").alias("t"), "axis3", "axis2").first()
    assert (first.t, first.axis3, first.axis2) == ("2024-01-01 00:00:00", None, 0.0)
    metadata = readers.agd_metadata(files).collect()
    assert sorted((r.n_epochs, r.n_settings, r.n_filters, r.error is None) for r in metadata) == [(0, 0, 0, False), (2, 6, 1, True), (3, 6, 1, True), (5, 6, 1, True)]
    assert [r.filename for r in readers.agd_errors(rows).collect()] == ["bad.agd"]
    about = {r.subject: r for r in readers.agd_info(rows).collect()}
    assert (about["P3"].filename, about["P3"].serial_number, about["P3"].gender, about["P3"].weight_lbs) == ("three.agd", "S9", "F", 176.4)
    info = readers.subject_info(rows.where("kind = 'setting'")).first()
    assert (info.subject_id, info.sex, info.age, info.weight_lbs, info.height) == ("P1", "F", 0.0, 176.4, None)
    assert readers.agd_filters(rows).where("stop_time > start_time").count() == 3


def test_a_folder_is_analysed_and_its_errors_told(spark, tmp_path):
    _agd(tmp_path / "one.agd", 120, "A")
    (tmp_path / "bad.agd").write_bytes(b"nothing")
    batch = analyze_folder(spark, str(tmp_path))
    assert [(r.subject, r.n_epochs, r.valid_days) for r in batch.table.collect()] == [("A", 2, 0)]  # two epochs in its interval
    assert batch.analysis.epochs.count() == 120 and [r.filename for r in batch.errors.collect()] == ["bad.agd"]
    sinks.export_batch(batch.analysis.epochs, wear.valid_days(batch.analysis.epochs), str(tmp_path / "out"), info=batch.info)
    row = spark.read.csv(f"{tmp_path}/out/batch", header=True).first()
    assert (row["Subject"], row["Filename"], row["Gender"], row["Number of Epochs"]) == ("A", "one.agd", "F", "120") and len(row) == 44


def test_raw_databases(spark, tmp_path):
    import numpy as np
    from strideframe.operators.raw import count_signal

    n = 60 * 61
    wave = [float(v) for v in 0.5 * np.sin(np.arange(n) * 2 * np.pi * 1.8 / 60)]
    for name, columns, settings in (("a", "x REAL, y REAL, z REAL", [("samplerate", "60"), ("startdatetime", str(START))]), ("b", "dataTimestamp INTEGER, label TEXT, p REAL, q REAL, r REAL", [("samplerate", "60")]), ("c", "timestamp TEXT, axis1 REAL, axis2 REAL, axis3 REAL", [])):
        db = sqlite3.connect(tmp_path / f"{name}.agd")
        db.execute(f"CREATE TABLE accelerometer ({columns})")
        lead = {"a": lambda i: (), "b": lambda i: (START + i * 10_000_000 // 60, "t"), "c": lambda i: (f"2024-01-01 00:{i // 1800:02d}:{i // 30 % 60:02d}",)}[name]
        db.executemany(f"INSERT INTO accelerometer VALUES ({', '.join('?' * len(columns.split(',')))})", [(*lead(i), w, 1.0, 0.0) for i, w in enumerate(wave)])
        db.execute("CREATE TABLE data (dataTimestamp INTEGER, axis1 INTEGER)")
        db.execute("INSERT INTO data VALUES (1, 9)")
        db.execute("CREATE TABLE settings (settingName TEXT, settingValue TEXT)")
        db.executemany("INSERT INTO settings VALUES (?, ?)", settings)
        db.commit()
        db.close()
    rows = readers.read_agd(spark, str(tmp_path)).cache()
    assert {(r.n_epochs, r.n_samples, r.error) for r in readers.agd_metadata(readers.device_files(spark, str(tmp_path), ("agd",))).collect()} == {(1, n, None)}
    assert {r.subject: r.rate for r in readers.agd_samples(rows).select("subject", "rate").distinct().collect()} == {"a": 60.0, "b": 60.0, "c": 30.0}
    found = {(r.subject, r.epoch): r for r in readers.agd_epochs(rows).withColumn("timestamp", F.col("timestamp").cast("string")).collect()}
    assert sorted(found) == [("a", 1), ("b", 1), ("c", 1), ("c", 2)]
    for (s, e), r in found.items():
        assert r.axis1 == count_signal(np.array(wave), 30 if s == "c" else 60)[e - 1] > 100 and r.axis2 == r.axis3 == r.steps == 0
        assert r.timestamp == f"2024-01-01 00:0{e - 1}:00"


def test_csv(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Time,Acc X,Acc Y,Acc Z\n2024-01-01 00:00:00,0,1,0\n2024-01-01 00:00:01,0.1,1,0\n")
    df, is_raw = readers.read_csv(spark, str(tmp_path / "raw.csv"))
    assert is_raw and df.count() == 2 and df.first().subject == "raw"
    (tmp_path / "counts.csv").write_text("x,y,z\n100,1,0\n3,1,0\n")
    df, is_raw = readers.read_csv(spark, str(tmp_path / "counts.csv"), rate=1)
    assert not is_raw and [r.s for r in df.orderBy("sample").select(F.second("timestamp").alias("s")).collect()] == [0, 1]
    with pytest.raises(ValueError):
        (tmp_path / "none.csv").write_text("a,b\n1,2\n")
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("x,y,z\n1,2,3\n")
    (tmp_path / "two" / "b.csv").write_text("z,accelY,Axis X\n1,2,3\n")
    assert {(r.subject, r.x, r.y, r.z) for r in readers.read_csv(spark, str(tmp_path / "two"))[0].collect()} == {("a", 1, 2, 3), ("b", 3, 2, 1)}
    lines = ["header"] * 10 + ["Accelerometer X,Accelerometer Y,Accelerometer Z", "0.1,0.2,0.3", "0.4,0.5,0.6"]
    (tmp_path / "device.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_device_csv(spark, str(tmp_path / "device.csv")).orderBy("sample").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(0.1, 0.2, 0.3), (0.4, 0.5, 0.6)]


def test_csv_columns_of_real_names():
    """Names as devices and their programs write them."""
    for names, found in (
        (["Timestamp", "Accelerometer X (g)", "Accelerometer Y (g)", "Accelerometer Z (g)"], "Accelerometer {} (g)"),
        (["elapsedtime", "acc_x_g", "acc_y_g", "acc_z_g"], "acc_{}_g"),
        (["date_time", "Raw Accel.X", "Raw Accel.Y", "Raw Accel.Z"], "Raw Accel.{}"),
        (["time", "accelerometerX", "accelerometerY", "accelerometerZ"], "accelerometer{}"),
        (["DateTime", "X (g)", "Y (g)", "Z (g)"], "{} (g)"),
        (["t", "axis_x", "axis_y", "axis_z", "x"], None),
    ):
        axes = [readers.axis_column(names, a) for a in "xyz"]
        if found:
            assert [a.lower() for a in axes] == [found.format(a).lower() for a in "xyz"] and readers.time_column(names) == names[0]
        else:
            assert axes == ["x", "axis_y", "axis_z"] and readers.time_column(names) is None
    assert readers.axis_column(["X [mg]", "max"], "x") is None


def test_dispatch(spark):
    with pytest.raises(ValueError):
        readers.read_accelerometer(spark, "x.docx")
    assert readers.device_support(spark).where("available").count() == 5


def test_raw_archives(spark, tmp_path):
    import struct
    import zipfile

    def record(kind, time, payload):
        return struct.pack("<BBIH", 0x1E, kind, time, len(payload)) + payload + b"\0"

    wide = struct.pack("<6h", 256, 0, -256, 0, 256, 128)  # two samples, x y z
    bits = "".join(f"{v & 0xFFF:012b}" for v in (341, 0, -341, 0, 682, 0))  # two samples, y x z
    packed = int(bits, 2).to_bytes(len(bits) // 8, "big")
    with zipfile.ZipFile(tmp_path / "s1.gt3x", "w") as z:
        z.writestr("info.txt", "Serial Number: X\nSample Rate: 2\n")
        z.writestr("log.bin", record(0x1A, 1704067200, wide) + record(0x06, 1704067201, b"text") + record(0x00, 1704067202, packed))
    (tmp_path / "bad.gt3x").write_bytes(b"no archive")
    rows = readers.read_accelerometer(spark, str(tmp_path / "*.gt3x")).orderBy("subject", "sample").collect()
    assert rows[0].subject == "bad" and rows[0].error
    assert [(r.x, r.y, r.z) for r in rows[1:]] == [(1, 0, -1), (0, 1, 0.5), (0, 0, 0), (0, 0, 0), (0, 1, -1), (2, 0, 0)]
    assert rows[1].rate == 2.0
    settings = {(r.path.rsplit("/", 1)[1], r.name): r.value for r in gt3x.gt3x_settings(readers.device_files(spark, str(tmp_path), ("gt3x",))).collect()}
    assert settings == {("s1.gt3x", "deviceserial"): "X", ("s1.gt3x", "samplerate"): "2", **{("bad.gt3x", n): v for n, v in gt3x.DEFAULT_SETTINGS.items()}}


def test_reports_are_written(spark, tmp_path):
    rich = enrich(readers.demo_epochs(spark, 2, 2)).cache()
    sinks.export_reports(rich, str(tmp_path))
    daily = spark.read.csv(f"{tmp_path}/daily", header=True)
    assert daily.count() == 4 and "% in Sedentary" in daily.columns and "Day of Week" in daily.columns
    assert spark.read.csv(f"{tmp_path}/hourly", header=True).count() == 96
    assert [len(spark.read.csv(f"{tmp_path}/{n}", header=True).columns) for n in ("summary", "daily", "hourly")] == [44, 47, 47]
    sinks.export_sleep(sleep.sleep_periods(sleep.cole_kripke(rich), least=5), str(tmp_path))
    assert [len(spark.read.csv(f"{tmp_path}/{n}", header=True).columns) for n in ("sleep_details", "sleep_summary")] == [22, 23]


def test_stream(spark, tmp_path):
    rows = spark.range(300).select(F.lit("a").alias("subject"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000000).alias("timestamp"), *[F.lit(1.0).alias(f"axis{k}") for k in (1, 2, 3)])
    rows.write.parquet(f"{tmp_path}/in")
    stream = epoch_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 60, "1 minute")
    query = stream.writeStream.outputMode("append").format("memory").queryName("epochs_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("epochs_out").orderBy("timestamp").collect()
    assert found and all(r.axis1 == 60.0 and r.n_samples == 60 for r in found)
