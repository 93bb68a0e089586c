"""Bouts of a live stream against the batch."""

import random

from pyspark.sql import functions as F
from strideframe.operators import bouts
from strideframe.streaming.bouts import OpenBout, bouts_stream

from .test_detectors import scan_drops

SCHEMA = "subject string, epoch long, timestamp timestamp, flag boolean"


def test_the_rule_epoch_by_epoch():
    rng = random.Random(1)
    for _ in range(500):
        flags = [rng.random() < rng.choice([0.3, 0.8]) for _ in range(rng.randint(1, 80))] + [False] * 4
        least, allowed = rng.randint(1, 8), rng.randint(0, 3)
        bout = OpenBout(least, allowed, 0, 0, 0)
        found = [b for e, f in enumerate(flags, 1) for b in bout.take(e, f)]
        assert [(a, b) for a, b, _ in found] == scan_drops(flags, least, allowed)
        assert all(n == sum(flags[a - 1 : b]) for a, b, n in found)


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    """Epochs come in files, late by up to half an hour and some of them twice; at last one of far ahead moves the watermark."""
    rng = random.Random(2)
    rows = [(s, e, rng.random() < (0.85 if e // 40 % 2 else 0.3)) for s in ("a", "b", "c") for e in range(1, 401)]
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 30)
    files = [late[i : i + 150] + late[max(0, i - 20) : i] for i in range(0, len(late), 150)] + [[("z", 3000, False)], [("z", 3001, False)]]
    stamped = lambda part: spark.createDataFrame(part, "subject string, epoch long, flag boolean").select("subject", "epoch", F.timestamp_micros(F.lit(1704067200000000) + F.col("epoch") * 60_000_000).alias("timestamp"), "flag")
    for i, part in enumerate(files):
        stamped(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = bouts_stream(stream, 6, 2, "40 minutes").writeStream.outputMode("append").format("memory").queryName("live_bouts")
    query = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    found = sorted(tuple(r) for r in spark.table("live_bouts").collect())
    whole = stamped(rows).withColumn("intensity", F.when(F.col("flag"), "moderate").otherwise("light"))
    # In the batch trailing epochs at the end of the data may count; the stream has no end.
    want = sorted((r.subject, r.start_index, r.end_index, r.mvpa_minutes) for r in bouts.mvpa_bouts(whole, 6, 2).collect() if r.end_index < 398)
    assert [b for b in found if b[2] < 398] == want and len(want) > 20
