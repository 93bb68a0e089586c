import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F
from strideframe.llm import warc

ROWS = [(i, f"http://x/{i}\r\nInjected: no", f"<p>{i % 7}</p>" * 60) for i in range(60)] + [(100 + i, None, "short") for i in range(3)] + [(200, "u", None), (201, "u", ""), (None, "u", "ü" * 90), (7, "again", "<p>0</p>" * 60)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def test_round_trip(spark, pages):
    index = warc.archive(pages)
    rows = warc.read_archives(index, payloads=True).collect()
    assert len(rows) == len(ROWS)
    some = index.where("page_id = 5 or page_id = 201")
    assert sorted(r.page_id for r in warc.read_archives(some).collect()) == [5, 201]
    plain = lambda df: sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type) for r in df.collect())
    assert plain(warc.read_archives(index)) == plain(warc.read_archives(index, payloads=True))
    least = {}
    for i, _, html in ROWS:
        if html and len(html.encode()) >= 100 and i is not None:
            least[html] = min(i, least.get(html, i))
    texts = {(i, (h or "")) for i, _, h in ROWS}
    for r in rows:
        html = next(h for i, h in texts if i == r.page_id and hashlib.sha256(h.encode()).hexdigest() == r.payload_digest)
        first = least.get(html)
        revisit = first is not None and first != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.payload_bytes == len(html.encode()) and r.payload == (b"" if revisit else html.encode())


def test_one_record_from_one_frame(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    bundle = warc.Bundle()
    placed = []
    for i, url, html in ROWS:
        payload = (html or "").encode()
        data = warc.record(i, url or "", payload, hashlib.sha256(payload).hexdigest(), None)
        placed.append((payload, *bundle.add(data), len(data)))
    path = tmp_path / "one.warc.zst"
    path.write_bytes(bundle.finish())
    reached = []

    class Watched(io.BytesIO):
        def read(self, n=-1):
            reached.append((self.tell(), n))
            return super().read(n)

    with monkeypatch.context() as patch:
        patch.setattr(warc, "_open", lambda name: Watched(path.read_bytes()))
        read = warc.Reader()
        for payload, frame, place, size in placed:
            headers, block = read("one", frame, place, size)
            assert block == payload and "Injected" not in headers
    frames = warc.seek_table(io.BytesIO(path.read_bytes()))
    assert len(frames) > 5 and reached[2:] == [f[:2] for f in frames]  # after the seek table each frame, once
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_empty_table(spark, pages):
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_columns_with_clashing_names(pages):
    clash = pages.withColumn("digest", F.lit("own")).withColumn("payload", F.lit("own")).withColumn("first", F.lit(9)).withColumn("BUNDLE", F.lit("own"))
    assert sorted(r.payload_digest for r in warc.read_archives(warc.archive(clash)).collect()) == sorted(r.payload_digest for r in warc.read_archives(warc.archive(pages)).collect())
