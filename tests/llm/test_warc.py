import hashlib
import io
import random

import pytest

from nightframe.llm import scratch, warc


def test_revisits_resolve(spark):
    rng = random.Random(6)
    bodies = ["a" * 99, "b" * 100, "é" * 50, "c" * 5000, "WARC/1.1\r\n\r\n" * 20, None, ""]
    rows = [(i, rng.choice(["http://x/\r\ny", None, "http://é/"]), rng.choice(bodies)) for i in range(120)] + [(None, "u", "b" * 100), (5, "v", "d" * 200), (5, "v", "d" * 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    manifest = warc.write(warc.decide(df), scratch.new_folder(spark, "warc"))
    got = warc.resolve(warc.read(manifest)).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest.collect())
    raw = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None and len(raw(h)) >= 100:
            first[raw(h)] = min(i, first.get(raw(h), i))
    want = [(i, len(raw(h)), hashlib.sha256(raw(h)).hexdigest(), *(("revisit", first[raw(h)]) if i is not None and i > first.get(raw(h), i) else ("response", None))) for i, _, h in rows]
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    stored = warc.read(manifest, payloads=True).filter("record_type = 'response'").collect()
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in stored)


def test_a_cut_archive_raises():
    import gzip

    data = gzip.compress(warc.record(1, "u", b"x" * 500, "d", "response", None)[:-300])
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve(warc.read(warc.write(warc.decide(df), scratch.new_folder(spark, "warc")))).count() == 0
