import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from lexiquarry.llm import store
from lexiquarry.llm.common import scratch
from lexiquarry.llm.warc import WarcDataSource, base32_sha1, member, record, records, warc_round_trip, write_pages

SCHEMA = "page_id long, url string, html string, digest string"
PAGES = [
    (1, "http://a/x y", "<p>é</p>", None), (2, None, "<p>é</p>", None), (9, "http://b", "<p>é</p>", "q"), (3, "u", None, None), (4, "u", "", None),
    (5, "http://c\r\nX: y", "unique", None), (6, "z", "long " * 200_000, None), (7, "z", "long " * 200_000, None), (None, "n", "alone", None), (8, "t", "twin", None), (8, "t", "twin", None),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = warc_round_trip(spark.createDataFrame(PAGES, SCHEMA)).collect()
    top = {}
    for i, _, t, _ in PAGES:
        if i is not None:
            top[t or ""] = max(top.get(t or "", -1), i)
    want = []
    for i, _, t, _ in PAGES:
        other = top.get(t or "")
        refers = other if other is not None and other != i else None
        want.append((i, len((t or "").encode()), digest(t), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_digest_expression(spark):
    df = spark.createDataFrame([("",), ("a",), ("é" * 99,)], "t string")
    assert all(r.d == digest(r.t) for r in df.select("t", base32_sha1(F.col("t").cast("binary")).alias("d")).collect())


def test_predicates_and_projection(spark):
    folder = scratch(spark, "w")
    write_pages(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), folder)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("warc").load(folder)
    kept = df.where("record_type = 'revisit' and target_uri = 'z'").select("record_id", "payload", "payload_length")
    assert [tuple(r) for r in kept.collect()] == [("<urn:page-id:6>", None, 1_000_000)]
    assert df.where("target_uri like 'http://%'").count() == 3
    assert spark.read.format("warc").option("payload", "false").load(folder).where("payload is not null").count() == 0


def test_unwanted_payloads_stay_packed():
    texts = [b"x" * 300_000, b"y", b"z" * 500_000]
    raw = [record(i, f"u{i}", t, "D", None) for i, t in enumerate(texts)]
    for data in (b"".join(map(member, raw)), b"".join(gzip.compress(r) for r in raw), b"".join(raw)):
        stats = {}
        got = list(records(memoryview(data), lambda r: r["target_uri"] == "u1", True, stats))
        assert [r["payload"] for r in got] == [b"y"]
        assert stats.get("bytes", 0) < 20_000
        assert [r["payload"] for r in records(memoryview(data), lambda r: True, True)] == texts


def test_store_files(tmp_path):
    store.put(f"file://{tmp_path}/a/b.warc", [b"1", b"2"])
    assert bytes(store.get(f"file://{tmp_path}/a/b.warc")) == b"12"
    assert store.files(f"file://{tmp_path}", (".warc",)) == [f"file://{tmp_path}/a/b.warc"]
