"""The archive: contract rows by brute force, exact round trips, damage found, files written and read."""

import base64
import hashlib
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteloom.llm import warc

PAGES = [
    (1, "http://a.org/x", "<p>one</p>"), (2, "http://a.org/y", "<p>one</p>"), (9, "http://b.org/", "<p>one</p>"), (3, None, None), (4, "u v\r\nw", ""), (5, "", "é日本\x00"), (None, "http://n", "<p>one</p>"),
    (None, "http://n", "lonely"), (6, "dup", "same row"), (6, "dup", "same row"), (6, "other", "same row"), (7, "http://c", "x" * 200_000), (8, "http://d", "a\r\n\r\nWARC/1.1\r\nb"), (7, "http://c", "y"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "k", None, 1) for p in PAGES], "page_id long, url string, html string, digest string, `row` string, n_bytes int").repartition(3)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def expected(pages, least=0):
    """Rows of the contract, one page after another."""
    groups = {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    out = Counter()
    for data, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        for k, i in enumerate(ids):
            first = k == 0 or len(data) < least
            out[(i, len(data), digest, "response" if first else "revisit", None if first else ids[0])] += 1
    return out


@pytest.mark.parametrize("least", [0, 10, 1_000_000])
def test_report(pages, folder, least):
    got = warc.archive_report(pages, folder, least)
    assert Counter(map(tuple, got.collect())) == expected(PAGES, least)


def test_payloads_once_and_records_exact(spark, pages, folder):
    warc.store(pages, folder)
    kept = spark.read.parquet(f"{folder}/payloads").collect()
    assert Counter(bytes(r.payload) for r in kept) == Counter({(h or "").encode() for _, _, h in PAGES})
    assert all(hashlib.sha256(r.payload).hexdigest() == r.digest for r in kept)
    rows = warc.records(spark, folder).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in rows) == Counter((i, (h or "").encode()) for i, _, h in PAGES)
    for r in rows:
        (header, http, payload), = warc.parsed(bytes(r.record) + b"\r\n\r\n")
        assert bytes(r.record) == header.encode() + http.encode() + payload
        assert payload == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert f"Content-Length: {len(r.payload)}\r\n" in http


def test_export_and_import(spark, pages, folder):
    warc.store(pages, folder)
    want = Counter(bytes(r.record) for r in warc.records(spark, folder).collect())
    for compression in ("gzip", "none"):
        warc.export(spark, folder, f"{folder}-{compression}", compression, 3)
        back = warc.import_files(spark, f"{folder}-{compression}").collect()
        assert Counter(r.warc_header.encode() + r.http_header.encode() + bytes(r.payload) for r in back) == want


def test_damage_is_found(spark, pages, folder):
    warc.store(pages, folder)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{folder}-bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-bad/headers")
    with pytest.raises(Exception, match="not what its digest names"):
        warc.records(spark, f"{folder}-bad").collect()


def test_many_copies_and_string_ids(spark, folder):
    rows = [(f"p{k}", "u", "copy" if k % 3 else f"own {k}") for k in range(300)]
    got = warc.archive_report(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(7), folder)
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_empty(spark, folder):
    got = warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert got.collect() == [] and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_base32(spark):
    texts = ["", "a", "zz", "ü" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_of_hex(F.sha1("t")).alias("b")).collect()
    assert [r.b for r in got] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
