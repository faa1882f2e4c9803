"""A content-addressed archive of captured pages: payload bytes once, exact headers apart, records by a join.

``store`` writes two tables below a folder:

* ``payloads`` (digest, payload): every distinct payload once, under its SHA-256.
  Rows of one SHA-256 must agree in length and SHA-1 as well, else writing stops;
  no payload moves between tasks unless one page id repeats with it.
* ``headers`` (digest, warc_header, http_header): for each page the exact bytes
  that stand before its payload in a WARC/1.1 file.  Of equal payloads of at
  least ``least`` bytes the page with the largest id is a response, the others
  are revisits that refer to it; smaller payloads are responses always.

``records`` joins the two again; each payload is hashed as it is read, and
reading stops where it is not what its digest names.  ``export`` writes the records as
ordinary WARC files (a record ends with two line breaks, so they are lines of
Spark's text writer), ``import_files`` takes such files apart.

Defined results: null html is an empty payload; a null page id is below all
others and stays null; rows equal in page id and payload are a record each, one of them the
response, and a revisit among them refers to its own page id; a null url has no
target line, line breaks and blanks in it are percent-encoded; an empty table makes an
empty archive; other columns are ignored.  Page ids are numbers, or strings without blanks.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import few
from noteloom.tables import scratch, written

# Fixed values of the format (WARC 1.1) and of base 32 (RFC 4648).
VERSION, BREAK = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits that ``conv`` writes for base 32.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Date of captures whose table has none.
UNDATED = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are always stored as responses.
LEAST = 0
#: Records in an exported file, at most.
FILE_RECORDS = 10_000


def base32_of_hex(c: Column) -> Column:
    """Base 32 of a SHA-1 in hex: five bytes are eight digits."""
    parts = [F.lpad(F.conv(F.substring(c, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string").cast("binary"), F.lit(b""))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _encoded(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def record_id(page_id: Column, digest: Column) -> Column:
    """Names a capture by its page and payload."""
    return F.when(page_id.isNull(), F.concat(F.lit("<urn:x-nopage:"), digest, F.lit(">"))).otherwise(F.concat(F.lit("<urn:x-page:"), page_id.cast("string"), F.lit(":"), digest, F.lit(">")))


def page_of(named: Column, kind: str) -> Column:
    """The page id in a record's name; null for a record without one."""
    return F.nullif(F.regexp_extract(named, r"^<urn:x-page:(.*):[A-Z2-7]*>$", 1), F.lit("")).cast(kind)


def field(header: Column, name: str) -> Column:
    """A named field of a header; null where it is absent."""
    return F.nullif(F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _headers(rows: DataFrame, date: str) -> DataFrame:
    """Exact header bytes of rows (page_id, url, digest, sha1, n_bytes, refers, to)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"), _line("Content-Length", F.col("n_bytes").cast("string")), F.lit(BREAK))
    own, revisit = base32_of_hex(F.col("sha1")), F.col("refers")
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    warc = F.concat(
        F.lit(VERSION + BREAK),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), own)),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _encoded(F.col("url").cast("string"))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), own)),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record_id(F.col("to"), own)), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(BREAK),
    )
    return rows.select("digest", warc.alias("warc_header"), http.alias("http_header"))


def store(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = UNDATED) -> None:
    """Write the archive of ``pages`` below ``path``."""
    whole = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), _payload(F.col(f"`{html_col}`")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keyed = whole.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    keyed = written(keyed, "captures")
    same = (F.min("sha1") == F.max("sha1")) & (F.min("n_bytes") == F.max("n_bytes"))
    top = F.when(same, F.max(F.struct("page_id", F.negative("row").alias("back")))).otherwise(F.raise_error(F.lit("different payloads under one SHA-256")))
    repeated = few(written(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).filter("n > 1").select("digest", "top"), "repeated"))
    # single payloads go from the scan to the store
    single = whole.join(repeated, "digest", "left_anti").select("digest", "payload")
    winners = whole.join(repeated, "digest").filter(F.col("page_id").eqNullSafe(F.col("top.page_id"))).select("digest", "payload").dropDuplicates(["digest"])
    single.unionByName(winners).write.mode("overwrite").parquet(f"{path}/payloads")
    first = F.col("top").isNull() | (F.col("row") == -F.col("top.back")) | (F.col("n_bytes") < least)
    marked = keyed.join(repeated, "digest", "left").withColumns({"refers": ~first, "to": F.col("top.page_id")})
    _headers(marked, date).write.mode("overwrite").parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with what they prove to be: digest, payload, n_bytes, payload_digest."""
    rows = spark.read.parquet(f"{path}/payloads")
    proved = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest names: "), F.col("digest"))))
    return rows.select(proved.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("n_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))


def records(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the archive: page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload (in full, for revisits too), record (its exact bytes)."""
    heads = spark.read.parquet(f"{path}/headers")
    kind = field(F.col("warc_header"), "WARC-Type")
    front = F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"))
    # both sides take plain exchanges: a payload that many pages share can be split
    return heads.join(payloads(spark, path), "digest").select(
        page_of(field(F.col("warc_header"), "WARC-Record-ID"), id_type).alias("page_id"),
        kind.alias("record_type"),
        page_of(field(F.col("warc_header"), "WARC-Refers-To"), id_type).alias("refers_to"),
        field(F.col("warc_header"), "WARC-Target-URI").alias("url"),
        F.col("n_bytes").alias("payload_bytes"),
        "payload_digest",
        "payload",
        F.when(kind == "revisit", front).otherwise(F.concat(front, F.col("payload"))).alias("record"),
    )


def archive_report(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Stores ``pages``, reads the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to of every page."""
    spark = pages.sparkSession
    path = path or scratch(spark, "archive")
    store(pages, path, least=least)
    return records(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(spark: SparkSession, path: str, out: str, compression: str = "gzip", per_file: int = FILE_RECORDS) -> None:
    """The archive's records as WARC files below ``out``."""
    rows = records(spark, path).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", BREAK * 2).option("compression", compression).option("maxRecordsPerFile", per_file).text(out)


def parsed(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(header, http header, payload) of each record of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while data.startswith(VERSION.encode(), at):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        size = next(int(line[15:]) for line in header.split(b"\r\n") if line[:15].lower() == b"content-length:")
        block = data[end : end + size]
        cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
        yield header.decode(), block[:cut].decode(), block[cut:]
        at = end + size + 4


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: warc_header, http_header, payload.  A file is read whole by one task, so files are to be of moderate size (see ``export``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parsed(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.binary()))], ["warc_header", "http_header", "payload"])

    return files.mapInArrow(run, "warc_header string, http_header string, payload binary")
