"""Web archive records with content-addressed payloads.

``write`` keeps two tables. ``payloads`` has the bytes of each distinct payload
once, under their SHA-256 digest. ``headers`` has the exact header of each
record: the lines of a WARC 1.1 record and, after them, the HTTP header that its
block begins with. ``records`` joins the two into the original records, byte for
byte; each payload's digest and length are computed again on the way, and a
missing or damaged payload is an error. ``parsed`` reads fields and payload out
of records. ``to_files`` and ``from_files`` exchange records with plain WARC
files.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the
largest page_id is the response and the others are revisits, which have no
payload of their own and name the response's record; smaller payloads are
responses all. Rows that share the largest page_id are responses all, revisits
name the one with the largest url. Where no row of a payload has a page_id, all
are responses. Null html is an empty payload. A null url stays out of the
header; white space and control characters of a url are percent-encoded.
Repeated rows are records of their own, told apart by their copy's number. An
empty table gives empty tables.

Scale: identical rows are counted before they are dealt out. Texts are dealt by
digest twice: once to keep one copy (copies in one task meet before they are
sent), once to meet their headers. A payload with more than one response has
fewer than ``LEAST`` bytes, so the facts that ``meet`` broadcasts are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, meet, stored, table

LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class Archive(NamedTuple):
    """headers: record_id, digest, response, header; payloads: digest, n_bytes, payload."""

    headers: DataFrame
    payloads: DataFrame


def _identity(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A record's identifier, from all that tells it apart."""
    parts = F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"), copy.alias("c")))
    h = F.sha2(parts, 256)
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _address(url: Column) -> Column:
    for char in " \t\r\n":
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(url, r"[\x00-\x1f\x7f]", "%00")


def write(pages: DataFrame, least: int = LEAST, date: str = DATE) -> Archive:
    """pages(page_id, url, html) -> the archive, stored in the checkpoint folder."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    coded = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload")})
    rows = cut(coded.groupBy("page_id", "url", "digest", "n_bytes", F.sha1("payload").alias("sha1")).agg(F.count(F.lit(1)).alias("copies")))
    owners = cut(rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("owner"), F.count(F.lit(1)).alias("n")))
    every = meet(rows, owners.drop("n"), owners, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    least_of = F.col("owner.page_id")
    revisit = (F.col("n_bytes") >= least) & least_of.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < least_of))
    http = F.concat(F.lit(HTTP), _line("Content-Length", F.col("n_bytes")), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    record_id = _identity(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    response_id = _identity(least_of, F.col("owner.url"), F.col("digest"), F.lit(1).cast("long"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _address(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, response_id)),
        _line("X-Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit("\r\n"),
        http,
    )
    headers = every.select(record_id.alias("record_id"), "digest", (~revisit).alias("response"), header.alias("header"))
    return Archive(stored(headers, "headers"), stored(coded.select("digest", "n_bytes", "payload").dropDuplicates(["digest"]), "payloads"))


def records(archive: Archive) -> DataFrame:
    """The archive's records, whole: one column, ``record`` (string)."""
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))
    verified = F.when(sound, F.col("payload").cast("string")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string"))
    answers = archive.headers.where("response").select("digest", "header")
    bodies = archive.payloads.select("digest", verified.alias("body"))
    counts = answers.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    body = F.coalesce("body", F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("string"))
    whole = meet(answers, bodies, counts, "digest", "left").select(F.concat("header", body, F.lit(END)).alias("record"))
    return whole.unionByName(archive.headers.where("not response").select(F.concat("header", F.lit(END)).alias("record")))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def parsed(rows: DataFrame) -> DataFrame:
    """record -> record_id, record_type, page_id, url, refers_to (a record_id), sha1 (as the header has it), payload (null for a revisit)."""
    head = rows.select("record", F.substring_index("record", END, 1).alias("head"))
    n = F.length("head") + len(END)
    block = head.select("head", F.substring("record", n + 1, F.length("record") - n - len(END)).alias("block"))
    whole = F.when(F.octet_length("block") == _field("Content-Length").cast("int"), F.col("block")).otherwise(F.raise_error(F.lit("a record's length is wrong")).cast("string"))
    body = F.substring("block", F.length(F.substring_index("block", END, 1)) + len(END) + 1, F.length("block"))
    return block.withColumn("block", whole).select(
        _field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"), _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Refers-To").alias("refers_to"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("sha1"), F.when(_field("WARC-Type") == "response", body).alias("payload"),
    )


def facts(rows: DataFrame) -> DataFrame:
    """Parsed records -> page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id); a revisit has the payload of the response that it names."""
    told = cut(rows.select("record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest")))
    again, first = told.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("named")), told.where("record_type = 'response'")
    of = first.select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    counts = again.groupBy("named").agg(F.count(F.lit(1)).alias("n"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(meet(again, of, counts, "named", "left").select(*names))


def to_files(rows: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write records as WARC files of at most ``per_file`` records."""
    bare = F.substring("record", F.lit(1), F.length("record") - len(END))
    rows.select(bare.alias("record")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def split(content: bytes) -> Iterator[bytes]:
    """The records of a file, by their lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        head = content[at:end].lower()
        length = head.index(b"\r\ncontent-length:") + len(b"\r\ncontent-length:")
        end += int(head[length : head.index(b"\r\n", length)]) + 4
        yield content[at:end]
        at = end


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in a folder; a file is one task's row."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                found = list(split(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r.decode("utf-8") for r in found], pa.string())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(frugal(run), "record string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(parsed(records(write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
     r AS (SELECT *, payload_bytes >= 1000 AND owner IS NOT NULL AND (page_id IS NULL OR page_id < owner) AS revisit FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN owner END AS refers_to FROM r
"""
