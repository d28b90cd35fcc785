"""WARC archives: written by Spark tasks, read back through an index of byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import fresh_path, table

#: End of a record.
END = "\r\n\r\n"
#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT = 100
#: Salts over which a digest's rows are spread when they look up their response.
SALTS = 16
#: Two selected records with at most this many unwanted bytes between them are read in one request.
GAP = 64 * 1024
#: A coalesced read ends beyond this size.
READ = 8 * 1024 * 1024
SHA256 = "sha256"


def decided(pages: DataFrame, ident: str, url: str, payload: Column, least: int = MIN_REVISIT) -> DataFrame:
    """One narrow row per page: _id, url, payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest id are responses, the
    others revisit it.  A null payload is empty.  A null id is never referred to: such rows are revisits
    if a row with an id has the payload, else responses.  Rows that repeat the smallest id are all
    responses.  The minimum is combined in the map tasks, and the look-up is salted, so a digest that a
    third of all pages share does not meet in one task.  Payloads do not travel here.
    """
    body = F.coalesce(payload, F.lit(""))
    rows = pages.select(
        F.col(ident).cast("long").alias("_id"), F.col(url).cast("string").alias("url"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )
    firsts = (
        rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"))
        .where("_copies > 1 and _first is not null")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = rows.withColumn("_at", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(firsts, (F.col("payload_digest") == F.col("_digest")) & (F.col("_at") == F.col("_salt")), "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return met.select(
        *rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to")
    )


def _header() -> Column:
    """The head of a WARC record, with its blank line, from the columns of :func:`decided`."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # a header value is one line
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("_id")),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit(f"{SHA256}:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn("refers_to")),
        )).otherwise(F.lit("")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )


def _opened(path: str):
    """Arrow's file system for an address, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


INDEX = "file string, offset long, length long, url string, payload_digest string, record_type string, page_id long"


def write_archives(pages: DataFrame, ident: str, url: str, payload: Column, path: str) -> DataFrame:
    """Write one record per page under ``path``/archives and the index under ``path``/index; return the index.

    Payloads are shuffled once, to meet the decision that their page is a revisit.  Every task then writes an
    archive of its own, each record a gzip member, and returns what it wrote: file, offset, length, url,
    payload_digest, record_type, page_id.  Names are unique to an attempt, and only rows of attempts that
    Spark commits reach the index, so a lost or repeated attempt leaves at most a file nobody refers to.
    """
    spark = pages.sparkSession
    key = F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("")), "payload_digest").alias("_key")
    again = decided(pages, ident, url, payload).where("record_type = 'revisit'").select(key.alias("_again"), "refers_to").distinct()
    body = F.coalesce(payload, F.lit(""))
    full = pages.select(
        F.col(ident).cast("long").alias("_id"), F.col(url).cast("string").alias("url"), body.alias("_payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    ).withColumn("_key", key)
    met = full.join(again, F.col("_key") == F.col("_again"), "left")
    met = met.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("_payload"))
    records = met.select("_id", "url", "payload_digest", "record_type", F.concat(_header(), block, F.lit(END)).alias("_record"))
    folder = f"{path}/archives"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, name = None, 0, f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        for pdf in batches:
            if out is None and len(pdf):
                system, inner = _opened(name)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(inner, compression=None)
            lengths = []
            for record in pdf["_record"]:
                member = gzip.compress(record.encode(), 6, mtime=0)
                out.write(member)
                lengths.append(len(member))
            ends = at + np.cumsum(lengths, dtype=np.int64)
            yield pd.DataFrame({
                "file": name, "offset": ends - lengths, "length": lengths, "url": pdf["url"], "payload_digest": pdf["payload_digest"],
                "record_type": pdf["record_type"], "page_id": pdf["_id"].astype("Int64"),
            })
            at = int(ends[-1]) if lengths else at
        if out is not None:
            out.close()

    records.mapInPandas(write, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _parse(member: bytes) -> tuple:
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix(f"{SHA256}:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda k: fields.get(k, "")[len("<urn:page:"):-1] or None
    return (
        number("WARC-Record-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], digest,
        int(fields["WARC-Payload-Length"]), number("WARC-Refers-To"), block,
    )


READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def read_records(selected: DataFrame) -> DataFrame:
    """Records of the selected index rows, with payloads (empty for revisits) checked against their digests.

    The rows are grouped by file and position; neighbours are merged to one byte-range request, so only
    wanted stretches are read.  ``selected`` may be any part of the index.  Requests go through Arrow's
    file systems, which read ``file:``, HDFS and object-store addresses.
    """
    stretch = F.floor(F.col("offset") / F.lit(READ))
    near = selected.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        opened: dict[str, object] = {}

        def run(name: str, rows: list[tuple[int, int]]) -> pd.DataFrame:
            if name not in opened:
                opened.clear()
                system, inner = _opened(name)
                opened[name] = system.open_input_file(inner)
            first = rows[0][0]
            raw = opened[name].read_at(rows[-1][0] + rows[-1][1] - first, first)
            out = pd.DataFrame([_parse(raw[o - first : o - first + n]) for o, n in rows], columns=columns)
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        at, rows = None, []
        for pdf in batches:
            for name, offset, length in zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist(), strict=True):
                far = rows and (name != at or offset > sum(rows[-1]) + GAP or offset + length - rows[0][0] > READ)
                if far:
                    yield run(at, rows)
                    rows = []
                at = name
                rows.append((offset, length))
        if rows:
            yield run(at, rows)

    return near.mapInPandas(fetch, READ_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; equal payloads of 100 bytes or more become revisits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    index = write_archives(pages, "page_id", "url", F.col("html"), path)
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLE = {
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
""",
}
