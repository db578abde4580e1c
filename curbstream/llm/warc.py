"""A content-addressed web archive: payloads once by digest, record headers apart, records put together by joins.

``write`` makes two tables in a folder. ``payloads`` holds the bytes of each distinct payload under its SHA-256 (its
address). ``headers`` holds one row a record with the exact bytes in front of the payload: WARC header, and the HTTP
header that was captured with it. ``read`` joins them again, recomputes each payload's SHA-256 and SHA-1 and stops
where bytes and address differ. ``parse`` reads the fields back out of a record's bytes.

Of records with equal payloads of at least ``least_bytes`` bytes one is the ``response``, the others are ``revisit``
records that name it and carry no payload of their own. The response is the row with the smallest page id (null ids
last; among repeated rows any one, the same in later reads). A null payload is empty.

A payload shared by very many records is no hot key: rows that look an address up are dealt over as many copies of its
entry as its number of records asks for. Nulls: url and page id are left out of the header. Empty tables give empty
archives. Other columns of the pages are ignored.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.llm.common import stage
from curbstream.session import staging_root

#: Records that one copy of a shared entry serves.
SHARE = 2048
#: Addresses with more than this share of all records are looked up without a shuffle; there are fewer than its inverse.
HEAVY = 1 / 512
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def base32(digest: Column) -> Column:
    """RFC 4648 base32 of a hexadecimal column whose length is a multiple of 10."""
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line ends inside the value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(EOL)), F.lit(""))


def record_id(page_id: Column, row: Column) -> Column:
    """A URN made from the page id and the row, so that a rewritten archive has the same ids."""
    h = F.md5(F.encode(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), row.cast("string")), "utf-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("row"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("Page-ID", F.col("page_id")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), F.col("first_row")))), _line("Refers-To-Page-ID", F.when(revisit, F.col("first_id"))),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"), _line("Content-Length", F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))), F.lit(EOL), http,
    )
    return F.encode(head, "utf-8")


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = DATE, page_id: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Writes the archive of all rows and gives back its folder (a new one in the shared folder where none is given)."""
    spark = pages.sparkSession
    folder = folder or os.path.join(staging_root(spark), "curbstream", f"warc-{uuid.uuid4().hex}")
    body = pages[payload] if dict(pages.dtypes)[payload] == "binary" else F.encode(pages[payload].cast("string"), "utf-8")
    raw = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(body, F.lit(b"")).alias("payload")).withColumn("address", F.sha2("payload", 256))
    rows = stage(
        raw.select("page_id", "url", "address", base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("size"), F.monotonically_increasing_id().alias("row")), "warc_rows",
    )
    # The first record of each address; a collision of addresses would show in sizes or the second digest.
    rank = F.struct(F.col("page_id").isNull(), "page_id", "row")
    first = rows.groupBy("address").agg(F.min(rank).alias("f"), F.count("*").alias("copies"), F.min("size").alias("size"), F.max("size").alias("size2"), F.min("sha1").alias("sha1"), F.max("sha1").alias("sha2"))
    same = F.assert_true((F.col("size") == F.col("size2")) & (F.col("sha1") == F.col("sha2")), F.concat(F.lit("two payloads at address "), F.col("address")))
    first = stage(first.where(same.isNull()).select("address", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row"), "copies", "size"), "warc_first")
    once = raw.groupBy("address").agg(F.any_value("payload").alias("payload"))
    once.join(first.select("address", "copies"), "address").write.parquet(os.path.join(folder, "payloads"))
    # Fewer than 1 / HEAVY addresses can have more than that share of the rows: a list of bounded size.
    many = F.col("copies") > F.lit(HEAVY) * F.lit(float(rows.count()))
    look = first.select("address", "first_id", "first_row", "copies")
    heavy = look.where(many & (F.col("copies") > 1))
    found = rows.join(F.broadcast(heavy), "address")
    rest = rows.join(F.broadcast(heavy.select("address")), "address", "left_anti").join(look.where(~(many & (F.col("copies") > 1))), "address")
    found = found.unionByName(rest).withColumn("record_type", F.when((F.col("row") == F.col("first_row")) | (F.col("size") < least_bytes), "response").otherwise("revisit"))
    found.select("address", "copies", F.col("row").alias("record_no"), _header(date).alias("header")).write.parquet(os.path.join(folder, "headers"))
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: ``record_no, header, payload`` (whole, also of revisits) and ``record``, its exact bytes in the archive."""
    salts = F.ceil(F.col("copies") / SHARE).cast("int")
    bodies = spark.read.parquet(os.path.join(folder, "payloads")).select("address", "payload", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    right = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.concat(F.lit("damaged payload at address "), F.col("address")))
    bodies = bodies.where(right.isNull())
    heads = spark.read.parquet(os.path.join(folder, "headers"))
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("record_no"), salts).cast("int")).drop("copies")
    own = F.contains(F.decode("header", "utf-8"), F.lit(f"{EOL}WARC-Type: response{EOL}")) | F.startswith(F.decode("header", "utf-8"), F.lit(f"WARC/1.1{EOL}WARC-Type: response{EOL}"))
    return heads.join(bodies, ["address", "salt"]).select("record_no", "header", "payload", F.concat("header", F.when(own, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """Adds the fields of each record's header and checks its length and payload digest.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes``; a record whose length or digest does not hold stops the read.
    """
    lines = F.split(F.element_at(F.split(F.decode("header", "utf-8"), EOL + EOL), 1), EOL)
    fields = F.map_from_entries(F.transform(F.slice(lines, 2, F.size(lines) - 1), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substr(x, F.instr(x, ": ") + 2).alias("v"))))
    d = records.withColumn("_f", fields)
    kind, digest = F.col("_f")["WARC-Type"], F.col("_f")["WARC-Payload-Digest"]
    start = F.octet_length(F.element_at(F.split(F.decode("header", "utf-8"), EOL + EOL), 1)) + 4
    whole = F.octet_length("record") - start - 4 == F.col("_f")["Content-Length"].cast("bigint")
    sound = F.assert_true(whole & (digest == F.concat(F.lit("sha1:"), base32(F.sha1("payload")))), F.concat(F.lit("damaged record "), F.col("record_no").cast("string")))
    return d.where(sound.isNull()).select(
        *records.columns, F.col("_f")["Page-ID"].cast("bigint").alias("page_id"), F.col("_f")["WARC-Target-URI"].alias("url"), kind.alias("record_type"), F.col("_f")["Refers-To-Page-ID"].cast("bigint").alias("refers_to"),
        F.substring_index(digest, ":", -1).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p
)
SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) % 32 + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
