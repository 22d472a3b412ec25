"""WARC archives whose repeated payloads are revisits.

An archive is a folder of files of whole records (WARC/1.1, gzip). Every record of an
archive begins with its version line and the id of the archive's ``warcinfo`` record, which is drawn when
the archive is written; the two lines are where Spark's text reader parts records, so no
payload is scanned for marks, none can hold them, and records are checked against their Content-Length.

To resolve revisits, headers alone are dealt by payload digest; each revisit is joined with the
response that it repeats, and the deduplicated archive is written with fresh headers. Only records
that a bitmap of the revisits' ids may hold are joined for that; all others, responses for certain, are
written as they are read, so payloads are hardly shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.common import Scratch, cut, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Records of one file at most.
FILE_RECORDS = 20_000
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "<urn:uuid:"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four letters."""

    def letters(digest: Column) -> Column:
        groups = [F.conv(F.substring(digest, F.lit(1 + i), F.lit(5)), 16, 10).cast("int") for i in range(0, 40, 5)]
        return F.concat(*(F.substring(F.lit(_BASE32), F.shiftright(g, n).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for n in (15, 10, 5, 0)))

    return F.get(F.transform(F.array(F.sha1(payload)), letters), F.lit(0))


def _named_id(archive: str, name: Column) -> Column:
    """An id that the archive and the name give, written as a UUID of version 5."""
    h = F.sha1(F.concat(F.lit(archive), name))
    part = lambda at, n: F.substring(h, F.lit(at), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def _urn(c: Column) -> Column:
    return F.concat(F.lit(_URN), c, F.lit(">"))


def _plain(c: Column) -> Column:
    """A header's value: control characters, which would end it, are written as in URLs."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%00")


def _mark(archive: str) -> str:
    """What every record of the archive begins with."""
    return f"{VERSION}WARC-Warcinfo-ID: {_URN}{archive}>\r\n"


def _save(records: DataFrame, archive: str, path: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """Write records (fields, block): fields are an array of header lines; block is a string of any bytes; level is zlib's."""
    fields = F.array_join(F.concat("fields", F.array(F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))), "\r\n")
    info = records.sparkSession.range(1).select(F.array(F.lit("WARC-Type: warcinfo"), F.concat(F.lit("WARC-Record-ID: "), _urn(F.lit(archive))), F.concat(F.lit("WARC-Date: "), _now()), F.lit("Content-Type: application/warc-fields")).alias("fields"), F.lit("format: WARC File Format 1.1\r\n").alias("block"))
    every = records.select("fields", "block").unionByName(info)
    whole = every.select(F.concat(F.lit(_mark(archive)), fields, F.lit(END), F.col("block"), F.lit("\r\n")).alias("value"))
    whole.write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def write(pages: DataFrame, path: str, level: str = "DEFAULT_COMPRESSION") -> str:
    """Write a ``response`` record for each row (page_id, url, html) into a new archive in the folder path; returns the archive's id.

    The payload is the html in UTF-8; null html and urls are empty, a null page_id is left out. Repeated rows are records of their own.
    Very long pages are written whole; an empty table gives an archive of its ``warcinfo`` record. Other columns are ignored, whatever they are called.
    """
    archive = str(uuid.uuid4())
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.expr("uuid()").alias("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fields = F.array_compact(F.array(
        F.lit("WARC-Type: response"), line("WARC-Record-ID", _urn(F.col("id"))), line("WARC-Target-URI", _plain(F.col("url"))), line("WARC-Date", _now()), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
        line("X-Payload-Length", F.octet_length("html").cast("string")), line("X-Page-ID", F.col("page_id").cast("string")), F.lit("Content-Type: application/http;msgtype=response"),
    ))
    _save(own.select(fields.alias("fields"), F.concat(F.lit(_HTTP), F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END), F.col("html")).alias("block")), archive, path, level)
    return archive


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The records of an archive: type, record_id, refers_to_id, page_id, uri, date, digest, n_bytes of the payload, and payload.

    A record that isn't as long as it says, or whose payload isn't what its digest says, is an error. A revisit has no payload,
    and the digest and length of the payload that it stands for. ``warcinfo`` records are left out.
    """
    raw = spark.read.option("lineSep", _mark(archive)).text(path).where("value != ''")
    head = F.substring_index("value", END, 1)
    parted = raw.select("value", head.alias("head"), F.octet_length(F.substring_index("value", END, 2)).alias("before"), F.str_to_map(head, F.lit("\r\n"), F.lit(": ")).alias("h"))
    block = F.octet_length("value") - F.octet_length("head") - 8
    wrong = block != F.col("h")["Content-Length"].cast("bigint")
    whole = F.when(wrong, F.raise_error(F.concat(F.lit("record is cut short: "), F.col("head")))).otherwise(F.substring(F.col("value").cast("binary"), F.col("before") + 5, F.octet_length("value") - F.col("before") - 8))
    of = lambda name: F.col("h")[name]
    bare = lambda name: F.regexp_extract(of(name), "<urn:uuid:(.*)>", 1)
    found = parted.where(of("WARC-Type") != "warcinfo").select(
        of("WARC-Type").alias("type"), bare("WARC-Record-ID").alias("record_id"), bare("WARC-Refers-To").alias("refers_to_id"), of("X-Page-ID").cast("bigint").alias("page_id"), of("WARC-Target-URI").alias("uri"), of("WARC-Date").alias("date"),
        F.substring_index(of("WARC-Payload-Digest"), ":", -1).alias("digest"), of("X-Payload-Length").cast("bigint").alias("n_bytes"), F.when(of("WARC-Type") == "response", whole).alias("payload"),
    )
    bad = (F.col("type") == "response") & ((F.octet_length("payload") != F.col("n_bytes")) | (base32_sha1(F.col("payload")) != F.col("digest")))
    return found.withColumn("digest", F.when(bad, F.raise_error(F.concat(F.lit("payload is not as its digest: "), F.col("record_id")))).otherwise(F.col("digest")))


def _with_one(rows: DataFrame, key: str, ones: DataFrame) -> DataFrame:
    """rows with the columns of the one row of ones that has their key, null where there is none.

    Rows of one key are dealt to as many tasks as there are shuffle partitions; ones get a copy for each of those
    in which their key occurs.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)))
    dealt = salted.select(key, "salt").distinct().join(ones, key)
    return salted.join(dealt, [key, "salt"], "left").drop("salt")


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers (record_id, page_id, digest, n_bytes ...) with ``original``, the record id, page id and date of the response that a record repeats.

    Of records with one digest and length, of least_bytes or more, that with the largest page_id is the response (ties: the greatest record id; null ids come first);
    its original is null. Headers of one digest are counted in many tasks before they meet.
    """
    salts = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = headers.withColumn("of", F.concat_ws("/", "digest", F.col("n_bytes").cast("string")))
    top = F.max(F.struct("page_id", "record_id", "date", "uri")).alias("top")
    tops = rows.groupBy("of", F.pmod(F.xxhash64("record_id"), F.lit(salts)).alias("salt")).agg(top, F.count("*").alias("n")).groupBy("of").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1").select("of", "top")
    found = _with_one(rows, "of", tops)
    return found.withColumn("original", F.when((F.col("n_bytes") >= least_bytes) & (F.col("top.record_id") != F.col("record_id")), F.col("top"))).drop("of", "top")


def deduplicate(spark: SparkSession, path: str, archive: str, to: str, least_bytes: int = LEAST_BYTES) -> str:
    """Write the records of an archive of responses into a new one in which repeated payloads are revisits; returns its id.

    Every record gets a fresh id and date; revisits refer to the response's id, target and date.
    """
    new = str(uuid.uuid4())
    with Scratch(spark) as scratch:
        headers = scratch.cut(read(spark, path, archive).select("record_id", "page_id", "uri", "date", "digest", "n_bytes"), "headers")
        decided = scratch.cut(resolve(headers, least_bytes), "resolved")
        every = read(spark, path, archive)
        repeats = decided.where("original IS NOT NULL").select(F.xxhash64("record_id").alias("key"))
        none = F.lit(None).cast(decided.schema["original"].dataType)
        if n := repeats.count():
            held = bitmap.build(repeats, n)

            @F.pandas_udf("boolean")
            def may_repeat(keys: pd.Series) -> pd.Series:
                return pd.Series(held.member(keys.to_numpy(np.int64).view(np.uint64)))

            marked = every.withColumn("maybe", may_repeat(F.xxhash64("record_id")))
            joined = marked.where("maybe").drop("maybe").join(decided.select("record_id", "original"), "record_id")
            own = marked.where("NOT maybe").drop("maybe").withColumn("original", none).unionByName(joined)
        else:
            own = every.withColumn("original", none)
        revisit = F.col("original").isNotNull()
        line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
        fields = F.array_compact(F.array(
            F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"), line("WARC-Record-ID", _urn(_named_id(new, F.col("record_id")))), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", _now()),
            F.when(revisit, line("WARC-Refers-To", _urn(_named_id(new, F.col("original.record_id"))))), F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("original.uri"))), F.when(revisit, line("WARC-Refers-To-Date", F.col("original.date"))), F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("n_bytes").cast("string")), line("X-Page-ID", F.col("page_id").cast("string")), F.lit("Content-Type: application/http;msgtype=response"),
        ))
        block = F.concat(F.lit(_HTTP), F.lit("\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END), F.when(revisit, "").otherwise(F.col("payload").cast("string")))
        _save(own.select(fields.alias("fields"), block.alias("block")), new, to)
    return new


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) of what read returns.

    Every revisit is joined with its response by its id; a revisit whose response isn't there refers to null.
    """
    own = records.select("type", "record_id", F.when(F.col("type") == "revisit", F.col("refers_to_id")).alias("refers_to_id"), "page_id", "digest", "n_bytes")
    responses = own.where("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = _with_one(own.where("type = 'revisit'"), "refers_to_id", responses)
    both = revisits.unionByName(own.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint")))
    return both.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages, deduplicate the archive and return what it says when it is read back; both archives are scratch files and are deleted."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        archive = write(pages, f"{base}/all", "BEST_SPEED")
        new = deduplicate(spark, f"{base}/all", archive, f"{base}/once", least_bytes)
        headers = cut(read(spark, f"{base}/once", new).drop("payload"), "warc-headers")
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return resolved(headers)


#: The records in DuckDB, for unlike page ids.
RECORDS_SQL = f"""
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM page
"""
