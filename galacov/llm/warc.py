"""WARC archives: one gzip member for each record, written as whole files, read in byte ranges.

Writing. A page's record is a `response` with the page's bytes, or a `revisit` that refers to the response with the
same payload: of equal payloads (SHA-1 and length) of at least `min_revisit` bytes the smallest page id is the response.
That id comes from an aggregation of digests that combines in the map tasks. Payloads stay where they were read as long as
the table of revisits has at most `SENT` rows; beyond that they are shuffled once, to meet it. Files are written by Spark's text writer, whose commit protocol survives lost tasks and works on any file system. It ends each
row with a separator, so a row is a member without its last byte and the separator is that byte: a member ends with the
high byte of its length, 0 below 16 MiB; a longer record gets an empty member behind it, whose last byte is 0 too.

Reading. Files are split into byte ranges, one row each, dealt out evenly. A task looks for the gzip magic in its range,
takes a candidate for a record only if it inflates to a WARC version line, follows members from there, and owns the
records that start inside its range; it reads past the range's end to finish the last one. Bytes that no record owns are
skipped: after a damaged member the search for the magic goes on.

Records that this module did not write are read too: their id is the text of WARC-Record-ID, what a header does not tell is
null, and a record without a usable length, or of another type, is passed over.

Cases: null html counts as empty, null url is written as an empty target. Null page ids are records of their own (equal
payloads without an id are responses each). Rows that repeat a page id and payload are one response and revisits of it.
Ids may be of any type that has an order and a text. An empty table gives no files and no rows. Only page id, url and html
are read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, staged, text_or_empty

#: Bytes of a range; the shortest payload that a revisit may stand for.
SPLIT, MIN_REVISIT = 8 << 20, 0
MAGIC = b"\x1f\x8b\x08"
LEVEL = 2
WINDOW = 1 << 20
#: Bytes of the longest record: what a binary value can hold.
MOST = (1 << 31) - 1024
#: Most revisits that are sent to all tasks.
SENT = 200_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, sha1: str) -> bytes:
    """One record, not compressed. A revisit has no payload; its length stands in a header."""
    if refers_to is None:
        kind, http = "response", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        extra, content = "", http + payload
    else:
        kind, content = "revisit", b"HTTP/1.1 200 OK\r\n\r\n"
        extra = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{urllib.parse.quote(str(refers_to), safe='')}>\r\n"
    name = "" if page_id is None else urllib.parse.quote(str(page_id), safe="")
    target = "".join(c for c in url if c not in "\r\n")
    head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\n"
            f"WARC-Payload-Digest: sha1:{sha1}\r\nX-Payload-Length: {len(payload)}\r\n{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(content)}\r\n\r\n")
    return head.encode("utf-8", "surrogatepass") + content + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member (with an empty one behind it, where need be) whose last byte is 0."""
    def gz(x: bytes) -> bytes:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    out = gz(data)
    return out if out[-1] == 0 else out + gz(b"")


def references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, sha1, first and again of the ids that have revisits: first is the response's id, again says that it is this id
    itself, whose other rows are revisits of one."""
    body = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n")).where((F.col("n") >= min_revisit) & F.col("id").isNotNull())
    rows = staged(rows.groupBy("id", "sha1", "n").agg(F.count("*").alias("times")), "digests")
    # A payload that stands once needs no reference.
    groups = rows.groupBy("sha1", "n").agg(F.min("id").alias("first"), F.sum("times").alias("rows")).where("rows > 1").drop("rows")
    found = rows.join(groups, ["sha1", "n"]).where((F.col("id") != F.col("first")) | (F.col("times") > 1))
    return found.select("id", "sha1", "first", (F.col("id") == F.col("first")).alias("again"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Archives of all pages as files path/part-*."""
    revisits = staged(references(pages, id_col, html_col, min_revisit).select(F.col("id").alias("rid"), F.col("sha1").alias("rsha"), "first", "again"), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text_or_empty(html_col).cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    rows = rows.join(F.broadcast(revisits) if revisits.count() <= SENT else revisits, (F.col("id") == F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")
    made = rows.where("again is null or not again").withColumn("refers_to", F.col("first"))
    if revisits.where("again").limit(1).count():
        # Rows that repeat a response: one stays the response. They are numbered where they were read, and the least task
        # that has some keeps its first, so that many of them never meet in one place.
        few = rows.where("again").withColumn("task", F.spark_partition_id())
        few = staged(few.select("id", "url", "body", "sha", "first", "task"), "repeats")
        least = few.groupBy("id", "sha").agg(F.min("task").alias("task")).select(F.col("id").alias("i"), F.col("sha").alias("s"), F.col("task").alias("least"))
        few = few.join(least, (F.col("id") == F.col("i")) & (F.col("sha") == F.col("s")))
        number = F.row_number().over(Window.partitionBy("id", "sha", "task").orderBy("url"))
        few = few.withColumn("refers_to", F.when((F.col("task") != F.col("least")) | (number > 1), F.col("first")))
        made = made.select("id", "url", "body", "refers_to").unionByName(few.select("id", "url", "body", "refers_to"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [member(record(i, u, p, r, digest(p)))[:-1] for i, u, p, r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = made.select(F.col("id").cast("string").alias("id"), "url", "body", F.col("refers_to").cast("string").alias("refers_to")).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def named(header: str) -> str | None:
    """The page id in a record id of ours, the text of another's; None if there is none."""
    text = header.strip().removeprefix("<").removesuffix(">")
    return urllib.parse.unquote(text.removeprefix("urn:page:")) or None if text.startswith("urn:page:") else text or None


def number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def parsed(data: bytes) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; None if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, size = fields.get("warc-type"), number(fields.get("content-length"))
    if size is None or size > len(rest):
        return None
    page, content = named(fields.get("warc-record-id", "")), rest[:size]
    if kind == "response":
        payload = content.partition(b"\r\n\r\n")[2]
        return page, len(payload), digest(payload), kind, None
    if kind == "revisit":
        sha1 = fields.get("warc-payload-digest", "")
        return page, number(fields.get("x-payload-length")), sha1.removeprefix("sha1:") if sha1.startswith("sha1:") else None, kind, named(fields.get("warc-refers-to", ""))
    return None


def inflate(f, at: int, end: int) -> tuple[bytes, int] | None:
    """The member that starts at byte `at`, and where it ends; None if there is no whole one."""
    d, parts, held = zlib.decompressobj(31), [], 0
    f.seek(at)
    while not d.eof:
        block = f.read(1 << 16)
        if not block:
            return None
        at += len(block)
        try:
            parts.append(d.decompress(block, MOST - held))
        except zlib.error:
            return None
        held += len(parts[-1])
        if d.unconsumed_tail:
            return None  # longer than any row can be
    return b"".join(parts), at - len(d.unused_data)


def looks_like_record(f, at: int) -> bool:
    f.seek(at)
    d = zlib.decompressobj(31)
    try:
        start = d.decompress(f.read(512), 16)
    except zlib.error:
        return False
    return start.startswith(b"WARC/1.") or (d.eof and not start)


def records_in(f, size: int, lo: int, hi: int):
    """The records of an archive of `size` bytes that start in [lo, hi)."""
    at = lo
    while at < hi:
        f.seek(at)
        window = f.read(min(WINDOW, hi + len(MAGIC) - 1 - at))
        k = window.find(MAGIC)
        if k < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += k
        while at < hi:  # members follow each other
            got = inflate(f, at, size) if looks_like_record(f, at) else None
            if got is None:
                at += 1
                break
            data, at = got
            found = parsed(data) if data else None
            if found is not None:
                yield found


def read(spark, path: str, split: int = SPLIT, id_type: str = "long") -> DataFrame:
    """page_id (null where it is not of id_type), payload_bytes, payload_digest, record_type, refers_to of all records below path."""
    def run(batches):
        from pyarrow import fs

        for b in batches:
            for name, size, lo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, inner = fs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as f:
                    rows = list(records_in(f, size, lo, min(lo + split, size)))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("lo"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.repartition(n).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    ids = {c: F.expr(f"try_cast({c} as {id_type})") for c in ("page_id", "refers_to")}
    return found.select(*[ids[c].alias(c) if c in ids else c for c in found.columns])


def round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "archives")
    write(pages, path, **how)
    return read(spark, path, id_type=pages.schema[how.get("id_col", "page_id")].dataType.simpleString())
