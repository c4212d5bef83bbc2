"""WARC archives: one gzip member per record, written by tasks and read back by a splittable reader.

Writing: equal payloads are found by their SHA-1 and length. The record of the smallest page_id (then url) is a ``response``
with the payload, the others are ``revisit`` records that name it and hold its HTTP header alone. Only keys and digests are
aggregated; a page's text is shuffled once, to the task that writes its record, by a key in which copies of one row differ
by their input partition, so no payload, id or row is hot. A task writes one file through Spark's text sink: its
"lines" are blocks of members and the "line separator" is an empty gzip member, so a file is an ordinary multi-member gzip
file in whatever store Spark can write to.

Reading: Spark's text source with the gzip magic as record delimiter is the byte-range scanner. A task gets the
pieces that follow the magics starting inside its range (the last one reaches over the border), and a member that starts
inside its range is its own. A piece is a candidate: it is taken as a member only if its gzip header is legal and its inflated
bytes begin with ``WARC/``; while a member isn't finished (its CRC and length seen), further magics belong to it. A magic beyond a
range's end may lie inside the range's last member. The files in which that happens are found by a first pass and read in
sequence instead, by one task each with one piece at a time in memory, so whole archives inside records, records longer than a
range and magics at borders give the same rows as reading from the start.

Names that end in a suffix which Hadoop decompresses itself (``.gz``) can't be split by Spark: archives are stored without it.

Defined results: null html is an empty payload, and empty payloads are equal; a null page_id comes after all others in the choice of the
response; of equal rows one is the response; a null url gives no WARC-Target-URI; further columns are ignored; an empty table
gives an empty archive and no rows. A member that is cut off or damaged gives a row with ``error`` and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import small_batches

# The gzip format and the record fields of WARC 1.1.
MAGIC = b"\x1f\x8b\x08"
LATIN = "ISO-8859-1"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

DATE = "1970-01-01T00:00:00Z"
BLOCK_BYTES = 1 << 20
EMIT_BYTES = 8 << 20
EMIT_ROWS = 1000

RECORDS = ("file string, record_id string, type string, date string, target_uri string, payload_digest string, refers_to string, "
           "http_length bigint, payload binary, payload_sha1 string, error string")
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
_TYPES = [pa.int64() if c.endswith("bigint") else pa.binary() if c.endswith("binary") else pa.string() for c in RECORDS.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _field(value: str) -> str:
    """A header value on one line; only what would end the line or get lost at its ends is escaped."""
    for c in "\r\n\0":
        value = value.replace(c, f"%{ord(c):02X}")
    return "".join(f"%{ord(c):02X}" if c in " \t" else c for c in value) if value != value.strip() else value


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to=None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    block = http if revisit else http + payload
    fields += [("Content-Type", HTTP), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def _write(date: str):
    def run(batches):
        written, block, size = set(), [], 0
        for batch in batches:
            cols = [batch[c] for c in ("page_id", "url", "payload", "digest", "pid", "twin", "first", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, pid, twin, first, refers_to = (c[i].as_py() for c in cols)
                revisit = bool(twin)
                if first:  # rows of this key are copies of one row, all in this task: the first of them is the response
                    key = (page_id, url, digest, pid)
                    revisit = key in written
                    written.add(key)
                block.append(_member(record(page_id, url, payload, base64.b32encode(digest).decode(), revisit, refers_to, date)))
                size += len(block[-1])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], ["block"])
                    block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], ["block"])
    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` below ``path``, one archive file per task. Payloads of fewer
    than ``least_bytes`` bytes are always whole."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                                       payload.alias("payload"), F.spark_partition_id().alias("pid"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    keys = rows.filter(F.col("n") >= least_bytes).groupBy("page_id", "url", "digest", "n", "pid").agg(F.count(F.lit(1)).alias("c"))
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "pid")
    shared = keys.groupBy("digest", "n").agg(F.sum("c").alias("c"), F.min(order).alias("least")).filter("c > 1")
    is_first = (F.col("page_id").eqNullSafe(F.col("least.page_id")) & F.col("url").eqNullSafe(F.col("least.url"))
                & (F.col("pid") == F.col("least.pid")))
    twins = keys.join(shared.drop("c"), ["digest", "n"]).select(
        F.col("page_id").alias("t_page"), F.col("url").alias("t_url"), F.col("digest").alias("t_digest"), F.col("pid").alias("t_pid"),
        F.lit(True).alias("twin"), is_first.alias("first"), F.col("least.page_id").alias("refers_to"))
    same = (rows["page_id"].eqNullSafe(twins["t_page"]) & rows["url"].eqNullSafe(twins["t_url"])
            & (rows["digest"] == twins["t_digest"]) & (rows["pid"] == twins["t_pid"]))
    typed = rows.join(twins.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", "digest", "pid", "twin", "first", "refers_to")
    blocks = typed.mapInArrow(_write(date), "block binary")
    (blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", _member(b"").decode("latin-1"))
     .option("encoding", LATIN).text(path))


class Member:
    """A gzip member being read, piece by piece."""

    def __init__(self):
        self.z, self.out = zlib.decompressobj(31), []

    @staticmethod
    def starts(piece: bytes) -> bool:
        """True if what follows a magic has a legal gzip header and inflates to the beginning of a WARC record."""
        if not piece or piece[0] & 0xE0:
            return False
        try:
            return zlib.decompressobj(31).decompress(MAGIC + piece[:1 << 16], 5) == b"WARC/"
        except zlib.error:
            return False

    def feed(self, data: bytes) -> bool:
        """True once the member is finished; its CRC and length are checked then."""
        self.out.append(self.z.decompress(data))
        return self.z.eof

    def data(self) -> bytes:
        return b"".join(self.out)


def _members(pieces, in_sequence: bool):
    """``(file, block, data, error)`` of each member of ``pieces``, the rows ``(file, block, value)`` in order; data is None, and so
    is the error, where a range ends inside a member."""
    member = where = None
    for file, block, value in pieces:
        key = file if in_sequence else (file, block)
        if key != where:
            if member is not None:
                yield last[0], last[1], None, "cut off" if in_sequence else None
            member, where = None, key
            if block == 0:
                continue  # what stands before the file's first magic
        last = (file, block)
        if member is not None:
            try:
                done = member.feed(MAGIC + value)
            except zlib.error as e:
                yield file, block, None, str(e)
                member = None
        if member is None:
            if not Member.starts(value):
                continue
            member = Member()
            try:
                done = member.feed(MAGIC + value)
            except zlib.error as e:
                yield file, block, None, str(e)
                member = None
                continue
        if done:
            yield file, block, member.data(), None
            member = None
    if member is not None:
        yield last[0], last[1], None, "cut off" if in_sequence else None


def _pieces(batches):
    for batch in batches:
        yield from zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist())


def _unfinished(batches):
    """Files in which a member reaches over its range and isn't finished by the range's last piece."""
    found = {file for file, _, data, error in _members(_pieces(batches), False) if data is None and error is None}
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["file"])


def parse(data: bytes) -> dict:
    """Fields, payload and its digest of one record; the payload of an HTTP response is what follows its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    block = rest[:int(fields.get("content-length", 0))]
    out = {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"),
           "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to")}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length" and v.strip().isdigit():
                out["http_length"] = int(v)
    if out["type"] != "revisit":
        out |= {"payload": payload, "payload_sha1": base32_sha1(payload)}
    return out


def _read(in_sequence: bool):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)

    def run(batches):
        rows, size = [], 0
        for file, _, data, error in _members(_pieces(batches), in_sequence):
            if data is None and error is None:
                continue  # this file is read in sequence
            rows.append({"file": file, "error": error} | (parse(data) if data is not None else {}))
            size += len(data or b"")
            if len(rows) >= EMIT_ROWS or size >= EMIT_BYTES:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)
    return run


def read_warc(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records of the archives at ``paths``, see ``RECORDS``: payload and its base32 SHA-1 are null for revisits."""
    pieces = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", LATIN).text([paths] if isinstance(paths, str) else list(paths))
    pieces = small_batches(pieces).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                          F.col("value").cast("binary").alias("value"))
    # Names of files, which the driver lists anyway.
    whole = [r["file"] for r in pieces.mapInArrow(_unfinished, "file string").distinct().collect()]
    if not whole:
        return pieces.mapInArrow(_read(False), RECORDS)
    in_order = (pieces.filter(F.col("file").isin(whole)).withColumn("seq", F.monotonically_increasing_id())
                .repartition("file").sortWithinPartitions("file", "block", "seq").drop("seq"))
    return pieces.filter(~F.col("file").isin(whole)).mapInArrow(_read(False), RECORDS).unionByName(in_order.mapInArrow(_read(True), RECORDS))


def page_records(records: DataFrame) -> DataFrame:
    """Records that ``write_warc`` wrote, per page: ids as numbers, the full payload's length and digest of responses and revisits alike."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    ok = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error"))).when(
        F.concat(F.lit("sha1:"), "payload_sha1") != F.col("payload_digest"), F.raise_error(F.lit("a payload isn't that of its digest")))
    digest = F.coalesce(ok.cast("string"), "payload_sha1", F.regexp_replace("payload_digest", "^sha1:", ""))
    refers_to = F.when(F.col("type") == "revisit", number("refers_to"))
    return records.select(number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("bigint"), "http_length").alias("payload_bytes"),
                          digest.alias("payload_digest"), F.col("type").alias("record_type"), refers_to.alias("refers_to"))
