"""WARC archives: writing with revisit records, and splittable reading by boundary-chain verification.

Writing. Pages of equal payloads are told by digest; the one with the largest id is a response, the others are
revisit records that refer to it and carry no payload. Spark's text writer writes the records, so an archive is one
file per task (``records`` bounds its size) in whatever store the folder is in.

Reading. Files are read as byte ranges, split at blank lines (CR LF CR LF), after which alone a record can begin. A
first pass emits, for every line that looks like a record header, the offset of its successor, which the header's
Content-Length gives. Magic inside a payload gives candidates too; what tells them apart is that only true records
are reached from the start of the file. Each byte range first contracts its own chains: for every candidate, where
its chain leaves the range. Pointer jumping over those exits finds where the chain of the file start enters each
range, in a logarithmic number of joins. A second pass cuts the records out, following the chain from that entry;
records that cross into the next range are put together from their parts.

Null payloads count as empty. Null page ids give records without a number, read back as null; they are all
responses. Rows of equal ids and payloads are alike. Runs of blanks and control characters
in addresses become %20. What
follows a broken record in a file is not reached and not returned. An empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakewise.llm.common import BROADCAST_ROWS, bounded_batches, new_folder, small_or_shuffled, stored

CRLF = "\r\n"
BLANK = CRLF + CRLF
#: Records of a file at most.
RECORDS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SCAN = "file string, block long, file_size long, size long, at long, succ long, last long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
CUT = "file string, record long, at long, data binary, " + RECORD


def base32_sha1(data: Column) -> Column:
    """The base-32 digits of a SHA-1: each has 5 bits, inside two neighbouring hex digits."""
    hexed = F.sha1(data)

    def digit(i: Column) -> Column:
        two = F.substr(hexed, F.floor(i * 5 / 4).cast("int") + 1, F.lit(2))
        shifted = F.conv(two, 16, 10).cast("int") / F.pow(F.lit(2), 3 - (i * 5) % 4)
        return F.substr(F.lit(BASE32), F.floor(shifted).cast("int") % 32 + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def with_referents(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with payload_digest and refers_to: the response of a revisit, else null."""
    hashed = pages.withColumn("payload_digest", base32_sha1(F.col("payload")))
    groups = hashed.filter(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c"))
    groups = stored(groups.filter("c > 1 AND response IS NOT NULL").drop("c"), "groups")
    joined = hashed.join(small_or_shuffled(groups), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("response"), F.col("response"))).drop("response")


def record(date: str = DATE) -> Column:
    """The record of a row of ``with_referents``, up to the blank line that ends it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *fields), F.lit(BLANK), block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records: int = RECORDS, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row of ``pages`` to files in the folder ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    lines = with_referents(named, min_bytes).select(record().alias("value"))
    lines.write.option("lineSep", BLANK).option("maxRecordsPerFile", records).text(path)


def blank_split(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between blank lines with file, block (start of the byte range) and file_size, in order."""
    pieces = spark.read.option("lineSep", BLANK).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def unsplit(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``blank_split`` with each file, of ``size`` bytes at most, as one range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, size + 1)
        pieces = stored(blank_split(spark, path).withColumn("place", F.monotonically_increasing_id()), "pieces")
    finally:
        for n, value in zip(names, old, strict=True):
            spark.conf.set(n, value)
    return pieces.repartition("file", "block").sortWithinPartitions("file", "block", "place").drop("place")


def header_start(piece: bytes) -> int:
    """Where a record header starts in a piece: 0, or 2 after a payload that ends with a line break; -1 for none."""
    return 0 if piece.startswith(b"WARC/1.") else 2 if piece.startswith(b"\r\nWARC/1.") else -1


def header_fields(header: bytes) -> dict[bytes, str]:
    fields = (line.partition(b":") for line in header.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip().decode("utf-8", "replace") for name, _, value in fields}


def content_length(header: bytes) -> int | None:
    value = header_fields(header).get(b"content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


def scanned(frames):
    """For each byte range its size (at -1), and its candidates: place, where its chain leaves the range, and the last
    record of the chain inside it. Places count from the range's first piece."""
    state: dict = {"key": None}

    def closed():
        exits: dict[int, tuple[int, int]] = {}
        for at, succ in reversed(state["found"]):
            exits[at] = exits.get(succ, (succ, at))
        rows = [(*state["key"], state["size"], -1, -1, -1)] + [(*state["key"], state["size"], at, *x) for at, x in exits.items()]
        return pd.DataFrame(rows, columns=["file", "block", "file_size", "size", "at", "succ", "last"])

    for frame in frames:
        for *key, size, head in zip(*[frame[c] for c in ("file", "block", "file_size", "size", "head")], strict=True):
            if key != state["key"]:
                if state["key"]:
                    yield closed()
                state = {"key": key, "size": 0, "found": []}
            if head is not None:
                start = header_start(head)
                length = content_length(head[start:])
                if length is not None:
                    state["found"].append((state["size"] + start, state["size"] + len(head) + 4 + length + 4))
            state["size"] += size
    if state["key"]:
        yield closed()


def scan_ranges(pieces: DataFrame) -> DataFrame:
    value = F.col("value")
    looks = (F.substring(value, 1, 9) == F.lit(b"\r\nWARC/1.")) | (F.substring(value, 1, 7) == F.lit(b"WARC/1."))
    sized = pieces.select("file", "block", "file_size", (F.octet_length("value") + 4).cast("long").alias("size"), F.when(looks, value).alias("head"))
    return stored(sized.mapInPandas(scanned, SCAN), "scan")


def uneven(scan: DataFrame) -> int | None:
    """The largest file's size if the ranges of some file don't add up to it: a blank line with more line breaks
    around it, right on a range's border, can be seen twice or not at all."""
    files = scan.filter("at = -1").groupBy("file", "file_size").agg(F.sum("size").alias("size"))
    r = files.agg(F.max("file_size").alias("most"), F.bool_or(~F.col("size").isin(F.col("file_size"), F.col("file_size") + 4)).alias("bad")).first()
    return r["most"] if r["bad"] else None


def chain_entries(scan: DataFrame) -> DataFrame:
    """For each byte range: base (offset of its first piece), entry (of the first record that starts in it, or null),
    carry and carry_end (of the record before it that reaches into it, or null)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scan.filter("at = -1").select("file", "block", "size")
    ranges = stored(ranges.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))), "ranges")
    n = ranges.count()
    based = scan.filter("at >= 0").join(small_or_shuffled(ranges.select("file", "block", "base"), n), ["file", "block"])
    jumps = stored(based.select("file", "block", *[(F.col(x) + F.col("base")).alias(y) for x, y in (("at", "at"), ("succ", "to"), ("last", "last"))]), "jumps")
    reached = jumps.filter("at = 0").select("file", "at")
    starts = jumps.select("file", F.col("at").alias("to"))
    links = stored(jumps.select("file", "at", "to").join(small_or_shuffled(starts), ["file", "to"], "left_semi").select("file", "at", "to"), "links")
    while not links.isEmpty():
        onward = links.join(small_or_shuffled(reached), ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.union(onward).distinct(), "reached")
        second = links.select("file", F.col("at").alias("to"), F.col("to").alias("to2"))
        links = stored(links.join(small_or_shuffled(second), ["file", "to"]).select("file", "at", F.col("to2").alias("to")), "links")
    entries = jumps.join(small_or_shuffled(reached), ["file", "at"]).select("file", "block", F.col("at").alias("entry"), F.struct("last", "to").alias("open"))
    joined = ranges.join(small_or_shuffled(stored(entries, "entered"), n), ["file", "block"], "left").withColumn("open", F.last("open", ignorenulls=True).over(before))
    reaches = F.col("open.to") > F.col("base")
    return stored(joined.select("file", "block", "base", "entry", F.when(reaches, F.col("open.last")).alias("carry"), F.when(reaches, F.col("open.to")).alias("carry_end")), "entries")


def parsed(data: bytes, payloads: bool = True) -> tuple | None:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record's bytes."""
    header, _, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(header)
    length = content_length(header)
    if length is None or len(rest) < length:
        return None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    number = lambda value: int(value[10:-1]) if value.startswith("<urn:page:") and value[10:-1].lstrip("-").isdigit() else None
    page, url, kind = number(fields.get(b"warc-record-id", "")), fields.get(b"warc-target-uri"), fields.get(b"warc-type")
    if kind == "revisit":
        return page, url, kind, number(fields.get(b"warc-refers-to", "")), content_length(http), fields.get(b"warc-payload-digest", "").removeprefix("sha1:"), None
    return page, url, kind, None, len(payload), b32encode(hashlib.sha1(payload).digest()).decode(), payload if payloads else None


COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def typed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c in ("page_id", "refers_to", "payload_bytes", "at")})


def cutter(payloads: bool):
    """Records that lie in one byte range, parsed; parts of others as (record, at, data)."""

    def cut(frames):
        names = ["file", "record", "at", "data", *COLUMNS]
        key, base, pos, next_at = None, 0, 0, None
        open_at, open_end, parts = None, 0, []
        rows: list[tuple] = []

        def flushed(whole: bool):
            nonlocal parts
            if open_at is not None and parts:
                data = b"".join(x for _, x in parts)
                if not whole:
                    rows.append((key[0], open_at, parts[0][0], data, *[None] * 7))
                elif (fields := parsed(data, payloads)) is not None:
                    rows.append((key[0], open_at, None, None, *fields))
            parts = []

        for frame in frames:
            for file, block, *places, value in zip(*[frame[c] for c in ("file", "block", "base", "entry", "carry", "carry_end", "value")], strict=True):
                if (file, block) != key:
                    if key:
                        flushed(False)
                    base, next_at, open_at, open_end = (None if pd.isna(x) else int(x) for x in places)
                    key, pos = (file, block), base
                data = value + b"\r\n\r\n"
                head = None if next_at is None else next_at - pos
                if head is not None and head < len(data):
                    if head:
                        parts.append((pos, data[:head]))
                    flushed(open_at is not None and open_at >= base)
                    length = content_length(value[head:]) if value[head:].startswith(b"WARC/1.") else None
                    open_at, parts = (None, []) if length is None else (next_at, [(next_at, data[head:])])
                    next_at = open_end = None if length is None else next_at + len(data) - head + length + 4
                elif open_at is not None and pos < open_end:
                    parts.append((pos, data))
                pos += len(data)
            if rows:
                yield typed(rows, names)
                rows = []
        if key:
            flushed(False)
        if rows:
            yield typed(rows, names)

    return cut


def joined_parser(payloads: bool):
    def parse(frames):
        for frame in frames:
            yield typed([x for data in frame["data"] if (x := parsed(data, payloads)) is not None], COLUMNS)

    return parse


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record reached from its file's start: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (of the payload as read; of a revisit, as its header says) and payload (null for a revisit, and without ``payloads``, where only digests are wanted)."""
    bounded_batches(spark)
    pieces = blank_split(spark, path)
    scan = scan_ranges(pieces)
    if (size := uneven(scan)) is not None:
        pieces = unsplit(spark, path, size)
        scan = scan_ranges(pieces)
    entries = chain_entries(scan)
    n = entries.count()
    pieces = pieces.withColumn("place", F.monotonically_increasing_id()).join(small_or_shuffled(entries, n), ["file", "block"])
    if n > BROADCAST_ROWS:
        pieces = pieces.sortWithinPartitions("file", "block", "place")
    out = stored(pieces.select("file", "block", "base", "entry", "carry", "carry_end", "value").mapInPandas(cutter(payloads), CUT), "records")
    parts = out.filter("at IS NOT NULL").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    data = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return out.filter("at IS NULL").select(*COLUMNS).union(parts.select(data.alias("data")).mapInPandas(joined_parser(payloads), RECORD))


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``pages`` as read back from an archive in the shared folder."""
    path = new_folder(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, payloads)
