"""Legacy web archives (ARC) to WARC: reader, converter, and both formats' writers and readers as Spark jobs.

An ARC record is a line of fields, which the archive's version fixes, and as many bytes as the line declares; records
are found by these lengths alone, whatever the bytes look like. The converter synthesises what WARC wants and ARC
lacks: identifiers, dates, types, digests. Of records with equal payloads one stays a response, the others become
revisits of it.

Archives are written by Spark's text writer and read as binary files, so they lie in whatever store the folder is in,
and a lost task's half-written file is never seen. A task holds one archive, packed; records are streamed from it.
"""

from __future__ import annotations

import functools
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.llm.common import durable, lean, shared_dir, small, table

#: The fields of a record's line in each version of ARC.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed value: what a revisit of an equal payload names as its profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for an address that is null or empty.
NO_URL = "urn:nil"
#: Bytes of records that go from Python to Spark at a time.
BATCH_BYTES = 4 << 20
#: Two characters of base32 for each number of ten bits.
_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def base32_sha1(data: bytes, more: bytes = b"") -> str:
    """SHA-1 of data followed by more, in base32; a plain lookup, as base64's own encoder takes longer than the hash of a short page."""
    hashed = hashlib.sha1(data)
    if more:
        hashed.update(more)
    number = int.from_bytes(hashed.digest())
    return "".join([_PAIRS[number >> k & 1023] for k in range(150, -1, -10)])


@functools.lru_cache(4096)
def iso_date(said: str) -> str | None:
    """The 14 digits of an archive's date (or the first 8, 10 or 12) as WARC writes dates; None if they are no date."""
    if not re.fullmatch(r"[0-9]{8}([0-9]{2}){0,3}", said):
        return None
    said = said.ljust(14, "0")
    try:
        return datetime(int(said[:4]), *(int(said[k : k + 2]) for k in range(4, 14, 2))).isoformat() + "Z"
    except ValueError:
        return None


def split_head(block: bytes) -> int:
    """Where the payload begins: after the blank line of an HTTP response's head, 0 if the block is none."""
    if not block.startswith(b"HTTP/"):
        return 0
    long = block.find(b"\r\n\r\n")
    # a shorter blank line counts only before the other: the payload behind it is not searched
    short = block.find(b"\n\n", 0, len(block) if long < 0 else long + 4)
    return short + 2 if short >= 0 else long + 4 if long >= 0 else len(block)


def _opened(content: bytes) -> io.BufferedIOBase:
    """The bytes of an archive, unpacked as they are read; of one packed whole or record by record."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 17) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _line(file: io.BufferedIOBase) -> bytes | None:
    """The next line that is not blank, None at the end."""
    while line := file.readline():
        if line.strip(b"\r\n"):
            return line.rstrip(b"\r\n")
    return None


def arc_records(content: bytes, name: str = "") -> Iterator[dict]:
    """The records of an ARC archive in order, the version block first. A last record that ends too soon is truncated; a line that does not fit the version fails, with its place."""
    file, version, begun, at = _opened(content), None, None, 0
    while (line := _line(file)) is not None:
        said = line.decode("utf-8", "surrogateescape").split(" ")
        if version is None and not line.startswith(b"filedesc://"):
            raise ValueError(f"{name}: an archive begins with filedesc://, not {line[:40]!r}")
        length = int(said[-1]) if said[-1].isascii() and said[-1].isdigit() else None
        if length is None or (version and len(said) != len(FIELDS[version])):
            raise ValueError(f"{name}: record {at} has a line that is not of version {version}: {line[:200]!r}")
        block = file.read(length)
        if version is None:
            words = block.split(b" ", 1)[0]
            version = int(words) if words in (b"1", b"2") else None
            if version is None:
                raise ValueError(f"{name}: neither version 1 nor 2 of ARC")
            begun = iso_date(said[2])
            fields = dict(zip(FIELDS[version], said)) if len(said) == len(FIELDS[version]) else dict(zip(FIELDS[1], said[:4]))
        else:
            fields = dict(zip(FIELDS[version], said))
        head = split_head(block)
        status = re.match(rb"HTTP/\S+ +(\d{3})", block)
        code = fields.get("Result-code", "")
        yield {
            "position": at,
            "version": version,
            "url": fields["URL"],
            "ip": fields["IP-address"],
            "date": iso_date(fields["Archive-date"]) or begun or "1970-01-01T00:00:00Z",
            "content_type": fields.get("Content-type", ""),
            "status": int(status[1]) if status else int(code) if code.isascii() and code.isdigit() else None,
            "truncated": len(block) < length,
            "head": block[:head],
            "payload": block[head:],
            "payload_digest": base32_sha1(block[head:]),
            "block_digest": base32_sha1(block),
            "head_digest": base32_sha1(block[:head]),
        }
        at += 1


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows as record batches of about BATCH_BYTES; a longer row is a batch of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each_file(spark: SparkSession, folder: str, parse, schema: pa.Schema, kind: str) -> DataFrame:
    """Rows of parse(content, path) for each file of a folder, with the file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path = path.as_py()
                yield from _in_batches(({"path": path} | row for row in parse(content.as_py(), path)), schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(lean(run), kind)


_ARC_SCHEMA = pa.schema(
    [("path", pa.string()), ("position", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("status", pa.int32())]
    + [("truncated", pa.bool_()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string())]
)
_ARC_KIND = "path string, position long, version int, url string, ip string, date string, content_type string, status int, truncated boolean, head binary, payload binary, payload_digest string, block_digest string, head_digest string"


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ARC archives of a folder: path and position, the line's fields, head and payload, digests (bare base32 SHA-1)."""

    def parse(content: bytes, path: str) -> Iterator[dict]:
        for row in arc_records(content, path):
            yield row | {k: row[k].encode("utf-8", "surrogateescape").decode("utf-8", "replace") for k in ("url", "ip", "content_type")}

    return _each_file(spark, folder, parse, _ARC_SCHEMA, _ARC_KIND)


def _write_blocks(blocks: DataFrame, folder: str) -> None:
    """Writes rows of one binary column, each followed by a line feed, in order, a packed file for each partition."""
    blocks.select(F.col(blocks.columns[0]).cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def write_arc(pages: DataFrame, id_: str, url: str, html: str, folder: str, version: int | None = None, date: str = "20000101000000") -> None:
    """Writes pages as ARC archives, one for each partition of pages that has rows; version: 1 or 2, None for both by turns.

    A page is an HTTP response whose head tells its id; a null text is an empty payload, a null id is left out of the
    head. Spaces and control characters of an address are percent-encoded; a null or empty address is urn:nil.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        kind = version or number % 2 + 1
        name = f"pages-{number:06d}.arc"
        offset = 0

        def block(line: list[str], data: bytes) -> dict:
            nonlocal offset
            fields = " ".join([*line, str(len(data))]).encode()
            offset += len(fields) + len(data) + 2
            return {"block": fields + b"\n" + data}

        def rows() -> Iterator[dict]:
            for batch in batches:
                for key, address, text in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html"))):
                    if not offset:
                        about = f"{kind} 0 parcelmint\n{' '.join(FIELDS[kind])}\n".encode()
                        yield block([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *([] if kind == 1 else ["200", "-", "-", "0", name])], about)
                    payload = (text or "").encode()
                    told = f"Page-Id: {key}\r\n" if key is not None else ""
                    data = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{told}\r\n".encode() + payload
                    address = re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), address or NO_URL)
                    yield block([address, "0.0.0.0", date, "text/html", *([] if kind == 1 else ["200", base32_sha1(data), "-", str(offset), name])], data)

        yield from _in_batches(rows(), pa.schema([("block", pa.binary())]))

    rows = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    _write_blocks(rows.mapInArrow(lean(run), "block binary"), folder)


def _record_id(*cols: str) -> Column:
    """A name-based identifier (of version 5's form) of a record's place and contents: converting again gives the same."""
    h = F.sha1(F.concat_ws("\n", *cols))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.lit("urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12))


def convert(records: DataFrame, keep: Column, least_bytes: int = 0) -> DataFrame:
    """WARC records of ARC records (as of read_arc): one for each, with its header's fields and its block.

    HTTP responses become response records, version blocks warcinfo records, all else resource records. Of responses
    with equal payloads of at least least_bytes, the one for which `keep` (an expression of the records' columns) is
    largest, null the least, stays a response, ties to the last in the archives; the others revisit it and keep their
    heads only. Empty input gives no rows.
    """
    response = F.length("head") > 0
    told = records.withColumn("record_id", _record_id("path", "position", "url", "date", "block_digest")).withColumn("payload_bytes", F.length("payload").cast("long"))
    told = told.withColumn("kind", F.when(F.startswith("url", F.lit("filedesc://")), "warcinfo").when(response, "response").otherwise("resource"))
    # only names and numbers are compared and joined; payloads follow at the end
    facts = told.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).select("path", "position", "payload_digest", "payload_bytes", "record_id", "url", "date", keep.alias("keep"))
    facts = durable(facts)
    first = facts.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("keep", "path", "position", "record_id", "url", "date")).alias("first"))
    first = first.where("copies > 1").select("payload_digest", "payload_bytes", "first")
    revisits = facts.join(first, ["payload_digest", "payload_bytes"]).where("record_id <> first.record_id")
    revisits = revisits.select("path", "position", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_to_uri"), F.col("first.date").alias("refers_to_date"))
    # few revisits are sent to where the records are read; many are dealt out by place, with the payloads
    out = told.join(small(durable(revisits)), ["path", "position"], "left")
    again = F.col("refers_to").isNotNull()
    info = F.concat(F.lit("software: parcelmint\r\nformat: WARC File Format 1.1\r\nconverted-from: "), F.substring("url", F.lit(12), F.length("url")), F.lit("\r\n")).cast("binary")
    block = F.when(F.col("kind") == "warcinfo", info).when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    return out.select(
        "path", "position", F.when(again, "revisit").otherwise(F.col("kind")).alias("type"), "record_id", "date", "url", "ip", "content_type", "truncated", "refers_to", "refers_to_uri", "refers_to_date", "payload_digest",
        F.when(again, F.col("head_digest")).when(F.col("kind") == "warcinfo", F.lit(None)).otherwise(F.col("block_digest")).alias("block_digest"), block.alias("block"),
    )


def warc_bytes(records: DataFrame) -> Column:
    """The bytes of a WARC/1.1 record of convert()'s columns, but for the line feed that ends it."""
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    kind, info = F.col("type"), F.col("type") == "warcinfo"
    http = kind.isin("response", "revisit")
    declared = F.when(F.rlike("content_type", F.lit(r"^[^\s/]+/[^\s/]+$")), F.col("content_type"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", angled("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.when(~info, F.col("url"))),
        field("WARC-Filename", F.when(info, F.substring("url", F.lit(12), F.length("url")))),
        field("WARC-IP-Address", F.when(~info & F.rlike("ip", F.lit(r"^[0-9.]+$|:")) & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        field("WARC-Refers-To", angled("refers_to")),
        field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        field("WARC-Refers-To-Date", F.col("refers_to_date")),
        field("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        field("WARC-Truncated", F.when(F.col("truncated"), F.lit("unspecified"))),
        field("WARC-Identified-Payload-Type", F.when(http, declared)),
        field("WARC-Payload-Digest", F.when(http, F.concat(F.lit("sha1:"), "payload_digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest")),
        field("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).when(info, F.lit("application/warc-fields")).otherwise(F.coalesce(declared, F.lit("application/octet-stream")))),
        field("Content-Length", F.length("block").cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(header.cast("binary"), F.col("block"), F.lit("\r\n\r").cast("binary"))


def write_warc(records: DataFrame, folder: str) -> None:
    """Writes records (of convert()) as packed WARC archives; in each, records are in the order of the archives they come from, its warcinfo record before those of its archive."""
    ordered = records.sortWithinPartitions("path", "position")
    _write_blocks(ordered.select(warc_bytes(ordered).alias("block")), folder)


def warc_records(content: bytes, name: str = "") -> Iterator[dict]:
    """The records of a WARC archive in order: header's fields by lower-case name, head and payload of the block; what is no record, or ends too soon, fails with its place."""
    file, at = _opened(content), 0
    while (line := _line(file)) is not None:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: record {at} begins with {line[:40]!r}")
        fields, last = {}, None
        while (line := file.readline().rstrip(b"\r\n")) != b"":
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            last, _, value = line.decode("utf-8", "replace").partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) < length:
            raise ValueError(f"{name}: record {at} ends too soon")
        head = split_head(block)
        yield {"position": at, "fields": fields, "head": block[:head], "payload": block[head:]}
        at += 1


_WARC_SCHEMA = pa.schema([("path", pa.string()), ("position", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "date", "url", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("head", pa.binary()), ("payload", pa.binary())])
_WARC_KIND = "path string, position long, type string, record_id string, date string, url string, refers_to string, payload_digest string, payload_bytes long, intact boolean, head binary, payload binary"


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC archives of a folder; intact: whether block and payload have the digests that the header declares. payloads: False leaves them null (revisits have none)."""

    def parse(content: bytes, path: str) -> Iterator[dict]:
        for row in warc_records(content, path):
            said, kind = row["fields"], row["fields"].get("warc-type")
            payload = None if kind == "revisit" else row["payload"]
            digest = (said.get("warc-payload-digest") or "").removeprefix("sha1:") or None
            block = (said.get("warc-block-digest") or "").removeprefix("sha1:") or None
            intact = (digest is None or payload is None or base32_sha1(payload) == digest) and (block is None or base32_sha1(row["head"], row["payload"]) == block)
            named = {k: (said.get(f"warc-{v}") or "").strip("<>") or None for k, v in (("record_id", "record-id"), ("refers_to", "refers-to"))}
            yield {
                "position": row["position"], "type": kind, "date": said.get("warc-date"), "url": said.get("warc-target-uri"), "payload_digest": digest, "head": row["head"],
                "payload_bytes": None if payload is None else len(payload), "intact": intact, "payload": payload if payloads else None, **named,
            }

    return _each_file(spark, folder, parse, _WARC_SCHEMA, _WARC_KIND)


def page_id(head: Column) -> Column:
    """The id that a head tells, null if it tells none."""
    return F.nullif(F.regexp_extract(head.cast("string"), r"\r\nPage-Id: (-?\d+)\r\n", 1), F.lit("")).cast("long")


def through_archives(pages: DataFrame, id_: str, url: str, html: str, folder: str, version: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, intact) for each page, as read from the WARC archives that its ARC archives are converted to.

    Null ids, urls and texts, empty texts, repeated rows and ids are all pages of their own; of rows with equal ids and
    texts one is the response. A null id is smaller than all others. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    write_arc(pages, id_, url, html, f"{folder}/arc", version)
    write_warc(convert(read_arc(spark, f"{folder}/arc"), page_id(F.col("head"))), f"{folder}/warc")
    found = read_warc(spark, f"{folder}/warc", payloads=False).where(F.col("type").isin("response", "revisit"))
    found = durable(found.withColumn("page_id", page_id(F.col("head"))).drop("head", "payload"))
    # a response joins by its own identifier, so that no key stands for all of them
    key = F.coalesce("refers_to", "record_id")
    revisited = found.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    first = found.where("type = 'response'").join(revisited, "record_id", "left_semi").select(F.col("record_id").alias("key"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("first_bytes"))
    out = found.withColumn("key", key).join(first, "key", "left")
    again, address = F.col("type") == "revisit", F.when(F.col("url") != NO_URL, F.col("url"))
    return out.select(
        "page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), address.alias("target_uri"), "intact"
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/parcelmint/{uuid.uuid4().hex}"
    return through_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder).drop("target_uri")
