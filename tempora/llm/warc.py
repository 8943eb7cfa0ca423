"""WARC archives: records written in segments with chunked framing, read back and reassembled.

Writing. A page is one response record (or a revisit that refers to the response with the same payload). A payload of
more than SEGMENT bytes is cut: the first segment is the response record, the rest are continuation records with
WARC-Segment-Origin-ID and WARC-Segment-Number, the last of them with WARC-Segment-Total-Length. The HTTP body uses
chunked transfer framing. Cuts fall between characters, so every record is text and Spark's own text writer writes the
archives, on any file system, with its commit protocol: a lost task leaves nothing behind.

Reading. Archives are read whole by Spark's binary reader (the writer puts RECORDS_PER_FILE in each) and parsed by their
Content-Length alone. Continuations are grouped by origin identifier, ordered by segment number, checked against the
total length, and the chunked framing of the joined block is decoded.

Defined results: a null html is an empty payload; a null page_id counts as the smallest id and is written as such;
repeated rows are written each, and of records with the smallest page_id and an equal payload one is the response; an
empty table gives an empty result; extra columns are ignored. A record that is cut short, has no readable length, or whose
segments are missing or have the wrong length is reported in `error` with an empty payload, never dropped, and reading
goes on at the next record; a foreign record without a page id has a null one; what a damaged gzip member still gives is
read. Very long pages are segmented, so only the segments of one page ever meet in one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches

SEGMENT = 16 * 1024
CHUNK = 4 * 1024
#: An archive is read as one value. A record has at most SEGMENT bytes and its header, so one has at most about 35 MB.
RECORDS_PER_FILE = 2000
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Groups of equal payloads up to which they are broadcast rather than the pages shuffled.
BROADCAST_ROWS = 300_000
NULL_ID = -(2**63)
DATE = "2024-01-01T00:00:00Z"
ENTRY_SCHEMA = "page_id long, record_id string, origin string, segment int, total long, type string, refers long, block binary, parted boolean, length long, digest string, error string"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes that end between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _cuts(payload, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body, extensions and trailers ignored. ValueError when it is cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("Content-Length", str(len(block))), *fields]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode() + "\r\n"


def record_id(page_id: int, copy: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{copy}/{segment}')}>"


def records(page_id: int, copy: int, url: str | None, html: str | None, refers_to: int | None, segment: int = SEGMENT) -> list[str]:
    """The records of one page, without the last line end of each (the text writer adds it)."""
    payload = (html or "").encode("utf-8", "replace")
    digest = hashlib.sha256(payload).hexdigest()
    uri = re.sub(r"[\r\n\s]+", "%20", url or f"urn:page:{page_id}")
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", str(page_id))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, 0)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Payload-Length", str(len(payload)))]
        return [_record("revisit", record_id(page_id, copy), head, common + extra)]
    block = head + chunked(payload)
    parts = _cuts(block, segment)
    origin = record_id(page_id, copy)
    if len(parts) == 1:
        return [_record("response", origin, block, common)]
    out = [_record("response", origin, parts[0], [*common, ("WARC-Segment-Number", "1")])]
    for k, p in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(_record("continuation", record_id(page_id, copy, k), p, [("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k)), ("WARC-Page-ID", str(page_id)), *last]))
    return out


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """The text of all gzip members, and what is wrong with the last one read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(out), str(e)
        if not member.eof:
            return b"".join(out), "the gzip member is cut short"
        data = member.unused_data
    return b"".join(out), None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The (fields, block, error) of each record of an archive, gzip members or plain."""
    wrong = None
    if data[:2] == b"\x1f\x8b":
        data, wrong = inflate(data)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            nxt = data.find(b"WARC/1.", at)
            if data[at : nxt if nxt >= 0 else len(data)].strip():
                yield {}, b"", "no record begins here"
            if nxt < 0:
                break
            at = nxt
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, b"", "header is cut short"
            break
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        length = _number(fields, "content-length")
        if length is None:
            yield fields, b"", "the length is missing or no number"
            nxt = data.find(b"WARC/1.", end)
            if nxt < 0:
                break
            at = nxt
            continue
        block = data[end + 4 : end + 4 + length]
        yield fields, block, None if len(block) == length else "block is cut short"
        at = end + 4 + length
        while data[at : at + 2] == b"\r\n":
            at += 2
    if wrong:
        yield {}, b"", wrong


def _number(fields: dict[str, str], key: str) -> int | None:
    value = fields.get(key, "")
    if not re.fullmatch(r"-?[0-9]{1,19}", value):
        return None
    n = int(value)
    return n if -(2**63) <= n < 2**63 and (n >= 0 or key.endswith("page-id")) else None


def dedup(pages: DataFrame) -> DataFrame:
    """The pages with page_id, copy (0 for the first of repeated ids), url, html and refers_to (null for a response)."""
    from pyspark.sql import Window

    base = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    base = base.withColumn("digest", F.sha2(raw, 256)).withColumn("n", F.octet_length(raw))
    # ids and digests travel, and are combined first; the texts follow once
    keys = base.select("page_id", "digest", "n").where(F.col("n") >= REVISIT_BYTES)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("records")).where("records > 1").drop("records")
    # 72 bytes a row, counted: the pages then stay where they are
    out = base.join(F.broadcast(first) if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else first, "digest", "left")
    # repeated ids are rare: number the rows only if there are any
    if not base.groupBy("page_id").count().where("count > 1").isEmpty():
        out = out.withColumn("copy", F.row_number().over(Window.partitionBy("page_id").orderBy("digest")).cast("int") - 1)
    else:
        out = out.withColumn("copy", F.lit(0))
    revisit = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first")))
    return out.select("page_id", "copy", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write the archives of all pages to a folder."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for p, c, u, h, t in zip(pdf["page_id"], pdf["copy"], pdf["url"], pdf["html"], pdf["refers_to"]) for r in records(int(p), int(c), None if pd.isna(u) else u, h, None if pd.isna(t) else int(t), segment)]
            yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    dedup(pages).withColumn("refers_to", F.col("refers_to").cast("string")).mapInPandas(lines, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def entries(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under path, each archive parsed once. A record that is not segmented is decoded
    where it is read; without `payloads` only its length and digest leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
        for pdf in batches:
            for content in pdf["content"]:
                rows, held = [], 0
                for f, block, error in parse(bytes(content)):
                    rid, kind = f.get("warc-record-id"), f.get("warc-type")
                    parted = "warc-segment-number" in f
                    length, digest, kept = _number(f, "warc-payload-length"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, block
                    if kind == "revisit":  # its block has no payload; the header tells the payload's length and digest
                        kept = None
                    elif not parted:
                        payload, error = (b"", error) if error else _assemble([(1, None, block)], True)
                        length, digest, kept = len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None
                    rows.append((_number(f, "warc-page-id"), rid, f.get("warc-segment-origin-id", rid), _number(f, "warc-segment-number") or 1, _number(f, "warc-segment-total-length"), kind, _number(f, "warc-refers-to-page-id"), kept, parted, length, digest, error))
                    held += len(kept or b"") + 500
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=cols).astype(object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=cols).astype(object)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("content").mapInPandas(run, ENTRY_SCHEMA)


def _assemble(parts: list[tuple[int, int | None, bytes]], whole: bool) -> tuple[bytes, str | None]:
    parts = sorted(parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        return b"", "segments are missing or repeated"
    block = b"".join(p[2] for p in parts)
    total = parts[-1][1]
    if not whole and total is None:
        return b"", "the last segment is missing"
    if total is not None and total != len(block):
        return b"", "the total length differs"
    if not block.startswith(b"HTTP/"):  # a foreign record without an HTTP header is all payload
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        return (dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body), None
    except ValueError as e:
        return b"", str(e)


READ_SCHEMA = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The page of all segments of one origin."""
    head = pdf[pdf["type"] == "response"]
    first = head.iloc[0] if len(head) else pdf.iloc[0]
    parts = [(int(s), None if pd.isna(t) else int(t), bytes(b)) for s, t, b in zip(pdf["segment"], pdf["total"], pdf["block"])]
    error = next((x for x in pdf["error"] if isinstance(x, str)), None)
    payload, wrong = (b"", error) if error else _assemble(parts, False)
    page = None if pd.isna(first["page_id"]) else int(first["page_id"])
    row = (page, "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload, wrong)
    return pd.DataFrame([row], columns=[c.split()[0] for c in READ_SCHEMA.split(", ")]).astype(object)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page: page_id, record_type, refers_to, payload_bytes, payload_digest, payload, error.

    A page in one record is decoded where it is read. Only segmented records are shuffled, by origin identifier; a group
    is the segments of one page. Without `payloads` that column is null for pages in one record.
    """
    e = cut(entries(spark, path, payloads), "warc-entries")
    lone = e.where(~F.col("parted")).select("page_id", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("block").alias("payload"), "error")
    return lone.union(e.where(F.col("parted")).groupBy("origin").applyInPandas(_joined, READ_SCHEMA))


def archive(pages: DataFrame, segment: int = SEGMENT, payloads: bool = True) -> DataFrame:
    """Write the archives of pages to the shared folder, read them back, and give read()'s rows; for revisits the payload is that of the response they refer to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, segment)
    return read(spark, path, payloads)


def digest_rows(pages: DataFrame) -> DataFrame:
    """archive() without the payloads. A revisit's length and digest are checked against its response as read back."""
    small_batches(pages.sparkSession)
    rows = archive(pages, payloads=False).select(F.nullif("page_id", F.lit(NULL_ID)).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    rows = cut(rows, "warc-rows")
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).distinct()
    low = F.coalesce("refers_to", F.lit(NULL_ID))
    revisits = rows.where("record_type = 'revisit'").join(there, (low == F.coalesce("r_id", F.lit(NULL_ID))) & (F.col("payload_digest") == F.col("r_digest")), "left")
    revisits = revisits.withColumn("error", F.when(F.col("r_bytes").isNull() | (F.col("r_bytes") != F.col("payload_bytes")), "the response is missing").otherwise(F.col("error")))
    out = rows.where("record_type is null or record_type <> 'revisit'").union(revisits.select(rows.columns))
    return out.withColumn("refers_to", F.nullif("refers_to", F.lit(NULL_ID)))
