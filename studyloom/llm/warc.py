"""WARC archives: a writer that turns repeated payloads into revisit records, and a reader that salvages damaged ones.

An archive is a row (archive, content) of a table in the shared folder; content is a .warc.gz of a few MB, a gzip
member for each record. The reader takes any such frame, also spark.read.format("binaryFile") renamed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 4_000_000
VERSION = b"WARC/1.1\r\n"
STEP = 1 << 16
MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
PAGE = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit has no block; its headers keep the digest and length of the payload."""
    block = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>",
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(block)),
    }
    if revisit:
        head["WARC-Refers-To"] = f"<{PAGE}{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> the archives' table (archive, content), written to the shared folder.

    Of equal payloads of LEAST_REVISIT bytes or more the one with the largest page_id is the response (each row of it, if rows
    repeat), the others revisit it; a null page_id is smaller than any, and alone it makes responses. Null html: an empty payload.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.length(body).alias("bytes"))
    again = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("chief"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = rows.join(settle(again), "digest", "left").withColumn("revisit", F.coalesce(F.col("chief").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chief")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()[:16]]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8")
                held.append(_gzip(record(row["page_id"], row["url"], payload, row["digest"], row["chief"], row["revisit"])))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return settle(rows.select("page_id", "url", "html", "digest", "chief", "revisit").mapInArrow(run, "archive string, content binary"))


class Damaged(ValueError):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place gives, where it ends, and "" or what is wrong with it; its checksum and length are checked."""
    z = zlib.decompressobj(31)
    out, pos, view = [], at, memoryview(data)
    while pos < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[pos : pos + STEP]))
        except zlib.error as e:
            try:  # what comes before the damage in this step
                for k in range(pos, len(data)):
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), len(data), str(e)
        pos += STEP
    if not z.eof:
        return b"".join(out), len(data), "truncated member"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def _consumed(data: bytes, at: int, upto: int) -> int:
    """The place by which the member at a place has given so many bytes."""
    z = zlib.decompressobj(31)
    given = 0
    while given < upto:
        given += len(z.decompress(data[at : at + 1]))
        at += 1
    return at


def _inside(inner: bytes) -> tuple[list[tuple[int, int, dict, bytes]], list[tuple[int, int, str]]]:
    """(start, end, headers, block) of the sound records of a member's content and (start, end, reason) of what is between them."""
    got, gaps, pos, bad, why = [], [], 0, -1, ""
    while pos < len(inner):
        try:
            head, block, end = _parse(inner, pos)
        except Damaged as e:
            if bad < 0:
                bad, why = pos, str(e)
            m = VERSION_LINE.search(inner, pos + 1)
            pos = m.start() if m else len(inner)
            continue
        if bad >= 0:
            gaps.append((bad, pos, why))
            bad = -1
        got.append((pos, end, head, block))
        pos = end
    if bad >= 0:
        gaps.append((bad, len(inner), why))
    return got, gaps


def _proven(head: dict) -> bool:
    """Whether a parsed record's block was held against a digest."""
    return head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:")


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at a place; the declared length, the ending and the digest are checked."""
    m = VERSION_LINE.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    if not m or stop < 0:
        raise Damaged("no record header")
    head = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("bad length")
    end = stop + 4 + int(length)
    block = data[stop + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it should")
    if head.get("warc-type") == "response":
        want = head.get("warc-payload-digest", "")
        if want.startswith("sha1:") and hashlib.sha1(block).hexdigest() != want[5:].lower():
            raise Damaged("digest differs")
    return head, block, end + 4


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) of all sound records, and ("gap", offset, length, reason, None) of bytes between them.

    After a failed check the next place that holds a gzip member's or a version line's first bytes is tried, and so on; one
    gap covers all bytes from the failure up to the next sound record. In a member of several records the search goes on in its
    content: a gap there has the member's offset and length, and its reason names the inner bytes. A member cut short gives its
    complete records, and one with a damaged stream those that their digests prove, if the damage shows elsewhere in it.
    """
    at, bad, why = 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(MEMBER, at):
                inner, end, wrong = _member(data, at)
                got, gaps = _inside(inner)
                if wrong and wrong != "truncated member":
                    got = [r for r in got if gaps and _proven(r[2])]
                if not got and (wrong or gaps):
                    raise Damaged(wrong or gaps[0][2])
                if wrong:
                    end = _consumed(data, at, got[-1][1])
                    gaps = [g for g in gaps if g[1] <= got[-1][0]]
            else:
                head, block, end = _parse(data, at)
                got, gaps, wrong = [(0, end - at, head, block)], [], ""
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            m = START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad >= 0:
            yield "gap", bad, at - bad, why, None
            bad = -1
        for _, _, head, block in got:
            yield "record", at, end - at, head, block
        for lo, hi, reason in gaps:
            yield "gap", at, end - at, f"{reason} (inner bytes {lo} to {hi})", None
        at = end
        if wrong:
            bad, why = at, wrong
            m = START.search(data, at)
            at = m.start() if m else len(data)
    if bad >= 0:
        yield "gap", bad, len(data) - bad, why, None


SCHEMA = "archive string, kind string, offset long, length long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(archive, content) -> a row of kind "record" for each sound record and of kind "gap" for each quarantined stretch of bytes.

    Null or empty content has no rows. A record whose id is no page's has a null page_id. payload is null unless asked for.
    """
    number = re.compile(rf"<{PAGE}(-?\d+)>")
    page = lambda head, name: int(m[1]) if (m := number.fullmatch(head.get(name, ""))) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for kind, offset, length, head, block in salvage(row["content"] or b""):
                    if kind == "gap":
                        out.append((row["archive"], kind, offset, length, head, *[None] * 7))
                        continue
                    revisit = head.get("warc-type") == "revisit"
                    size = head.get("x-payload-length", "")
                    out.append((row["archive"], kind, offset, length, None, page(head, "warc-record-id"), head.get("warc-target-uri"),
                        int(size) if revisit and size.isdigit() else len(block), head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest(),
                        head.get("warc-type"), page(head, "warc-refers-to"), block if payloads else None))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return archives.select("archive", "content").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """What is read back of each page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    rows = read_archives(write_archives(pages)).where("kind = 'record'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
c AS (SELECT d, max(page_id) AS chief, count(*) AS c FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN c.c > 1 AND page_id IS DISTINCT FROM chief AND chief IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c.c > 1 AND page_id IS DISTINCT FROM chief THEN chief END AS refers_to
FROM p LEFT JOIN c ON p.d = c.d
"""
