"""WARC: writer with revisit records, and a salvage reader.

Style: free (Arrow batches) for records and their bytes, DataFrame operations for digests'
groups.  All files are written and listed by Spark's own writers and readers, so archives may
be in any store that Spark reaches.

*Writer.*  One gzip member a record.  Of records with equal payloads of at least
``min_bytes`` bytes, the one with the largest id is the response, the others are revisits that
refer to it and hold no payload; smaller payloads are all responses.  Groups of equal payloads
are found from (digest, largest id), pre-aggregated and staged; only ids and digests are
shuffled for that, and the records' join with the groups of several is one that adaptive
execution splits on a hot digest.

An archive file is a sequence of chunks of whole members; Spark's text writer puts a constant
separator after each chunk, which is itself a gzip member with a warcinfo record, so the file
is a valid archive throughout.

*Salvage reader.*  Reads members (or plain records) one after the other and checks the gzip
checksum, the version line, the headers (the mandatory type, id and length among them, none of
them twice), the record's closing line ends and, where there is one, the digest of the block or
its payload.  After a failed check it searches from the next byte on for the next member or
version line that passes them, logs the bytes between as a quarantined gap with the reason, and
goes on.  In a member of several records it searches the inflated bytes in the same way: records
before and after a bad one are kept, and the gap has the member's place and says which of its
inflated bytes are lost.  A broken member (bad checksum, cut short, bad codes) is inflated up
to its break, which halving of the failing step finds; the records in it that pass their checks
are kept, once each, and the search goes on behind the last byte that they needed.  A record's checks cover its header's form
and its digest, so a broken member's record without a digest is kept unverified, next to the
logged gap.  Recovered stretches and gaps cover the file once; each mark is searched for once,
a start that must meet a known fault is skipped, and false starts of members may inflate a gap's
bytes FALSE_STARTS times together, after which the search goes on at the furthest break that
they came to: a hostile archive costs a bounded number of passes over it.  Members that such an
archive hides between more false starts than that are part of its gap.

Memory is one archive file (Spark's binaryFile source: up to 2 GB a file, so larger archives
have to be cut before) and one inflated member with its records; the writer starts a new file every FILE_CHUNKS chunks.

Defined cases: a null payload is empty; a null id is written as ``null`` and read as null, and
is a response only where all ids of its payload are null; rows that repeat the id and payload
of a response are all responses; an empty table gives no archive and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import Workspace, ship

CHUNK_BYTES = 1 << 20
FILE_CHUNKS = 32
STEP = 1 << 14
#: How often false starts may inflate the bytes of a gap, and bytes that they may inflate in any case.
FALSE_STARTS, LEAST_SPENT = 16, 1 << 20
_MAGIC, _WARC = b"\x1f\x8b\x08", b"WARC/1."
_ONCE = frozenset(("warc-type", "warc-record-id", "content-length"))
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes) -> bytes:
    """raw as one gzip member with a constant header."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


SEPARATOR = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:00000000-0000-0000-0000-000000000000>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: pressline\r\n"))


def page_record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record(headers, http + (payload if refers_to is None else b""))


def write(df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, workspace: Workspace) -> None:
    """Write one record per row of df as archive files below path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    thin = rows.filter(F.octet_length("payload") >= min_bytes).select("id", "sha")
    groups = thin.groupBy("sha").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND last IS NOT NULL")
    groups = workspace.stage(groups.select(F.col("sha").alias("gsha"), "last"), "groups")
    again = (F.octet_length("payload") >= min_bytes) & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    linked = rows.join(groups, F.col("sha") == F.col("gsha"), "left").select("id", "url", F.octet_length("payload").alias("size"), "sha", F.when(again, F.col("last")).alias("ref"), F.when(~again, F.col("payload")).alias("payload"))

    def chunks(it):
        held, size = [], 0
        for batch in it:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, n, sha, ref, body = (x.as_py() for x in row)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                held.append(member(page_record(page_id, url, body or b"", n, digest, ref)))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = linked.mapInArrow(chunks, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", FILE_CHUNKS).text(path)


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class Bad(NamedTuple):
    """What is wrong with a record, and the first place where a later record could begin: every start before it meets the same fault."""

    reason: str
    look_from: int


class Marks:
    """The next place of each mark, each stretch of the bytes searched once: the places asked for never go back."""

    def __init__(self, raw: bytes, *marks: bytes):
        self.raw, self.places = raw, dict.fromkeys(marks, -1)

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from ``at`` on; the end of the bytes if there is none."""
        if self.places[mark] < at:
            found = self.raw.find(mark, at)
            self.places[mark] = len(self.raw) if found < 0 else found
        return self.places[mark]


def parse(raw: bytes, at: int) -> Record | Bad:
    """The record that begins at ``at``, or what is wrong with it."""
    version = _VERSION.match(raw, at)
    if not version:
        return Bad("no version line", at + 1)
    headers: dict[str, str] = {}
    places: dict[str, int] = {}
    here, key = version.end(), ""
    while True:
        end = raw.find(b"\r\n", here)
        if end < 0:
            return Bad("headers do not end", len(raw))
        if end == here:
            break
        line = raw[here:end]
        if line[:1] in (b" ", b"\t") and key:  # a folded value goes on
            headers[key] += " " + line.decode("utf-8", "replace").strip()
            here = end + 2
            continue
        name, colon, value = line.partition(b":")
        key = name.decode("latin-1").lower()
        if not colon or not name:  # a version line is one such
            return Bad("bad header line", here)
        if key in _ONCE and key in headers:  # a record that is cut inside its headers runs into the next one's
            return Bad("bad header line", places[key])
        headers[key], places[key] = value.decode("utf-8", "replace").strip(), here
        here = end + 2
    start = end + 2
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return Bad("no content length", end)
    if not headers.keys() >= _ONCE:
        return Bad("no type or no id", end)
    stop = start + int(length)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return Bad("no line ends after the block", end)
    block = raw[start:stop]
    said = headers.get("warc-payload-digest", "")
    if said.startswith("sha1:") and headers["warc-type"] == "response" and digest_of(payload_of(block)) != said[5:]:
        return Bad("payload digest differs", end)
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and digest_of(block) != said[5:]:
        return Bad("block digest differs", end)
    return Record(at, stop + 4 - at, headers, block)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    cut = block.find(b"\r\n\r\n")
    return block[cut + 4 :] if block.startswith(b"HTTP/") and cut >= 0 else block


_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)", re.I)


def payload_size(r: Record) -> int:
    """Bytes of the payload; of a revisit, as its HTTP header says."""
    if r.headers.get("warc-type") != "revisit":
        return len(payload_of(r.block))
    said = _LENGTH.search(r.block)
    return int(said[1]) if said else 0


def deflate_start(raw: bytes, at: int) -> int:
    """Where the compressed bytes of the gzip member at ``at`` begin; -1 if its header is cut short."""
    if len(raw) < at + 10:
        return -1
    flags, here = raw[at + 3], at + 10
    if flags & 4:
        here += 2 + int.from_bytes(raw[here : here + 2], "little")
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            here = raw.find(b"\0", here) + 1
            if not here:
                return -1
    here += 2 if flags & 2 else 0
    return here if here <= len(raw) else -1


class Member(NamedTuple):
    plain: bytes
    after: int  # the place after the member, or where it breaks
    wrong: str  # '' if nothing is


def _feed(raw: bytes, start: int, stop: int, into: bytearray, enough: int | None = None):
    """Inflate raw[start:stop] by steps into ``into``: the inflater, the place after the last good step, and the fault if one ended it.

    With ``enough``, it ends with the step by which so many bytes are there.
    """
    d, i = zlib.decompressobj(-15), start
    while i < stop and not d.eof and (enough is None or len(into) < enough):
        try:
            into += d.decompress(raw[i : min(i + STEP, stop)])
        except zlib.error as e:
            return d, i, str(e)
        i = min(i + STEP, stop)
    return d, i - len(d.unused_data), ""


def _halve(raw: bytes, i: int, n: int, d, into: bytearray, enough: int | None = None) -> int:
    """The place of the one byte of raw[i : i + n] at which inflating fails, or gives ``enough`` bytes; what comes before goes into ``into``.

    The stretch is halved: the good half is kept, so all its bytes are inflated about twice.
    """
    while n > 1:
        half = n // 2
        c = d.copy()
        try:
            got = c.decompress(raw[i : i + half])
        except zlib.error:
            n = half
            continue
        if enough is not None and len(into) + len(got) >= enough:
            n = half
            continue
        d, i, n = c, i + half, n - half
        into += got
    return i


def inflate(raw: bytes, at: int) -> Member:
    """The gzip member at ``at``: all that it holds, up to its break if it has one."""
    begin = deflate_start(raw, at)
    if begin < 0:
        return Member(b"", len(raw), "member is cut short")
    plain = bytearray()
    d, i, fault = _feed(raw, begin, len(raw), plain)
    if fault:
        plain = bytearray()  # again up to the failing step, whose inflater is of no use
        d, i, _ = _feed(raw, begin, i, plain)
        i = _halve(raw, i, min(STEP, len(raw) - i), d, plain)
        return Member(bytes(plain), i, f"member fails: {fault}")
    if not d.eof or len(raw) < i + 8:
        return Member(bytes(plain), len(raw), "member is cut short")
    crc, size = zlib.crc32(plain), len(plain) & 0xFFFFFFFF
    said = raw[i : i + 8]
    wrong = "" if said == crc.to_bytes(4, "little") + size.to_bytes(4, "little") else "member fails: checksum or size differs"
    return Member(bytes(plain), i + 8, wrong)


def place_of(raw: bytes, at: int, size: int) -> int:
    """The first place by which the member at ``at`` has given ``size`` bytes."""
    begin, plain = deflate_start(raw, at), bytearray()
    if size <= 0:
        return begin
    _, i, _ = _feed(raw, begin, len(raw), plain, size)
    before, plain = begin + max(0, -(-(i - begin) // STEP) - 1) * STEP, bytearray()  # the step that gave enough
    d, i, _ = _feed(raw, begin, before, plain)
    return _halve(raw, i, min(STEP, len(raw) - i), d, plain, size) + 1


def walk(plain: bytes) -> Iterator[Record | Gap]:
    """Records of inflated bytes and the stretches between them that pass no check, in order; places are those in plain."""
    at, bad_from, reason, marks = 0, None, "", Marks(plain, _WARC)
    while at < len(plain):
        got = parse(plain, at)
        if isinstance(got, Bad):
            if bad_from is None:
                bad_from, reason = at, got.reason
            at = marks.next(_WARC, got.look_from)
            continue
        if bad_from is not None:
            yield Gap(bad_from, at - bad_from, reason)
            bad_from = None
        yield got
        at += got.length
    if bad_from is not None:
        yield Gap(bad_from, len(plain) - bad_from, reason)


_INSIDE = "{}; bytes {} to {} of the inflated member"


def unpack(raw: bytes, at: int) -> tuple[list[Record | Gap], int, Bad | None]:
    """What the gzip member at ``at`` holds, the place after what was recovered (of a member that fails without any record: its break), and what is wrong with the rest.

    Records and inner gaps have the place of the stretch of the member that was recovered.
    """
    m = inflate(raw, at)
    parts = list(walk(m.plain))
    if not any(isinstance(x, Record) for x in parts):
        if m.wrong or not parts:
            return [], m.after if m.wrong else at, Bad(m.wrong or "empty member", at + 1 if m.wrong else m.after)
        return [], at, Bad(parts[0].reason, m.after)  # its bytes are compressed and pass the checksum: no mark in them is one
    after = m.after
    if m.wrong:
        if isinstance(parts[-1], Gap):
            parts.pop()  # what the break left of a record belongs to the gap of the break
        done = parts[-1].offset + parts[-1].length
        after = place_of(raw, at, done)
        m = m._replace(wrong=f"{m.wrong}; from byte {done} of the inflated member on")
    length = after - at
    found = [x._replace(offset=at, length=length) if isinstance(x, Record) else Gap(at, length, _INSIDE.format(x.reason, x.offset, x.offset + x.length)) for x in parts]
    return found, after, Bad(m.wrong, after) if m.wrong else None


def salvage(raw: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order; offsets and lengths are of its own bytes (of what is inside a member: the recovered stretch of the member).

    Recovered stretches and gaps cover every byte once, and no record is given twice.  False starts of
    members may inflate a gap's bytes FALSE_STARTS times, together; then the search goes on at
    the furthest break that any of them came to.
    """
    at, bad_from, reason, marks = 0, None, "", Marks(raw, _MAGIC, _WARC)
    spent = furthest = 0
    while at < len(raw):
        found: list[Record | Gap] = []
        after = at
        if raw.startswith(_MAGIC, at):
            found, after, bad = unpack(raw, at)
        elif raw.startswith(_WARC, at):
            got = parse(raw, at)
            bad = got if isinstance(got, Bad) else None
            if bad is None:
                found, after = [got], at + got.length
        else:
            bad = Bad("no member or version line", at + 1)
        if found:
            if bad_from is not None:
                yield Gap(bad_from, at - bad_from, reason)
                bad_from = None
            spent = furthest = 0
            yield from found
        if bad is None:
            at = after
            continue
        if bad_from is None:
            bad_from, reason = after if found else at, bad.reason
        look_from = bad.look_from
        if not found and after > at:
            spent, furthest = spent + after - at, max(furthest, after)
            if spent > FALSE_STARTS * (furthest - bad_from) + LEAST_SPENT:
                look_from, spent = max(look_from, furthest), 0
        at = min(marks.next(m, look_from) for m in (_MAGIC, _WARC))
    if bad_from is not None and bad_from < len(raw):
        yield Gap(bad_from, len(raw) - bad_from, reason)


_OUT = "file string, offset bigint, length bigint, gap string, headers map<string,string>, payload_bytes bigint, block binary"


def read(spark: SparkSession, path: str, *, blocks: bool = True) -> DataFrame:
    """Records (gap null) and gaps (gap: the reason; headers null) of all archive files below path."""
    ship(spark)

    def rows(it):
        for batch in it:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name, out = file.as_py(), []
                size = 0

                def flush(out=out, name=name):
                    return pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(out)), pa.array([x.offset for x in out], pa.int64()), pa.array([x.length for x in out], pa.int64()), pa.array([getattr(x, "reason", None) for x in out], pa.string())]
                        + [pa.array([None if isinstance(x, Gap) else list(x.headers.items()) for x in out], pa.map_(pa.string(), pa.string())), pa.array([None if isinstance(x, Gap) else payload_size(x) for x in out], pa.int64()), pa.array([x.block if blocks and isinstance(x, Record) else None for x in out], pa.binary())],
                        names=["file", "offset", "length", "gap", "headers", "payload_bytes", "block"],
                    )

                for x in salvage(content.as_py()):
                    out.append(x)
                    size += len(x.block) if isinstance(x, Record) else 0
                    if size >= 1 << 22 or len(out) >= 5000:
                        yield flush()
                        out.clear()
                        size = 0
                if out:
                    yield flush()

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(rows, _OUT)


def pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records that ``write`` made."""

    def number(header: str) -> Column:
        return F.expr(f"try_cast(regexp_extract(headers['{header}'], '<urn:page:(-?[0-9]+)>', 1) as bigint)")

    return records.filter("gap IS NULL AND headers['warc-type'] IN ('response', 'revisit')").select(
        number("warc-record-id").alias("page_id"),
        "payload_bytes",
        F.substring(F.element_at("headers", F.lit("warc-payload-digest")), 6, 32).alias("payload_digest"),
        F.element_at("headers", F.lit("warc-type")).alias("record_type"),
        number("warc-refers-to").alias("refers_to"),
    )
