"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writing: a record is headers and a payload in UTF-8, closed by two CRLF; the text sink with that closing as line
separator therefore writes valid uncompressed WARC files to any store that Spark writes to, with its commit protocol.
With ``gzip`` each record is a gzip member of its own, so that damage costs one record: a member's last byte (of its length) is zero and is
what the sink writes as line separator; a record from 16 MB on, whose length has no zero there, is followed by an empty member.
Of equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is stored, the others are revisits that carry
only the payload's length and digest.

Reading: plain files, files of gzip members and files that mix both, of any writer. A record is checked for its version line, its
headers (length, name, type), its length, its closing and its digests where their algorithm is known; page_id and refers_to are
the numbers in this writer's names and null for others, which record_id and refers_to_id give as they are. After a failed check the reader searches for the next version line (or the next gzip member that
opens) and goes on from there; what it passed over comes out as rows of type ``gap`` with the byte range and the reason.

Headers end within ``HEADERS`` bytes and hold no version line, so that false starts are passed over in linear time.

Edge cases: a null payload is empty, a null url is empty; line breaks in a url are written as %0D and %0A; a row whose page_id
is null gets a random name, is no other's original, and revisits the named page of its payload if there is one; repeated rows are records of their own, and of equal page_ids the payloads decide; an
empty table gives an empty archive and no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import settle, ship

MIN_REVISIT = 100
#: Bytes of a record's headers at most.
HEADERS = 1 << 16
CLOSING = "\r\n\r\n"
#: Bytes of a gzip member that are inflated at a time.
PIECE = 8192
#: Salts of a payload's group before its smallest id is known.
SALTS = 16
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def payload_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(url_col, F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(payload_col, F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    keys = settle(rows.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= min_revisit), "payloads")
    # Groups of equal payloads are counted salt by salt, so that a very common payload is no hot spot.
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
    parts = keys.groupBy("payload_digest", salt.alias("salt")).agg(F.min("page_id").alias("page_id"), F.max("page_id").alias("top"), F.bool_or(F.col("page_id").isNull()).alias("unnamed"))
    groups = parts.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("top").alias("top"), F.bool_or("unnamed").alias("unnamed")).where("refers_to < top or (unnamed and refers_to is not null)")
    groups = settle(groups.select("payload_digest", "refers_to"), "groups")
    again = keys.join(groups, "payload_digest").where("page_id is null or page_id <> refers_to")
    revisits = again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def write_warc(payloads: DataFrame, path: str, compression: str = "gzip", damaged: Column | None = None) -> None:
    """Writes the rows of :func:`payload_table` as WARC files below ``path``: a gzip member for each record, or plain with ``none``.

    For salvage drills, a byte in the middle of the member of each ``damaged`` row is turned over (see :func:`hurt_member`).
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:"), F.coalesce(F.concat(F.lit("page:"), F.col("page_id").cast("string")), F.concat(F.lit("uuid:"), F.uuid())), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(""),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    hurt = F.lit(False) if damaged is None else F.coalesce(damaged, F.lit(False))
    records = payloads.select(record.alias("value"), hurt.alias("hurt"))
    if compression == "none":
        if damaged is not None:
            raise ValueError("damage is done to gzip members only")
        records.select("value").write.options(lineSep=CLOSING, compression="none").text(path)
        return
    if compression != "gzip":
        raise ValueError(f"compression must be gzip or none, not {compression}")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for value, bad in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.append(member(value.as_buffer()))
                if bad:
                    held[-1] = hurt_member(held[-1])
                size += len(held[-1])
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    ship(payloads.sparkSession)
    # The sink writes the bytes of a string as they are.
    records.mapInArrow(members, "value binary").select(F.col("value").cast("string")).write.options(lineSep="\0", compression="none").text(path)


def member(record: bytes) -> bytes:
    """The gzip member of a record and its closing, without the zero byte that ends it."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.compress(CLOSING.encode()) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out[:-1]


def hurt_member(whole: bytes) -> bytes:
    """``whole``, as of :func:`member`, with one byte turned over: the first from the middle on that is a loss.

    A byte is none where a match then copies the same bytes from another place (1 of 44,871 pages of the check tables).
    """
    content = zlib.decompressobj(31).decompress(whole + b"\0")
    at = len(whole) // 2
    while True:
        hurt = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
        unpack = zlib.decompressobj(31)
        try:
            if unpack.decompress(hurt + b"\0") != content or not unpack.eof:
                return hurt
        except zlib.error:
            return hurt
        at += 1


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for part in lines.split(b"\r\n"):
        name, colon, value = part.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(row, end, "") of the record that starts at ``at``, or (None, at, reason)."""
    start = VERSION.match(data, at)
    if not start:
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", start.end(), start.end() + HEADERS)
    if stop < 0:
        return None, at, "headers do not end"
    if VERSION.search(data, start.end(), stop):
        return None, at, "version line within headers"
    head = _headers(data[start.end() : stop])
    try:
        length, name, kind = int(head["content-length"]), head["warc-record-id"], head["warc-type"]
    except (KeyError, ValueError):
        return None, at, "no length, name or type"
    begin, end = stop + 4, stop + 4 + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no closing where the length says"
    block = data[begin:end]
    payload, size, forms = block, None, [block]
    content = head.get("content-type") or ("application/http" if kind in ("response", "request", "revisit") else "")
    if content.lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        http, forms = _headers(http), [payload]
        size = http.get("content-length")
        if http.get("transfer-encoding", "").lower() == "chunked" and (whole := _unchunked(payload)) is not None:
            payload = whole
            forms.append(whole)
    digest, revisit = head.get("warc-payload-digest", ""), kind == "revisit"
    intact = _agrees(head.get("warc-block-digest", ""), [block])
    # Tools differ in what they call the payload; a block whose digest holds is sound whatever they say.
    if intact is False or intact is None and not revisit and "warc-truncated" not in head and _agrees(digest, forms) is False:
        return None, at, "block or payload differs from its digest"
    refers = head.get("warc-refers-to") if revisit else None
    row = {"page_id": _page(name), "record_id": name, "url": head.get("warc-target-uri"), "record_type": kind, "payload": None if revisit else payload}
    row |= {"payload_bytes": (int(size) if size and size.isdigit() else None) if revisit else len(payload), "payload_digest": digest.removeprefix("sha256:") or None}
    checked = bool(intact or not revisit and _agrees(digest, forms))
    return row | {"refers_to": _page(refers), "refers_to_id": refers, "checked": checked}, end + 4, ""


def _page(name: str | None) -> int | None:
    """The page_id in a name of this writer, null for other names."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", name or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _agrees(digest: str, forms: list[bytes]) -> bool | None:
    """Whether a labelled digest, in hex or base32, is that of one of the forms; None if its algorithm is not known."""
    label, _, value = digest.partition(":")
    label = label.lower().replace("-", "")
    if label not in ("md5", "sha1", "sha256", "sha384", "sha512") or not value:
        return None
    value = value.lower().rstrip("=")
    found = [hashlib.new(label, x).digest() for x in forms]
    return any(value in (x.hex(), base64.b32encode(x).decode().lower().rstrip("=")) for x in found)


def _unchunked(body: bytes) -> bytes | None:
    """The content of a chunked HTTP body, None if it is not one."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,15})\s*(;.*)?", body[at:stop]) if stop >= 0 else None
        if not size:
            return None
        n = int(size[1], 16)
        if not n:
            return b"".join(parts)
        if body[stop + 2 + n : stop + 4 + n] != b"\r\n":
            return None
        parts.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


def _inflate(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]], int, str]:
    """(content, places, end, reason) of the gzip member at ``at``; of a damaged one the content before the damage.

    ``places``: (bytes of content, offset in the file) after each piece that was read.
    """
    unpack, parts, places, k, made = zlib.decompressobj(31), [], [(0, at)], at, 0
    try:
        while not unpack.eof and k < len(data):
            before = unpack.copy() if k > at else None
            parts.append(unpack.decompress(data[k : k + PIECE]))
            k += PIECE
            made += len(parts[-1])
            places.append((made, min(k, len(data))))
    except zlib.error as e:
        # Byte by byte, the piece gives what comes before the damage.
        unpack = before or zlib.decompressobj(31)
        try:
            for i in range(k, min(k + PIECE, len(data))):
                parts.append(unpack.decompress(data[i : i + 1]))
                made += len(parts[-1])
                places.append((made, i + 1))
        except zlib.error:
            pass
        return b"".join(parts), places, at, f"member: {e}"
    return b"".join(parts), places, min(k, len(data)) - len(unpack.unused_data), "" if unpack.eof else "member is cut off"


def _member(data: bytes, at: int) -> tuple[list[dict], int, int, str]:
    """(rows, lost, end, reason) of the gzip member at ``at``; if it is damaged, what is lost begins at ``lost``."""
    content, places, end, reason = _inflate(data, at)
    rows, done, whole = [], 0, True
    for row, stop in _plain(content):
        if not reason:
            rows.append(row if row["record_type"] != "gap" else row | {"gap_start": at, "gap_end": end})
        elif row["record_type"] == "gap":
            whole = False
        # Bytes that a failed check lets through may be wrong, so that without a digest nothing vouches for them.
        elif row["checked"] or reason == "member is cut off":
            rows.append(row)
            done = stop if whole else done
    if whole and reason.endswith(("incorrect data check", "incorrect length check")):
        # The damage is in the headers of any record; those of an only record are not to be trusted.
        return rows if len(rows) > 1 else [], at, end, reason
    return rows, max(place for made, place in places if made <= done) if done else at, end, reason


def _plain(data: bytes) -> Iterator[tuple[dict, int]]:
    """(row, end) of the records and gaps of bytes that hold records one after the other."""
    at, gap, why = 0, None, ""
    while at < len(data):
        row, end, reason = _record(data, at)
        if row is None:
            if gap is None:
                gap, why = at, reason
            found = VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield {"record_type": "gap", "gap_start": gap, "gap_end": at, "reason": why}, at
            gap = None
        yield row, end
        at = end
    if gap is not None:
        yield {"record_type": "gap", "gap_start": gap, "gap_end": len(data), "reason": why}, len(data)


def salvage(data: bytes) -> Iterator[dict]:
    """Rows of all sound records of a file, and a row of type gap for each range of bytes passed over.

    Offsets within gzip files are those in the file: of the member if a record in a sound member is not sound, else from
    where the last record that was recovered ends (at most ``PIECE`` bytes before) to the next member that opens.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        lost = at
        if data.startswith(MAGIC, at):
            rows, lost, end, reason = _member(data, at)
        else:
            row, end, reason = _record(data, at)
            rows = [row] if row else []
        if gap is not None and (rows or not reason):
            if gap < at:
                yield {"record_type": "gap", "gap_start": gap, "gap_end": at, "reason": why}
            gap = None
        yield from rows
        if reason:
            if gap is None:
                gap, why = lost, reason
            found = START.search(data, at + 1)
            at = found.start() if found else len(data)
        else:
            at = end
    if gap is not None and gap < len(data):
        yield {"record_type": "gap", "gap_start": gap, "gap_end": len(data), "reason": why}


_RECORDS = "path string, record_type string, page_id long, record_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, gap_start long, gap_end long, reason string"
_ARROW = pa.schema(
    [("path", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string())]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files below ``path``; without ``payloads`` their column stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held = batch.column(0)[i].as_py(), []
                for row in salvage(batch.column(1)[i].as_py()):
                    if not payloads:
                        row.pop("payload", None)
                    held.append(row | {"path": name})
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _RECORDS)
