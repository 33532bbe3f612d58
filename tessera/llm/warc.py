"""WARC archives: a writer with revisit records and a salvaging reader.

Writing: one record per page, each in a gzip member of its own. Pages whose
payload of at least ``MIN_REVISIT`` bytes occurs more than once keep one response
record, that with the smallest page_id; the others become revisits, which carry
the payload's digest and length but not its bytes.

Reading: records stream out one by one. When a check fails (bad gzip member, bad
version line, wrong length, wrong digest) the reader searches for the next gzip
member or version line that starts a valid record, goes on from there, and logs
the skipped bytes as a quarantined gap.

Edge cases: a null html is an empty payload; urls and payloads may have any length;
pages that repeat the smallest page_id with the same payload are all responses; where
every page_id of a payload is null, all its records are responses; an empty table
writes no archive and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, new_path, open_fs, table

MIN_REVISIT = 100
VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20
MAX_HEADER = 256 << 20  # of a gzip member; only members without any header end reach it


# ---- one record ---------------------------------------------------------

def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """The bytes of one uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        VERSION.decode(),
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_header(lines: bytes) -> dict[str, str]:
    """The fields of a record header without its closing blank line, by lower-case
    name. Raises ValueError if it is not one."""
    first, *fields = lines.split(b"\r\n")
    if first not in (b"WARC/1.0", VERSION):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    for line in fields:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("bad content length")
    return headers


def check_digest(headers: dict[str, str], block: bytes) -> None:
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha256:") and hashlib.sha256(block).hexdigest() != named[7:]:
        raise ValueError("wrong block digest")


# ---- salvaging reader ---------------------------------------------------

class SalvageReader:
    """Iterates ("record", offset, headers, block) and ("gap", start, end, reason)
    over a seekable binary stream.

    Headers and blocks may have any length. Memory holds one record and one read
    buffer: a plain record's end is looked at before its block is read, a gzip member
    that doesn't open with a version line is left at once, and a gap is only a pair of
    offsets. The search remembers the next place of each opening, so that a stretch
    without records is read once.
    """

    def __init__(self, stream):
        self.stream = stream
        self.size = stream.seek(0, 2)
        self.at, self.buf = 0, b""  # what is buffered, and from where
        openings = (GZIP_MAGIC, VERSION[:7], b"\r\n", b"\r\n\r\n")
        self.since, self.next = dict.fromkeys(openings, 0), dict.fromkeys(openings, -1)

    def _fill(self, at: int, n: int) -> None:
        """Buffer n bytes from ``at`` on, as far as there are so many."""
        have = self.at + len(self.buf)
        if at < self.at or at > have or (at + n > have and have < self.size):
            self.stream.seek(at)
            self.at, self.buf = at, self.stream.read(max(n, READ))

    def _read(self, at: int, n: int) -> bytes:
        self._fill(at, n)
        data = self.buf[at - self.at:at - self.at + n]
        if len(self.buf) > READ:
            self.at, self.buf = at + n, b""
        return data

    def _find(self, what: bytes, at: int) -> int:
        """Where ``what`` stands next, at or after ``at``; the size if nowhere."""
        if self.since[what] <= at <= self.next[what]:
            return self.next[what]
        place, hit = at, -1
        while place + len(what) <= self.size and hit < 0:
            self._fill(place, len(what))
            hit = self.buf.find(what, place - self.at)
            place = self.at + hit if hit >= 0 else self.at + len(self.buf) - len(what) + 1
        self.since[what], self.next[what] = at, place if hit >= 0 else self.size
        return self.next[what]

    def _record(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """The record at ``at`` and its stored size."""
        opening = self._read(at, len(VERSION) + 2)
        if opening.startswith(GZIP_MAGIC):
            return self._member(at)
        if opening not in (b"WARC/1.0\r\n", VERSION + b"\r\n"):
            raise ValueError("no version line" if len(opening) == len(VERSION) + 2 else "short rest")
        line = self._read(at + len(opening), 256)  # leave what is no header before looking for its end
        if b":" not in line.partition(b"\r\n")[0] or self._find(b"\r\n", at + len(opening)) == self.size:
            raise ValueError("bad header line")
        end = self._find(b"\r\n\r\n", at)
        if end == self.size:
            raise ValueError("record is cut off")
        headers = parse_header(self._read(at, end - at))
        start, stop = end + 4, end + 4 + int(headers["content-length"])
        if stop + 4 > self.size:
            raise ValueError("record is cut off")
        if self._read(stop, 4) != b"\r\n\r\n":
            raise ValueError("wrong record end")
        block = self._read(start, stop - start)
        check_digest(headers, block)
        if "warc-block-digest" not in headers and stop + 4 < self.size and not self._read(stop + 4, 7).startswith((GZIP_MAGIC, VERSION[:7])):
            if b"\r\n\r\n" + VERSION[:7] in block:
                raise ValueError("block overlaps the next record")
        return headers, block, stop + 4 - at

    def _member(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """One record in a gzip member. What is unpacked is bounded by the length that the
        header states (and a header by MAX_HEADER), whatever the member would expand to."""
        data, d, used, step, headers, most = bytearray(), zlib.decompressobj(31), at, 2048, None, MAX_HEADER
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                part, step = self._read(used, step), min(4 * step, READ)
                used += len(part)
                if not part:
                    raise ValueError("gzip member is cut off")
            known = len(data)
            try:
                data += d.decompress(part, READ)
            except zlib.error as e:
                raise ValueError(f"bad gzip member: {e}") from None
            if known < 7 and not data[:7] == VERSION[:7][:len(data)]:
                raise ValueError("no version line")
            if headers is None and (end := data.find(b"\r\n\r\n", max(0, known - 3))) >= 0:
                headers = parse_header(bytes(data[:end]))
                most = end + 8 + int(headers["content-length"])
            if len(data) > most:
                raise ValueError("header too long" if headers is None else "bytes after the record")
        if headers is None or len(data) < most or data[-4:] != b"\r\n\r\n":
            raise ValueError("member ends inside a record")
        block = bytes(data[end + 4:-4])
        check_digest(headers, block)
        return headers, block, used - len(d.unused_data) - at

    def __iter__(self) -> Iterator[tuple]:
        at = 0
        while at < self.size:
            gap, reason = at, ""
            while at < self.size:
                try:
                    headers, block, n = self._record(at)
                    break
                except ValueError as e:
                    reason = reason or str(e)
                    at = min(self._find(GZIP_MAGIC, at + 1), self._find(VERSION[:7], at + 1))
            if at > gap:
                yield "gap", gap, at, reason
            if at < self.size:
                yield "record", at, headers, block
                at += n


# ---- Spark --------------------------------------------------------------

ARCHIVES = "path string, n_records long, bytes long"
RECORDS = "kind string, path string, start long, stop long, reason string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_revisits(pages: DataFrame) -> DataFrame:
    """Pages with the columns __payload, __digest and __refers_to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("__payload"))
    own = own.withColumn("__digest", F.sha2("__payload", 256))
    repeated = (
        own.filter(F.length("__payload") >= MIN_REVISIT)
        .groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1 and __first is not null").select(F.col("__digest").alias("__d"), "__first")
    )
    repeated = cut(repeated, "revisits")
    joined = own.join(repeated, F.col("__digest") == F.col("__d"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "__payload", "__digest", F.when(~is_first, F.col("__first")).alias("__refers_to"))


def write_archives(pages: DataFrame, folder: str, max_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Write the pages into gzip archives under ``folder``; returns their manifest.

    File names carry a fresh id, and only files that a finished task has reported
    are in the manifest, so retried or duplicate tasks do no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        part, out, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or rows[-1][2] >= max_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    rows.append([f"{folder}/{name}", 0, 0])
                data = gzip_member(build_record(page_id, url, payload, refers, digest), level)
                out.write(data)
                rows[-1][1] += 1
                rows[-1][2] += len(data)
        if out is not None:
            out.close()
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "bytes"])

    return cut(plan_revisits(pages).mapInArrow(write, ARCHIVES), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """Records and gaps of all archives in the column ``path`` (RECORDS). With
    ``whole``, an archive that gives another number of records than its n_records
    fails the query."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path, n_records in zip(batch["path"], batch["n_records"] if whole else [None] * len(batch)):
                fs, inner = open_fs(path)
                rows, held, found = [], 0, 0
                with fs.open_input_file(inner) as stream:
                    for item in SalvageReader(stream):
                        if item[0] == "gap":
                            rows.append(("gap", path, *item[1:], *[None] * 7))
                        else:
                            rows.append(_record_row(path, item, with_payload))
                            found += 1
                            held += len(item[3]) * with_payload + 200
                        if held > 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if whole and found != n_records:
                    raise ValueError(f"{path} holds {n_records} records, but {found} were read")
                if rows:
                    yield _frame(rows, names)

    n = max(1, min(archives.count(), 100_000))
    return archives.select("path", *["n_records"] * whole).repartition(n).mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("start", "stop", "page_id", "payload_bytes", "refers_to")})


def whole(text: str | None) -> int | None:
    """The number of a header that this writer adds; foreign archives may have anything there."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}|-?9[0-9]{18}", text, re.A) and abs(int(text)) < 2**63 else None


def _record_row(path: str, item: tuple, with_payload: bool) -> tuple:
    _, start, headers, block = item
    kind = headers.get("warc-type")
    page = headers.get("x-page-id")
    if kind == "revisit":
        payload = None
        size, digest = whole(headers.get("x-payload-length")) or 0, headers.get("warc-payload-digest", "").removeprefix("sha256:")
    else:
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = headers.get("x-refers-to-page")
    return ("record", path, start, None, None, whole(page), headers.get("warc-target-uri"),
            payload if with_payload else None, size, digest, kind, whole(refers))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    records = read_archives(archives, with_payload=False, whole=True).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
}
