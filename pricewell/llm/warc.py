"""WARC archives: a writer of per-record gzip members, and a reader that salvages damaged files.

The reader checks each record: the member's CRC, the version line, the lengths, and the payload digest where it is one
of a known kind (hex or base 32). Where a check fails it searches on from there for the next gzip member that begins a
record, or the next version line in a plain file, and goes on; the bytes between are logged as a quarantined gap. Files
of other writers may have many records in one member; there a record with a wrong digest is a gap of its own (the member's bytes so far, since it has no others), and the
records of a member whose CRC is wrong are those that came before the damage.

Digests are compared apart from payloads: equal pages meet by digest, and revisits meet their responses without any
payload moving (common.meet_counted).

Defined results: a null html is an empty payload; payloads under `least` bytes are always responses; payloads and
headers have no greatest length, and a record is in memory as a whole while it is read; equal rows of one page_id are
records of their own; a page with a null page_id is a record without a page id, which nothing refers to; an empty table
gives an empty archive set; of other columns only url is read, and it may be null."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet_counted, new_dir, settle, slices

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
ID = "urn:x-page:"
#: An archive file is closed at this size.
ROLL_BYTES = 64 << 20
READ = 1 << 18
#: A stated length beyond so many bytes more than are held is checked before the record is read.
HOLD = 1 << 19
#: What no header has: zero bytes, bare line feeds, a second version line.
CUT = re.compile(rb"\0|[^\r]\n|\nWARC/1\.[01]\r\n")
#: Digests of equal pages are broadcast up to so many (some 100 bytes each).
MOST_DIGESTS = 200_000

RECORD = "path string, at long, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, stated_digest string, refers_to long"
GAP = "path string, gap_start long, gap_end long, reason string"


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """The pages with digest, payload and refers_to: the smallest page_id of equal payloads where that is another page."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex("digest")).otherwise(F.unhex(F.lit(""))))
    first = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = settle(first.where("n > 1"), "digests")
    other = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    return meet_counted(rows, first, ["key"], MOST_DIGESTS).withColumn("refers_to", F.when(other, F.col("first_id"))).drop("first_id", "key")


def _member(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = HTTP + (payload if kind == "response" else b"")
    own = f"{ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes every page as a record to archives in the shared folder; returns the settled manifest (path, n_records, n_bytes).

    A task's files get names of their own, so a repeated task leaves no mixed file; only files of the manifest count."""
    spark = pages.sparkSession
    target = new_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                kind = "response" if r["refers_to"] is None else "revisit"
                size += out.write(data := _member(kind, r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])) or len(data)
                n += 1
                if size >= ROLL_BYTES:
                    out.close()
                    done.append({"path": f"{target}/{path}", "n_records": n, "n_bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"path": f"{target}/{path}", "n_records": n, "n_bytes": size})
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return settle(mark_revisits(pages, least).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


class _Broken(Exception):
    pass


class _Bytes:
    """The bytes of a plain file from a place on, or of the gzip member there, read as they are asked for."""

    def __init__(self, file, at: int, packed: bool, size: int) -> None:
        self.file, self.at, self.size, self.held, self.step = file, at, size, b"", 1 << 12
        self.unpacker = zlib.decompressobj(31) if packed else None
        self.ended = False

    def read(self, at: int) -> bytes:
        """The next piece of the file; pieces grow, so that little is read for a short record."""
        self.file.seek(at)
        self.step = min(2 * self.step, READ)
        return self.file.read(self.step)

    def fill(self, n: int) -> bool:
        """Reads on until n bytes are held; False where there are not so many."""
        parts, have = [self.held], len(self.held)
        try:
            while have < n and not self.ended:
                data = self.unpacker.unconsumed_tail if self.unpacker else b""
                if not data:
                    data = self.read(self.at)
                    self.at += len(data)
                if self.unpacker is None:
                    self.ended = not data
                elif not data:
                    raise _Broken("truncated member")
                else:
                    data = self.unpacker.decompress(data, READ)
                    if self.unpacker.eof:  # the check sum was right
                        self.ended, self.at = True, self.at - len(self.unpacker.unused_data)
                parts.append(data)
                have += len(data)
        except zlib.error as e:
            raise _Broken("gzip check failed") from e
        finally:
            self.held = b"".join(parts)
        return len(self.held) >= n

    def closes(self, end: int) -> bool:
        """Whether a record that is `end` bytes long has its closing lines there; a long one is not held to find out."""
        if end <= len(self.held) + HOLD:
            return self.fill(end) and self.held[end - 4 : end] == b"\r\n\r\n"
        if self.unpacker is None:
            begin = self.at - len(self.held)
            self.file.seek(min(begin + end - 4, self.size))
            return self.file.read(4) == b"\r\n\r\n"
        if self.ended:
            return False
        unpacker, at, seen, tail = self.unpacker.copy(), self.at, len(self.held), self.held[-4:]
        try:
            while seen < end and not unpacker.eof:
                if not (data := unpacker.unconsumed_tail):
                    data = self.read(at)
                    at += len(data)
                if not data:
                    break
                data = unpacker.decompress(data, READ)
                tail, seen = (tail + data)[-(len(data) + 4) :], seen + len(data)
                if seen < end:
                    tail = tail[-4:]
        except zlib.error as e:
            raise _Broken("gzip check failed") from e
        over = seen - end
        return over >= 0 and tail[: len(tail) - over][-4:] == b"\r\n\r\n"

    def record(self) -> bytes:
        """The next record's bytes, taken off; a header without its end or a length is broken, and one that the next
        version line cuts short."""
        self.fill(10)
        if not re.match(rb"WARC/1\.[01]\r\n", self.held):
            raise _Broken("no version line")
        seen = 0
        while (head := self.held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            if CUT.search(self.held, max(seen - 11, 1)):
                raise _Broken("no header")
            seen = len(self.held)
            if not self.fill(2 * seen) and len(self.held) == seen:
                raise _Broken("no header")
        if CUT.search(self.held, 1, head):
            raise _Broken("no header")
        found = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", self.held[: head + 2], re.I)
        if not found:
            raise _Broken("no length")
        end = head + 8 + int(found[1])
        if not self.closes(end):
            raise _Broken("length check failed")
        self.fill(end)
        data, self.held = self.held[:end], self.held[end:]
        return data


def _fits(stated: str, payload: bytes) -> bool:
    """Whether a stated digest is the payload's; one of an unknown kind, or none, does not tell."""
    kind, _, value = stated.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(kind, payload).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _record(data: bytes) -> dict | None:
    """The fields of a whole record; None for kinds that hold no page."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in head.split(b"\r\n")[1:])}
    if (kind := fields.get("warc-type")) not in ("response", "revisit"):
        return None
    number = lambda x: int(m[1]) if (m := re.fullmatch(rf"<{ID}(-?\d+)>", fields.get(x, ""))) else None
    stated, payload = fields.get("warc-payload-digest", ""), block[:-4].partition(b"\r\n\r\n")[2]
    out = {"record_type": kind, "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None, "payload_digest": None, "stated_digest": stated, "refers_to": number("warc-refers-to")}
    if kind == "revisit":
        bare = re.fullmatch(r"sha256:([0-9a-fA-F]{64})", stated)
        return out | {"payload_digest": bare[1].lower() if bare else None}
    if not _fits(stated, payload):
        raise _Broken("digest check failed")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def _next_begin(file, at: int, size: int) -> int:
    """The next place from at where a gzip member with a version line, or a plain version line, begins; size if none."""
    step = 1 << 12
    while at < size:
        file.seek(at)
        data = file.read(step + 16)
        for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", data):
            if m.start() >= step:
                break
            if m[0] != MAGIC:
                return at + m.start()
            file.seek(at + m.start())
            try:
                if zlib.decompressobj(31).decompress(file.read(4096), 16).startswith(b"WARC/1."):
                    return at + m.start()
            except zlib.error:
                pass
        at += step
        step = min(2 * step, READ)
    return size


def salvage(file, size: int) -> Iterator[tuple[int, dict] | tuple[int, int, str]]:
    """(at, record) for each record that passes its checks, (start, end, reason) for each gap. at: where the record, or
    the member that holds it, begins."""
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(10)
        try:
            if not start.startswith((MAGIC, b"WARC/1.")):
                raise _Broken("no member or version line")
            packed = start.startswith(MAGIC)
            source, nth = _Bytes(file, at, packed, size), 0
            while not nth or packed and source.held:
                data = source.record()
                more = packed and source.fill(1)  # at the member's end its check sum is known
                try:
                    record = _record(data)
                    if record:
                        yield at, record
                except _Broken as e:
                    if not nth and not more:
                        raise
                    yield at, source.at, str(e)
                nth += 1
            at = source.at if packed else at + len(data)
        except _Broken as e:
            end = _next_begin(file, at + 1, size)
            yield at, end, str(e)
            at = end


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the files in manifest.path; each file is one task's stream, one record in memory at a time."""
    kind = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("refers_to", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                out, held = [], 0
                with store.open_input_file(place) as file:
                    for x in salvage(file, file.size()):
                        row = {"path": path, "at": x[0], "gap_end": x[1], "reason": x[2]} if len(x) == 3 else {"path": path, "at": x[0], **x[1]}
                        if not payloads:
                            row["payload"] = None
                        held += len(row.get("payload") or b"") + 200
                        out.append(row)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, kind)

    tasks = max(spark.sparkContext.defaultParallelism, 1)
    paths = manifest.select("path").repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    rows = paths.mapInArrow(run, RECORD + ", gap_end long, reason string")
    records = rows.where("reason is null").drop("gap_end", "reason")
    gaps = rows.where("reason is not null").select("path", F.col("at").alias("gap_start"), "gap_end", "reason")
    return records, gaps


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records with payload_bytes and payload_digest of revisits taken from the response they refer to, whose stated
    digest must be the same. Only ids and digests are joined; records keep their payloads where they are."""
    asks = F.col("refers_to").isNotNull() & (F.col("record_type") == "revisit")
    key = ["refers_to", "stated_digest"]
    asked = settle(records.where(asks).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "asked")
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "stated_digest", "payload_bytes", "payload_digest")
    full = full.join(asked, key).groupBy(*key, "n").agg(F.max("payload_bytes").alias("full_bytes"), F.max("payload_digest").alias("full_digest"))
    found = meet_counted(records.where(asks), settle(full, "referred"), key, MOST_DIGESTS)
    found = found.withColumns({"payload_bytes": F.coalesce("payload_bytes", "full_bytes"), "payload_digest": F.coalesce("payload_digest", "full_digest")}).drop("full_bytes", "full_digest")
    return records.where(~asks).unionByName(found)
