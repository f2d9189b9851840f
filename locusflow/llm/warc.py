"""WARC archives: a writer of response and revisit records and a salvage reader.

Archives are WARC/1.1 files of one gzip member a record, made by Spark's text writer, whose commits survive lost
executors. Each record is a row. The writer must end rows with a byte; a member's last byte is the highest of its length,
0 below 16 MB, so rows leave it out and the row end is that byte (a longer record is followed by an empty member, which
ends so). Files hold at most RECORDS_PER_FILE records. The reader takes plain and per-record-gzip archives. It checks each
record (version line, headers, length, closing blank lines, payload digest); after a failed check it looks for the next
version line or gzip member, goes on there, and logs the gap as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import BROADCAST_ROWS, Scratch, chunks, tidy

#: Records of a file, and the most that one may have to be written with others: so a file has 1 GB at most, or one record.
RECORDS_PER_FILE = 2000
SHARED_BYTES = (1 << 30) // RECORDS_PER_FILE
LEVEL = 4
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
GZIP = b"\x1f\x8b\x08"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, own: str = "") -> str:
    """The id of a page's record; `own` tells records without a page_id apart."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page-{own if page_id is None else page_id}')}>"


def clean(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"\s+", " ", value or "").strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own: str = "") -> bytes:
    """One record without its last line end, which the writer adds.

    A revisit has no payload, but its digest and, as an extension field, its length.
    """
    http = HEAD % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {page_id}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n"


class Broken(ValueError):
    pass


def parse(data: bytes, at: int, places: Places) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at this place, or Broken."""
    if not VERSION.match(data, at):
        raise Broken("no version line")
    stop = places.after("blank", at)
    if stop == len(data):
        raise Broken("headers do not end")
    if VERSION.search(data, at + 1, stop):
        raise Broken("headers run into another record")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("a header without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (n := head.get("content-length", "")).isascii() or not n.isdigit():
        raise Broken("no content length")
    begin = stop + 4
    end = begin + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("the block does not end where its length says")
    return head, data[begin:end], end + 4


def checked(head: dict[str, str], block: bytes) -> tuple[bytes, str]:
    """(payload, its digest, of a revisit as recorded); Broken if the payload is not what its digest says."""
    payload = block.partition(b"\r\n\r\n")[2] if "http" in head.get("content-type", "") else block
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "revisit":
        return payload, said
    if said and said != (is_ := digest(payload)):
        raise Broken("the payload digest differs")
    return payload, is_ if said else digest(payload)


#: Compressed bytes that are handed to the decompressor at a time.
STEP = 1 << 16


def members(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at this place, or Broken. Takes time and memory by the member, not by the file."""
    d, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not d.eof and at < len(data):
            out.append(d.decompress(view[at : at + STEP]))
            at += STEP
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from None
    if not d.eof:
        raise Broken("gzip: the member is cut off")
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


class Places:
    """The next place of a pattern at or after a place that only moves on, so that a file is searched once."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.next = {"version": -1, "gzip": -1, "blank": -1}

    def after(self, kind: str, at: int) -> int:
        """The size of the data if there is none."""
        if self.next[kind] < at:
            if kind == "version":
                m = VERSION.search(self.data, at)
                self.next[kind] = m.start() if m else self.size
            else:
                i = self.data.find(GZIP if kind == "gzip" else b"\r\n\r\n", at)
                self.next[kind] = i if i >= 0 else self.size
        return self.next[kind]


def salvage(data: bytes):
    """Yields ("record", start, end, headers, payload, digest) and ("gap", start, end, reason) over a whole archive, without holes.

    digest is that of a response's payload, and what the header says for others. Empty gzip members belong to the record
    before them.
    """
    at, gap, why, held = 0, None, "", None
    places = Places(data)
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                content, end = members(data, at)
                if not content and held and gap is None:
                    held, at = (*held[:2], end, *held[3:]), end
                    continue
                head, block, stop = parse(content, 0, Places(content))
                if stop != len(content):
                    raise Broken("bytes after the record in its member")
            else:
                head, block, end = parse(data, at, places)
            payload, sum_ = checked(head, block)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = min(places.after("version", at + 1), places.after("gzip", at + 1))
            continue
        if held:
            yield held
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        held, at = ("record", at, end, head, payload, sum_), end
    if held:
        yield held
    if gap is not None:
        yield "gap", gap, len(data), why


def originals(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """same (SHA-256 of a payload of at least `least` bytes that several rows have) and refers_to, their largest page_id."""
    narrow = pages.select("page_id", _same().alias("same"), F.octet_length(_payload()).alias("n")).filter(F.col("n") >= least)
    last = narrow.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    return scratch.keep(last.select("same", "refers_to"), "originals")


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def _same() -> Column:
    return F.unhex(F.sha2(_payload(), 256))


def write_warc(pages: DataFrame, path: str, scratch: Scratch, least: int = 0) -> None:
    """Writes a record for each row of pages (page_id, url, html).

    Null html is an empty payload and null urls are empty; other columns are not written. Of equal payloads the largest
    page_id is the response; rows of that id are responses each, and rows without page_id are revisits of it (responses,
    where no row of the payload has an id), each with a record id of its own. Rows of one page_id and different html are
    taken each by its own payload. Pages of more than SHARED_BYTES have a file each, so that every file can be read as a whole.
    """
    last = originals(pages, scratch, least).withColumnRenamed("same", "_same")
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last  # else a shuffle, of which adaptive execution splits hot payloads
    joined = pages.select("page_id", "url", "html").join(last, _same() == F.col("_same"), "left")
    revisit = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    joined = joined.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"))

    def run(batches):
        task, count = f"{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}", 0
        for (ids, urls, refers), texts in chunks(batches, "html", ["page_id", "url", "refers_to"]):
            rows = [packed(record(*x, f"none-{task}-{count + k}") + b"\r\n") for k, x in enumerate(zip(ids, urls, texts, refers, strict=True))]
            count += len(rows)
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            # Bytes as they are, which Arrow's own cast to strings would refuse.
            out = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(b"".join(rows)))
            yield pa.RecordBatch.from_arrays([out], names=["value"])

    long = F.coalesce(F.octet_length("html"), F.lit(0)) > SHARED_BYTES
    for part, name, most in ((joined.where(~long), "shared", RECORDS_PER_FILE), (joined.where(long), "single", 1)):
        part.mapInArrow(tidy(run), "value string").write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def packed(record: bytes) -> bytes:
    """A record as a gzip member less its last byte, 0."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    if out[-1]:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += c.flush()
    return out[:-1]


RECORDS = (
    "file string, start long, end long, record_type string, record_id string, url string, page_id long, refers_to long, "
    "payload_bytes long, payload_digest string, gap string"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives under path (RECORDS); `gap` is null on records and the reason on gaps.

    payload_bytes and payload_digest are taken from the payload of responses and from the headers of revisits. An
    archive is held by one task (as Spark's binaryFile source reads it, up to 2 GB); empty ones give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for kind, start, end, *rest in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((file.as_py(), start, end, *[None] * 7, rest[0]))
                        continue
                    head, payload, sum_ = rest
                    number = lambda k, h=head: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
                    revisit = head.get("warc-type") == "revisit"
                    rows.append((
                        file.as_py(), start, end, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"),
                        number("x-page-id"), number("x-refers-to-page-id"),
                        number("x-payload-length") if revisit else len(payload), sum_, None,
                    ))
                cols = list(zip(*rows, strict=True)) or [[]] * 11
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 3, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return files.mapInArrow(tidy(run), RECORDS)


def round_trip(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Writes pages as archives to the shared folder and reads them back: one row for each row of pages.

    Null html is an empty payload; repeated rows give a row each; a null page_id stays null; an empty table gives no rows;
    other columns are not written.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    write_warc(pages, scratch.path("archives"), scratch)
    back = read_warc(pages.sparkSession, scratch.path("archives"))
    return back.filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
