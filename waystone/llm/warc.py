"""WARC archives: writing pages with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range, looks for
gzip magic in it, accepts a place only if its member decodes to a WARC header, and owns the
records that start inside its range; it reads on past the end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from ..session import scratch_path

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"  # archives are the same for the same input
RESPONSE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

READ_BYTES = 1 << 20
FILE_BYTES = 64 << 20


def base32_sha1(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(identifier: str) -> int | None:
    last = identifier.strip("<>").rsplit(":", 1)[-1]
    return None if last == "none" else int(last)


def member(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One compressed record."""
    kind = "response" if refers_to is None else "revisit"
    block = RESPONSE + (html if refers_to is None else b"")
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(html)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def with_first_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds sha1, n_bytes and refers_to: the smallest page_id with an equal payload, or null."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    own = own.withColumn("n_bytes", F.octet_length("html").cast("long"))
    long_ones = own.filter(F.col("n_bytes") >= min_bytes)
    first = long_ones.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_id"))
    joined = own.join(first, ["sha1", "n_bytes"], "left")
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(later, F.col("first_id"))).drop("first_id")


def write_archives(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the list of files.

    Of records with equal payloads of at least ``min_bytes``, that with the smallest page_id
    is a response and the others revisit it. A null html is an empty payload; rows
    without page_id revisit the smallest id if there is one, else they are responses; rows that
    repeat the smallest id are all responses. The list (path, n_bytes, n_records) is
    stored once: files of failed attempts are in no list and are never read.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, number = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, sha1, refers_to = (c[k].as_py() for c in columns)
                data = member(page_id, url, html.encode(), base32_sha1(sha1), refers_to)
                if out is None:
                    name, size, number = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, number = size + len(data), number + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield _row(folder, name, size, number)
        if out is not None:
            out.close()
            yield _row(folder, name, size, number)

    rows = with_first_pages(pages, min_bytes)
    listed = rows.mapInArrow(run, "path string, n_bytes long, n_records long")
    return stage(listed, "warc-files")


def _row(folder: str, name: str, size: int, number: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"path": [f"{folder}/{name}"], "n_bytes": [size], "n_records": [number]}
    )


class Window:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size = file, size
        self.at, self.data = start, b""

    def more(self) -> bool:
        got = self.file.read_at(min(READ_BYTES, self.size - self.at - len(self.data)),
                                self.at + len(self.data)) if self.at + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def decode_member(window: Window) -> tuple[bytes, int] | None:
    """Content and compressed length of the member at the window's start; None: not a record."""
    unpack = zlib.decompressobj(31)
    parts, size, used = [], 0, 0
    while True:
        if used == len(window.data) and not window.more():
            return None
        try:
            part = unpack.decompress(window.data[used:])
        except zlib.error:
            return None
        used = len(window.data)
        parts.append(part)
        size += len(part)
        if size >= len(VERSION) and not b"".join(parts[:2] if len(parts) > 1 else parts).startswith(b"WARC/1."):
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
        if unpack.eof:
            content = b"".join(parts)
            return (content, used - len(unpack.unused_data)) if content.startswith(b"WARC/1.") else None


def members(file, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of every record that starts in [start, stop)."""
    window = Window(file, start, size)
    while window.at < stop:
        found = window.data.find(MAGIC)
        if found < 0:
            keep = min(len(MAGIC) - 1, len(window.data))
            window.drop(len(window.data) - keep)
            if not window.more():
                return
            continue
        window.drop(found)
        if window.at >= stop:
            return
        record = decode_member(window)
        if record is None:
            window.drop(1)  # these bytes only look like a member
            continue
        yield window.at, record[0]
        window.drop(record[1])


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers.get("content-length", len(rest)))
    if len(rest) < length:
        raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
    return headers, rest[:length]


#: Reading of a task, where there are more ranges than twice the cores.
TASK_BYTES = 128 << 20


def read_archives(files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Records of the files listed in ``files`` (path, n_bytes), in parallel byte ranges.

    Returns page_id, url, record_type, payload (null for a revisit), payload_bytes,
    payload_digest and refers_to. A payload that does not match its digest is an error.
    """
    last = F.greatest(F.ceil(F.col("n_bytes") / split_bytes) - 1, F.lit(0))
    ranges = files.select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")
    )
    # rows are tiny but each stands for split_bytes of reading, so the number of tasks is given:
    # else adaptive execution would merge them all into one
    spark = files.sparkSession
    n, size = files.agg(F.sum(last + 1), F.sum("n_bytes")).first()
    tasks = min(n or 1, max(2 * spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES))
    ranges = ranges.repartition(max(int(tasks), 1))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                start = row["k"] * split_bytes
                with store.open_input_file(path) as file:
                    held, volume = [], 0
                    for _, content in members(file, row["n_bytes"], start, start + split_bytes):
                        held.append(record(content))
                        volume += len(content)
                        if volume > 8 << 20:
                            yield _records(held)
                            held, volume = [], 0
                    yield _records(held)

    return ranges.mapInArrow(run, RECORD_SCHEMA)


RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload string, payload_bytes long, "
    "payload_digest string, refers_to long"
)
RECORD_TYPES = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()),
])


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=RECORD_TYPES)


def record(content: bytes) -> dict:
    headers, block = parse(content)
    kind = headers["warc-type"]
    digest = headers["warc-payload-digest"].partition(":")[2]
    size = int(headers["warc-payload-length"])
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    refers_to = headers.get("warc-refers-to")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
        "record_type": kind, "payload": None if payload is None else payload.decode("utf-8"),
        "payload_bytes": size, "payload_digest": digest,
        "refers_to": None if refers_to is None else page_of(refers_to),
    }
