"""WARC archives: a writer of one compressed member a record, and a salvage reader.

The reader checks every member (its checksum, the record's syntax, length and block digest). After a
failed check it searches for the next valid member or version line, goes on there, and logs the byte
gap. Of a member that is damaged or cut off it keeps the records that passed before the damage, and inside
a member it searches the inflated bytes for the next version line; so damage costs the records it touches
and, in a member whose compressed bytes are damaged, those behind it.

Records with equal payloads: that of the largest page id is a response, the others are revisits of it.
A null html is an empty payload; a null url is left out; a record without a page id revisits if another
holds its payload, else it is a response. Repeated rows are records of their own. An empty table makes
no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import shared

VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEW = 100_000
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
STEP = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record; refers_to makes it a revisit of that page."""
    sha = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id, url, sha)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("X-Refers-To-Page", refers_to)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    start: int

    @property
    def payload(self) -> bytes | None:
        """What a response holds; a revisit holds none."""
        if self.headers["warc-type"] == "revisit":
            return None
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The plain record at `at` and where it ends, or what is wrong with it."""
    if not _LINE.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers don't end"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return "a header without a colon"
        headers[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return "no length or type"
    begin = end + 4
    stop = begin + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "the block's end isn't where its length says"
    block = data[begin:stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        return "the block's digest differs"
    found = Record(headers, block, at)
    want = headers.get("warc-payload-digest", "")
    if found.payload is not None and want.startswith("sha1:") and want[5:] != digest(found.payload):
        return "the payload's digest differs"
    return found, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the member at `at` holds, where it ends (None if it is damaged or cut off), and what is wrong."""
    inflate, plain = zlib.decompressobj(31), []
    for i in range(at, len(data), STEP):
        before = inflate.copy()
        try:
            plain.append(inflate.decompress(data[i : i + STEP]))
        except zlib.error as e:
            # byte by byte up to the damage
            try:
                for j in range(i, min(i + STEP, len(data))):
                    plain.append(before.decompress(data[j : j + 1]))
            except zlib.error:
                pass
            return b"".join(plain), None, f"the member is damaged ({e})"
        if inflate.eof:
            return b"".join(plain), min(i + STEP, len(data)) - len(inflate.unused_data), ""
    return b"".join(plain), None, "the member is cut off"


def _records(text: bytes, start: int) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The records in a member's inflated bytes, and the stretches between version lines that hold none."""
    out, gaps, pos, lost, reason = [], [], 0, None, ""
    while pos < len(text):
        got = _parse(text, pos)
        if isinstance(got, str):
            if lost is None:
                lost, reason = pos, got
            line = _LINE.search(text, pos + 1)
            pos = line.start() if line else len(text)
            continue
        if lost is not None:
            gaps.append((lost, pos, reason))
            lost = None
        out.append(got[0]._replace(start=start))
        pos = got[1]
    if lost is not None:
        gaps.append((lost, len(text), reason))
    return out, gaps


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    """Every record that passes its checks, and the byte ranges that lost something.

    A gap inside a sound member spans the member; its reason names the inflated bytes.
    """
    records: list[Record] = []
    gaps: list[Gap] = []
    at, lost, reason = 0, None, ""
    while at < len(data):
        inner: list[tuple[int, int, str]] = []
        if data[at : at + 2] == b"\x1f\x8b":
            text, end, wrong = _inflate(data, at)
            found, inner = _records(text, at)
            if end is None and found:
                wrong = f"{wrong}, after {len(found)} records"
        else:
            got = _parse(data, at)
            found, end, wrong = ([], None, got) if isinstance(got, str) else ([got[0]], got[1], "")
        if end is None:
            records += found
            if lost is None:
                lost, reason = at, wrong
            elif found:
                gaps.append(Gap(lost, at, reason))
                lost, reason = at, wrong
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if lost is not None:
            gaps.append(Gap(lost, at, reason))
            lost = None
        records += found
        gaps += [Gap(at, end, f"{why} (bytes {i} to {j} of the member)") for i, j, why in inner]
        at = end
    if lost is not None:
        gaps.append(Gap(lost, len(data), reason))
    return records, gaps


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 8 << 20, level: int = 1) -> DataFrame:
    """Writes one record for each page into archives of about archive_bytes; returns their manifest (path, records, bytes).

    Archives are named after the task's attempt, and the manifest holds those of the attempt that won, so
    tasks may be run again; `read_listed` reads no others.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    same = shared.keep(rows.groupBy("sha").agg(F.max("page").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null").select("sha", "winner"), "warc-same")
    rows = rows.join(F.broadcast(same) if same.count() <= FEW else same, "sha", "left").drop("sha")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        task = TaskContext.get()
        seq, held, n, size, made = 0, [], 0, 0, []

        def close() -> None:
            nonlocal seq, held, n, size
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.warc.gz"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:  # members are compressed already
                for x in held:
                    f.write(x)
            made.append((name, n, size))
            seq, held, n, size = seq + 1, [], 0, 0

        for batch in batches:
            for page, url, text, winner in zip(*(batch.column(c) for c in ("page", "url", "html", "winner")), strict=True):
                page, winner = page.as_py(), winner.as_py()
                x = member(record(page, url.as_py(), text.as_py().encode(), winner if winner is not None and winner != page else None), level)
                held.append(x)
                n, size = n + 1, size + len(x)
                if size >= archive_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return shared.keep(rows.select("page", "url", "html", "winner").mapInArrow(put, "path string, records long, bytes long"), "warc-manifest")


FOUND = "path string, start long, kind string, end long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _rows(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """The records and gaps of one archive, as FOUND has them."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in FOUND.split(", ")]
    number = lambda h, k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
    records, gaps = salvage(data)
    rows = []
    for r in records:
        h, body = r.headers, r.payload
        rows.append((name, r.start, "record", None, None, number(h, "x-page-id"), h.get("warc-target-uri"), h["warc-type"], number(h, "x-payload-length") if body is None else len(body), h.get("warc-payload-digest", "sha1:").removeprefix("sha1:"), number(h, "x-refers-to-page"), body))
    rows += [(name, g.start, "gap", g.end, g.reason, *[None] * 7) for g in gaps]
    for i in range(0, len(rows), 500):
        part = list(zip(*rows[i : i + 500], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds, strict=True)], names)


def read(spark: SparkSession, path: str, pattern: str = "*.warc.gz") -> DataFrame:
    """The records and gaps of a folder's archives (each below 2 GB): path, start, kind (record or gap), end, reason, and the record's fields."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from _rows(name.as_py(), content.as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(take, FOUND)


def read_listed(manifest: DataFrame, folder: str, *, whole: bool = True) -> DataFrame:
    """The records and gaps of the archives that a manifest lists; with `whole` a gap or a missing record is an error."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    data = f.read()
                seen = 0
                for rows in _rows(name, data):
                    seen += rows.num_rows - (lost := rows.column("end").is_valid().to_pylist().count(True))
                    if whole and lost:
                        raise ValueError(f"{name} is damaged: {rows.column('reason').drop_null()[0]}")
                    yield rows
                if whole and seen != records:
                    raise ValueError(f"{name} holds {seen} records of {records}")

    listed = manifest.count()
    parts = max(1, min(listed, 100_000))
    return manifest.select("path", "records").repartition(parts).mapInArrow(take, FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives in the shared folder and reads them back, without payloads; damage is an error."""
    folder = shared.folder(pages.sparkSession, "warc")
    manifest = write(pages, folder)
    return read_listed(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
