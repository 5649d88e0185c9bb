"""WARC archives with revisit records, and capture histories merged from sorted runs.

Writing: of pages with equal payloads the one with the largest id is a response
record with the payload; the others are revisit records without it. Which is which is
decided on digests alone; payloads are not dealt by key, so a payload that a third of all
pages have is written once, and its revisits come from narrow rows in even parts. A task
writes archives of gzip members, one a record and RECORDS at most a file, to the shared
folder; a file gets its name when it is whole, and only files of successful tasks are
listed, so a lost executor leaves nothing that is read.

Reading: each listed archive is parsed by one task, record by record; digests are
computed again from the payloads. Its captures, sorted by URL key, time and id, are
a run. Runs are dealt by key ranges of a bounded size, a hot URL over several since
time and id are part of the key; in each range a loser tree merges the pieces of
the runs, and ranges in order are the capture history of all archives.

Defined results: null payloads count as empty; a null or empty URL sorts first; a
page with a null id is a response if no other page has its payload, else revisits
that with the largest id; a long payload is held by one task; rows repeated with the same id and payload are each a
response if theirs is the largest id; an empty table gives no rows; other columns
are ignored. The input is read twice and must give the same rows in the same partitions,
as a stored table does.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_among, shared_path, split_join, stored, unique_rows

EPOCH = "2024-01-01 00:00:00"
RANGE_ROWS, RECORDS = 100_000, 50_000
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, lower-cased: the key by which captures are sorted."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower() if host else (url or "").lower()


def warc_record(kind: str, page_id: int | None, url: str | None, date: str, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One record. The HTTP header of a revisit tells the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + _END + block + _END


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///") if path.startswith("file:/") else f"file://{path}")


def _decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(responses with their payload, revisits without): page_id, url, payload, n, sha1, response_id."""
    rows = unique_rows(pages, id_col, url_col, payload_col).select("rid", F.col("doc_id").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    narrow = stored(rows.select("rid", "page_id", "url", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha")), "warc-digests")
    groups = narrow.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1").select("sha", "response_id")
    again = split_join(narrow, groups, "sha").where("page_id is null or page_id <> response_id").where("response_id is not null")
    again = stored(again.select("rid", "page_id", "url", "n", "sha1", "response_id"), "warc-revisits")
    first = rows_among(rows, "rid", again.select("rid"), among=False)
    none = lambda kind: F.lit(None).cast(kind)
    return first.select("page_id", "url", "payload", F.octet_length("payload").alias("n"), none("string").alias("sha1"), none("long").alias("response_id")), again.select("page_id", "url", none("binary").alias("payload"), "n", "sha1", "response_id")


def write_warcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, records: int = RECORDS) -> DataFrame:
    """Write the archives; returns their list: path, records."""
    spark = pages.sparkSession
    root = shared_path(spark, "warc")
    seconds = F.unix_timestamp(F.lit(EPOCH)) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31))
    dated = lambda rows: rows.withColumn("date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def run(batches):
        files, base = _fs(root)
        out, name, n = None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            files.move(f"{base}/.{name}", f"{base}/{name}.warc.gz")
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}.warc.gz"]), pa.array([n], pa.int64())], ["path", "records"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, size, sha1, response, date = (b.column(k)[i].as_py() for k in range(7))
                kind = "response" if payload is not None else "revisit"
                digest = base32_sha1(payload) if payload is not None else base64.b32encode(bytes.fromhex(sha1)).decode()
                record = warc_record(kind, page_id, url, date, payload or b"", size, digest, response)
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = uuid.uuid4().hex
                    out = files.open_output_stream(f"{base}/.{name}", compression=None)
                out.write(gzip.compress(record, 6, mtime=0))
                n += 1
                if n == records:
                    yield closed()
                    out, n = None, 0
        if out is not None:
            yield closed()

    lists = [dated(rows).select("page_id", "url", "payload", "n", "sha1", "response_id", "date").mapInArrow(run, "path string, records long") for rows in _decided(pages, id_col, url_col, payload_col, min_bytes)]
    return stored(lists[0].union(lists[1]), "warc-list")


class _Members:
    """A readable stream over gzip members that are fetched in blocks."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.buffer, self.at = raw, block, b"", 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = data or self.raw.read(self.block)
        if not data:
            return False
        self.buffer, self.at = self.buffer[self.at :] + self.inflate.decompress(data), 0
        return True

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        line, self.at = self.buffer[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        parts, have = [self.buffer[self.at : self.at + n]], min(n, len(self.buffer) - self.at)
        self.at += have
        while have < n:
            if not self._more():
                break
            take = min(n - have, len(self.buffer))
            parts.append(self.buffer[:take])
            self.at, have = take, have + take
        return b"".join(parts)


_CAPTURE = "run string, url_key string, warc_date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = [x.split(" ")[0] for x in _CAPTURE.split(", ")]


def _page(urn: str | None) -> int | None:
    found = (urn or "").rpartition(":")[2].rstrip(">")
    return None if found in ("", "null") else int(found)


def _capture(run: str, headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(_END)
    length = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload does not match its digest")
    return run, url_key(headers.get("warc-target-uri")), headers["warc-date"], _page(headers["warc-record-id"]), length, digest, headers["warc-type"], _page(headers.get("warc-refers-to"))


def _order(c: tuple) -> tuple:
    return c[1], c[2], c[3] is not None, c[3] or 0


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Read the archives back: the captures of each, sorted, as its run."""
    n = max(1, archives.count())

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, at = _fs(path)
                with files.open_input_stream(at, compression=None) as raw:
                    found = sorted((_capture(path, *r) for r in read_records(_Members(raw))), key=_order)
                for lo in range(0, len(found), 10_000):
                    yield _table(found[lo : lo + 10_000])

    return archives.select("path").repartition(n).mapInArrow(run, _CAPTURE)


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterable[tuple]], key=_order):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.nodes = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or kx == ky and a < b

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.nodes[node]
            if other < 0:  # while the tree is built, the first to come waits here
                self.nodes[node] = winner
                return
            if self._beats(other, winner):
                self.nodes[node], winner = winner, other
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.nodes[0]] is not None:
            own = self.nodes[0]
            yield self.heads[own]
            self.heads[own] = next(self.runs[own], None)
            self._play(own)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture history of all runs: partitions are key ranges in order, rows in order inside."""
    runs = stored(runs, "capture-runs")
    parts = max(1, -(-runs.count() // range_rows), runs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        by_run: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_run.setdefault(row[0], []).append(row)
        pieces = []
        for name in sorted(by_run):
            piece = by_run[name]
            if any(_order(x) > _order(y) for x, y in zip(piece, piece[1:])):  # blocks of a run may arrive out of turn
                piece.sort(key=_order)
            pieces.append(piece)
        out = []
        for row in LoserTree(pieces):
            out.append(row)
            if len(out) == 10_000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return runs.repartitionByRange(parts, "url_key", "warc_date", F.col("page_id").asc_nulls_first()).mapInArrow(run, _CAPTURE)


def capture_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write, read back and merge: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, warc_date."""
    archives = write_warcs(pages, id_col, url_col, payload_col, min_bytes)
    return merge_runs(capture_runs(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date")
