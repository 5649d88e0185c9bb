"""Media columns with content-defined payload chunks.

A row's payload is stored as a WAV file of 8-bit mono samples. The whole file, header
and samples, is cut by a gear rolling hash into chunks of about 1 KiB; a chunk is stored
once, under the digest of its bytes, and a medium is the ordered list of its chunks. To
read a medium back, its chunks are fetched by digest, put in order and verified
against the SHA-256 of the medium; the samples are those that its header announces.

Storing takes two passes over the payloads. The first makes digests only; Spark
joins tell which chunks stand in more than one medium, and which medium (the
smallest digest) lends each of them. The second writes a row per distinct medium
with the bytes of its own chunks, and a row per lent chunk. Media without shared
chunks that stand in one row only are written by the task that reads them; which
are not is told by a bitmap over SHA-256 prefixes of a fixed size (8 MiB), so a
false alarm only costs a shuffle. Equal payloads are one medium: a group of copies
of any size is stored, read and verified once, and its results are joined to its
rows.

Defined results: null and empty payloads count as 64 zero bytes; a long payload is held
by one task; rows with null
ids and repeated rows each give a row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, split_join, stored
from .gear import candidates, cut

UNIT, RATE = 64, 8000
BITS, LEAST, MOST = 10, 256, 8192
BITMAP_BUCKETS = 2048  # of 32,768 bits each: 8 MiB at most, whatever the input
_HEADER = 44


def padded(text: bytes | None) -> bytes:
    """The payload: zero bytes are appended up to a positive multiple of 64."""
    text = text or b""
    return text + b"\0" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def wav_header(size: int) -> bytes:
    """RIFF header of size 8-bit mono samples; payloads are of even length, so no padding byte follows."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + size) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size & 0xFFFFFFFF)


def wav_file(payload: bytes) -> bytes:
    return wav_header(len(payload)) + payload


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file of this writer; an error where header and length disagree."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this writer")
    size = len(media) - _HEADER
    if struct.unpack("<I", media[4:8])[0] != (36 + size) & 0xFFFFFFFF or struct.unpack("<I", media[40:44])[0] != size & 0xFFFFFFFF:
        raise ValueError("a WAV file is not as long as its header says")
    return media[_HEADER:]


def media_chunks(media: bytes) -> list[tuple[int, int]]:
    ends = cut(candidates(np.frombuffer(media, np.uint8), BITS).tolist(), len(media), LEAST, MOST)
    return list(zip([0, *ends], ends, strict=False))


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def features(samples: bytes) -> str:
    """Zero crossings about the middle, RMS and peak of the 8-bit samples, and the share of digits of silence (zero)."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    total, square, peak, silent, crossings, last = 0, 0, 0, 0, 0, 0
    for at in range(0, len(x), 1 << 20):
        p = x[at : at + (1 << 20)]
        total += int(p.sum())
        square += int((p * p).sum())
        peak = max(peak, int(np.abs(p).max()))
        silent += int((p == -128).sum())
        sign = np.concatenate([[last], np.where(p < 0, -1, 1)]) if last else np.where(p < 0, -1, 1)
        crossings += int((sign[1:] != sign[:-1]).sum())
        last = int(sign[-1])
    n = len(x)
    return f"n={n};mean={total / n:.6f};rms={(square / n) ** 0.5:.6f};peak={peak};zero={silent};crossings={crossings}"


def _rows(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(col).cast("binary").alias("body"))


def _describe(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    """First pass: one row per row with its medium and the ordered digests of its chunks."""
    rows = _rows(docs, id_col, col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, media, digests = [], [], []
            for body in b.column(1):
                body = body.as_py() or b""
                file = wav_file(padded(body))
                n.append(len(body))
                media.append(hashlib.sha256(file).digest())
                digests.append([_digest(file[s:e]) for s, e in media_chunks(file)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, digests array<binary>")


_STORE = "kind string, media binary, digests array<binary>, lengths array<int>, shared array<binary>, body binary"
_TYPES = [pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
_NAMES = ["kind", "media", "digests", "lengths", "shared", "body"]


def _packed(media: bytes, file: bytes, shared: set[bytes], lends: set[bytes]) -> Iterator[tuple]:
    """The medium's row, whose body has each of its own chunks once, and the chunks that it lends."""
    parts = [file[s:e] for s, e in media_chunks(file)]
    digests = [_digest(p) for p in parts]
    zip_ = zstandard.ZstdCompressor(level=3).compress
    own = {d: p for d, p in zip(digests, parts, strict=True) if d not in shared}
    yield "medium", media, digests, [len(p) for p in parts], sorted(shared), zip_(b"".join(own.values()))
    for d, p in dict(zip(digests, parts, strict=True)).items():
        if d in lends:
            yield "chunk", d, None, None, None, zip_(p)


def _unpacked(media: bytes, digests: list[bytes], lengths: list[int], chunks: dict[bytes, bytes], body: bytes) -> bytes:
    """The verified WAV file."""
    body, at, own = zstandard.ZstdDecompressor().decompress(body), 0, dict(chunks)
    out = []
    for d, n in zip(digests, lengths, strict=True):
        if d not in own:
            own[d] = body[at : at + n]
            at += n
        out.append(own[d])
    found = b"".join(out)
    if hashlib.sha256(found).digest() != media:
        raise ValueError(f"medium {media.hex()} does not match its digest")
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _bit(media: bytes) -> int:
    return int.from_bytes(media[:4], "big") % (BITMAP_BUCKETS * 32768)


def _special_bits(special: DataFrame) -> np.ndarray:
    """A bitmap of the media that need the long way; its size is fixed."""
    bit = F.conv(F.substring(F.hex("media"), 1, 8), 16, 10).cast("long") % (BITMAP_BUCKETS * 32768)
    found = special.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    out = np.zeros((BITMAP_BUCKETS, 4096), np.uint8)
    for row in found.toLocalIterator():
        out[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def store_media(docs: DataFrame, id_col: str = "doc_id", col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the chunk store; returns (rows, store), both read from the shared folder.

    rows: doc_id, n_bytes, media. store: a row per medium (kind "medium": ordered
    chunk digests and lengths, the shared ones among them, its own bytes) and a row
    per shared chunk (kind "chunk": digest, bytes).
    """
    spark = docs.sparkSession
    seen = stored(_describe(docs, id_col, col), "media-rows")
    media = seen.groupBy("media").agg(F.first("digests").alias("digests"), F.count("*").alias("n"))
    once = media.select("media", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = once.groupBy("digest").agg(F.min("media").alias("lender"), F.count("*").alias("n")).where("n > 1").select("digest", "lender")
    plans = split_join(once, shared, "digest").groupBy("media").agg(F.collect_list("digest").alias("shared"), F.collect_list(F.when(F.col("media") == F.col("lender"), F.col("digest"))).alias("lends"))  # of one medium
    special = stored(media.where("n > 1").select("media").join(plans, "media", "full_outer"), "media-special")
    bits = spark.sparkContext.broadcast(_special_bits(special))

    def split(batches, direct: bool) -> Iterator[pa.RecordBatch]:
        bitmap, zip_ = bits.value, zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            out = []
            for body in b.column(1):
                file = wav_file(padded(body.as_py()))
                sha = hashlib.sha256(file).digest()
                at = _bit(sha)
                if bool(bitmap[at >> 3] >> (at & 7) & 1) != direct:
                    out += _packed(sha, file, set(), set()) if direct else [(sha, zip_(file))]
            if out:
                yield _batch(out) if direct else pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["media", "file"])

    def write(df: DataFrame) -> None:
        df.write.mode("append").partitionBy("kind").option("compression", "uncompressed").parquet(path)  # bodies are compressed

    rows, path = _rows(docs, id_col, col), shared_path(spark, "media-store")
    write(rows.mapInArrow(lambda it: split(it, True), _STORE))
    long_way = rows.mapInArrow(lambda it: split(it, False), "media binary, file binary").groupBy("media").agg(F.first("file").alias("file"))

    def pack(batches):
        for b in batches:
            out = []
            for sha, file, own, lends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                out += _packed(sha, zstandard.ZstdDecompressor().decompress(file), set(own or ()), set(lends or ()))
            if out:
                yield _batch(out)

    write(long_way.join(special, "media", "left").select("media", "file", "shared", "lends").mapInArrow(pack, _STORE))
    return seen.select("doc_id", "n_bytes", "media"), spark.read.schema(_STORE).parquet(path)


_FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(store: DataFrame, with_file: bool = False) -> DataFrame:
    """Read every stored medium back, verify it and compute its features; with with_file its WAV file as column wav."""
    media = store.where("kind = 'medium'").select("media", "digests", "lengths", "shared", "body")
    none = F.array().cast("array<struct<digest:binary,body:binary>>")
    alone = media.where(F.size("shared") == 0).withColumn("chunks", none)
    needing = media.where(F.size("shared") > 0)
    wants = needing.select("media", F.explode("shared").alias("digest"))
    chunks = store.where("kind = 'chunk'").select(F.col("media").alias("digest"), F.col("body").alias("chunk"))
    lent = split_join(wants, chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", F.col("chunk").alias("body"))).alias("chunks"))  # of one medium
    cols = ["media", "digests", "lengths", "body", "chunks"]

    def run(batches):
        for b in batches:
            out = []
            for sha, digests, lengths, body, lent in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = _unpacked(sha, digests, lengths, {c["digest"]: zstandard.ZstdDecompressor().decompress(c["body"]) for c in lent}, body)
                samples = wav_samples(found)
                out.append((sha, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(found), sha.hex(), features(samples), *([found] if with_file else [])))
            if out:
                types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = [x.split(" ")[0] for x in _FEATURES.split(", ")] + ["wav"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names[: len(out[0])])

    both = alone.select(*cols).union(needing.join(lent, "media").select(*cols))
    return both.mapInArrow(run, _FEATURES + ", wav binary" * with_file)


def media_columns(docs: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Store, read back and describe: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    rows, store = store_media(docs, id_col, col)
    found = read_media(store)
    return split_join(rows, found, "media").select("doc_id", "n_bytes", *found.columns[1:])
