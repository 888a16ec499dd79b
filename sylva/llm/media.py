"""Media columns: lossless sample payloads, stored as content-defined chunks.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the
8-bit samples of a mono WAV file. The file is cut where a rolling gear hash over
the last 16 bytes has its low bits zero, so equal passages give equal chunks.
Chunk digests are counted in Spark: a chunk that occurs once stays inline in its
document's row; one that occurs more often is stored once, by its first owner
(smallest document key and position). Reading joins the ordered chunk lists with the
shared chunks, puts each file together and verifies it against its digest.

Documents are joined with the digests they share; Spark sends the smaller side to
all executors only up to ``max_broadcast`` bytes, measured first, and shuffles both beyond.

Null texts count as empty (one block of padding). Texts of any length are one
payload. Repeated rows are media of their own; equal texts share all chunks. An empty
table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import arrow_map, discard, written

BLOCK = 576
HEADER = 44


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    size = max(1, -(-len(data) // BLOCK)) * BLOCK
    return data + b"\xff" * (size - len(data))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data" or len(media) != HEADER + size:
        raise ValueError("not a WAV file of this form")
    return media[HEADER:]


def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), dtype="<u4")


GEAR = _gear()


def cut_points(data: bytes, mean_bits: int = 11, least: int = 512, most: int = 16384) -> list[int]:
    """Ends of the chunks. The hash at i depends on the 16 bytes up to i only."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))  # the right side is read before it is written
    marks = np.flatnonzero((h >> np.uint32(3)) & np.uint32((1 << mean_bits) - 1) == 0) + 1
    cuts, last = [], 0
    for m in [*marks.tolist(), len(data)]:
        while m - last > most:
            last += most
            cuts.append(last)
        if m - last >= least or (m == len(data) and m > last):
            last = m
            cuts.append(m)
    return cuts


def chunks_of(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    out, last = [], 0
    for c in cut_points(media):
        out.append((hashlib.blake2b(media[last:c], digest_size=16).digest(), media[last:c]))
        last = c
    return out


def features(payload: bytes) -> str:
    """Sum, sum of squares, and zero crossings around 128 of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    s = x - 128
    return f"n={len(x)};sum={int(x.sum())};energy={int((s * s).sum())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def _keyed(docs: DataFrame) -> DataFrame:
    """The row's key: digest of id and text. Rows that agree in both are alike in all results."""
    return docs.select("doc_id", "text", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\u0001"), F.coalesce("text", F.lit("")))).alias("key"))


def store_media(docs: DataFrame, max_broadcast: int = 64 << 20) -> DataFrame:
    """Write the media of all documents and return the store.

    A store row is a document (kind 0: key, doc_id, n_bytes, media_bytes, media_sha256,
    and ``chunks``: in order, either inline bytes or the digest of a shared chunk) or
    a shared chunk (kind 1: digest, data).
    """
    d = _keyed(docs)

    def digests(batches):
        for b in batches:
            keys, pos, digest = [], [], []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = chunks_of(to_wav(payload_of(text)))
                keys += [key] * len(found)
                pos += range(len(found))
                digest += [x for x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pos, pa.int32()), pa.array(digest, pa.binary())], ["key", "pos", "digest"])

    each = written(arrow_map(d.select("key", "text"), digests, "key string, pos int, digest binary"), "media-digests")
    shared = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("owner")).where("n > 1").select("digest", "owner")
    own = each.join(shared, "digest").select("key", "digest", (F.struct("key", "pos") == F.col("owner")).alias("own"))
    marks = written(own.groupBy("key", "digest").agg(F.max("own").alias("own")).groupBy("key").agg(F.collect_list(F.struct("digest", "own")).alias("marks")), "media-marks")
    size = marks.agg(F.sum(F.lit(120) + F.lit(64) * F.size("marks"))).collect()[0][0] or 0  # bytes in memory
    marked = d.join(F.broadcast(marks) if size <= max_broadcast else marks, "key", "left")

    def run(batches):
        names = ["kind", "key", "doc_id", "n_bytes", "media_bytes", "media_sha256", "chunks", "digest", "data"]
        chunk = pa.struct([("inline", pa.binary()), ("digest", pa.binary())])
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(chunk), pa.binary(), pa.binary()]
        stored = set()  # copies of an owner's row in this task write its chunks once; readers drop further ones
        for b in batches:
            rows = []
            for key, doc_id, text, marks in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text", "marks")), strict=True):
                media = to_wav(payload_of(text))
                marks = {m["digest"]: m["own"] for m in marks or []}
                chunks = []
                for digest, data in chunks_of(media):
                    if digest not in marks:
                        chunks.append({"inline": data, "digest": None})
                        continue
                    chunks.append({"inline": None, "digest": digest})
                    if marks[digest] and digest not in stored:
                        stored.add(digest)
                        rows.append((1, None, None, None, None, None, None, digest, data))
                rows.append((0, key, doc_id, len((text or "").encode()), len(media), hashlib.sha256(media).hexdigest(), chunks, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "kind int, key string, doc_id long, n_bytes long, media_bytes long, media_sha256 string, chunks array<struct<inline:binary,digest:binary>>, digest binary, data binary"
    session = d.sparkSession
    before = session.conf.get("spark.sql.parquet.compression.codec")
    session.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        return written(arrow_map(marked.select("key", "doc_id", "text", "marks"), run, schema), "media-store")
    finally:
        discard(each, marks)
        session.conf.set("spark.sql.parquet.compression.codec", before)


def read_media(store: DataFrame) -> DataFrame:
    """Documents with their shared chunks: all columns of kind 0, and ``shared`` (digest, data) for each digest the document uses.

    Only documents that use shared chunks pass a shuffle. Copies with equal key are
    put together once and joined back by key.
    """
    docs = store.where("kind = 0").drop("kind", "digest", "data")
    uses = F.exists("chunks", lambda c: c["digest"].isNotNull())
    empty = F.array().cast("array<struct<digest:binary,data:binary>>")
    chunks = store.where("kind = 1").groupBy("digest").agg(F.first("data").alias("data"))
    needs = docs.where(uses).select("key", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["digest"].isNotNull()), lambda c: c["digest"]))).alias("digest"))
    found = needs.dropDuplicates(["key", "digest"]).join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("shared"))
    joined = docs.where(uses).join(found, "key", "left")
    return docs.where(~uses).withColumn("shared", empty).unionByName(joined)


def media_digests(docs: DataFrame, **params) -> DataFrame:
    """Store all documents, read everything back, verify, and describe what was read."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                shared = {x["digest"]: x["data"] for x in r["shared"] or []}
                media = b"".join(shared[c["digest"]] if c["inline"] is None else c["inline"] for c in r["chunks"])
                digest = hashlib.sha256(media).hexdigest()
                if digest != r["media_sha256"]:
                    raise ValueError(f"the media of document {r['doc_id']} differ from what was stored")
                p = from_wav(media)
                rows.append((r["doc_id"], r["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), digest, features(p), len(r["chunks"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    return arrow_map(read_media(store_media(docs, **params)), run, schema)
