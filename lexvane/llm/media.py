"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the 8-bit samples of a grey PNG image 576 wide. Each
writing task makes one tar shard in the shared folder; a member is named by the SHA-256 of its payload and stored once per
shard. Rows carry digest, shard, offset and length. The catalogue then keeps one place for each digest, header-only range reads
of 33 bytes fill the width, height and bit depth, and whole range reads give the payload for features.

A shard's name is new for each attempt of a task and only names in the catalogue are read, so lost executors leave no half shards.

Defined cases: a null or empty text is one row of 576 bytes 255; texts of any length are stored whole; equal texts have equal
values; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexvane.llm.common import shuffle_partitions, stored, unused_name, workspace
from lexvane.llm.files import filesystem

WIDTH, PAD = 576, 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER = 33


def payload_of(raw: bytes) -> bytes:
    """``raw`` with bytes 255 after it, up to a positive multiple of the width."""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG, unfiltered rows of WIDTH samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_header(blob: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first 33 bytes."""
    if blob[:8] != _SIGNATURE or blob[12:16] != b"IHDR":
        raise ValueError("not an image header")
    return struct.unpack(">IIB", blob[16:25])


def decode_image(blob: bytes) -> bytes:
    width, height, _ = read_header(blob)
    at, data = 8, []
    while at < len(blob):
        (n,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and the share of each eighth of the value range, of the whole payload."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float(share @ np.arange(256))
    spread = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
    seen = share[share > 0]
    return f"mean={mean:.4f};sd={spread:.4f};entropy={float(-(seen * np.log2(seen)).sum()) + 0.0:.4f};bands=" + ",".join(f"{x:.4f}" for x in share.reshape(8, 32).sum(axis=1))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = filesystem(folder)
    path = f"{base}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.tar"
    stream, at, places = None, 0, {}
    for b in batches:
        if stream is None:
            fs.create_dir(base, recursive=True)
            stream = fs.open_output_stream(path, compression=None)
        rows: list[list] = [[], [], [], [], []]
        for text in b.column(1):
            raw = text.as_buffer()
            payload = payload_of(raw.to_pybytes() if raw is not None else b"")
            digest = hashlib.sha256(payload).hexdigest()
            if digest not in places:
                image = encode_image(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(image)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                stream.write(head + image + b"\0" * (-len(image) % tarfile.BLOCKSIZE))
                places[digest] = (at + len(head), len(image))
                at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
            for col, v in zip(rows, (digest, len(raw) if raw is not None else 0, len(payload), *places[digest]), strict=True):
                col.append(v)
        n = len(rows[0])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.string()), *[pa.array(c, pa.int64()) for c in rows[1:3]], pa.array([path] * n, pa.string()), *[pa.array(c, pa.int64()) for c in rows[3:]]], ["id", "digest", "n_bytes", "payload_bytes", "shard", "offset", "length"])
    if stream is not None:
        stream.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        stream.close()


def _opened(batches: Iterator[pa.RecordBatch], folder: str):
    """Each row's values with its shard held open for range reads; rows come sorted by shard."""
    fs, _ = filesystem(folder)
    name, src = None, None
    for b in batches:
        out, done = [], []
        for digest, shard, offset, length in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            if shard != name:
                done.append(src)
                name, src = shard, fs.open_input_file(shard)
            out.append((digest, src, offset, length))
        yield b, out
        for x in filter(None, done):
            x.close()


def _headers(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b, rows in _opened(batches, folder):
        found = [read_header(src.read_at(_HEADER, offset)) for _, src, offset, _ in rows]
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[k] for x in found], pa.int32()) for k in range(3)]], ["digest", "shard", "offset", "length", "width", "height", "bit_depth"])


def _contents(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b, rows in _opened(batches, folder):
        out: list[list] = [[], [], []]
        for digest, src, offset, length in rows:
            image = src.read_at(length, offset)
            payload = decode_image(image)
            found = hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{digest}: the stored bytes have another digest")
            for col, v in zip(out, (zlib.crc32(payload[-32:]), hashlib.sha256(image).hexdigest(), feature_of(payload)), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*b.schema.names, "tail_crc32", "media_sha256", "feature"])


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the shards. Returns a row for each row of ``df``: id, digest, n_bytes, payload_bytes, shard, offset, length."""
    folder = folder or workspace(df.sparkSession, "media")
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lambda it: _write(it, folder), f"id {kind}, digest string, n_bytes long, payload_bytes long, shard string, offset long, length long")
    return stored(out, "media-rows")


def catalogue(rows: DataFrame) -> DataFrame:
    """One place for each digest, in shard order within each task."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    spark = rows.sparkSession
    return rows.groupBy("digest").agg(place).select("digest", "p.*").repartition(shuffle_partitions(spark), "shard", F.expr("offset div 16777216")).sortWithinPartitions("shard", "offset")


def fill_header_columns(places: DataFrame, folder: str) -> DataFrame:
    """Width, height and bit depth of each place, from its first bytes alone."""
    return places.select("digest", "shard", "offset", "length").mapInArrow(lambda it: _headers(it, folder), "digest string, shard string, offset long, length long, width int, height int, bit_depth int")


def read_contents(places: DataFrame, folder: str) -> DataFrame:
    """``places`` (digest, shard, offset and length first) with tail_crc32, media_sha256 and feature, from the bytes read back."""
    more = StructType().add("tail_crc32", "long").add("media_sha256", "string").add("feature", "string")
    return places.mapInArrow(lambda it: _contents(it, folder), StructType(places.schema.fields + more.fields))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: digests, places, sizes, header columns and features, read back from the shards."""
    folder = workspace(df.sparkSession, "media")
    rows = store_media(df, id_col, text_col, folder)
    found = stored(read_contents(fill_header_columns(catalogue(rows), folder), folder), "media-found")
    out = rows.select("id", "digest", "n_bytes", "payload_bytes").join(found, "digest")
    name = unused_name(out.drop("id"), id_col)
    return out.select(F.col("id").alias(name), "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height", "bit_depth")
