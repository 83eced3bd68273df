"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are ranked by their frequency over all documents, so that the frequent ones take one data byte. Each control byte holds
four 2-bit fields, the byte lengths less one of the next four values; the data bytes follow in a stream of their own. A numpy
table of 256 rows gives the lengths for every control byte at once when a file is decoded.

File (little-endian): ``IDSV0001``, u64 documents, u64 ids, u64 data bytes, ranks' table size as u64, the table as u32 (rank to
id), the documents' ids as i64 and a byte for each (0: null), their lengths as u32, control bytes, data bytes. One file holds a range of document ids in ascending order,
of ``file_bytes`` of text and 16 bytes a document or about that, so that a file can be held whole by the task that writes or reads it.

Defined cases: null and empty texts are the end id alone; null ids come first; repeated rows are written each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import lean, shuffle_partitions, stored, workspace
from lexvane.llm.files import filesystem
from lexvane.llm.tokens import encoder, ragged

MAGIC = b"IDSV0001"
#: Lengths of four values for each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    n = len(values)
    padded = np.zeros(-(-n // 4) * 4, "<u4")
    padded[:n] = values
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = ((size - 1).reshape(-1, 4).astype(np.uint8) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4) < size[:n, None]
    return control.tobytes(), padded[:n].view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(size > k)
        if len(wide):
            out[wide] |= data[start[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(stream, doc_ids: list[int | None], lengths: np.ndarray, chunks: Iterator[np.ndarray], id_of_rank: np.ndarray, rank_of_id: np.ndarray) -> int:
    controls, datas, carry = [], [], np.zeros(0, np.uint32)
    for ids in chunks:
        ranks = np.concatenate([carry, rank_of_id[ids]])
        whole = len(ranks) // 4 * 4
        c, d = encode_values(ranks[:whole])
        controls.append(c)
        datas.append(d)
        carry = ranks[whole:]
    c, d = encode_values(carry)
    data = b"".join([*datas, d])
    stream.write(MAGIC + np.array([len(lengths), int(lengths.sum()), len(data), len(id_of_rank)], "<u8").tobytes())
    known = np.array([i is not None for i in doc_ids], np.uint8)
    plain = np.array([i or 0 for i in doc_ids], "<i8")
    for part in (id_of_rank.astype("<u4").tobytes(), plain.tobytes(), known.tobytes(), lengths.astype("<u4").tobytes(), b"".join([*controls, c]), data):
        stream.write(part)
    return len(data)


def read_file(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids and lengths of the documents, and all token ids."""
    if blob[:8] != MAGIC:
        raise ValueError("not an id file")
    docs, ids, data_bytes, ranks = (int(x) for x in np.frombuffer(blob, "<u8", 4, 8))
    at = 40
    table = np.frombuffer(blob, "<u4", ranks, at)
    plain = np.frombuffer(blob, "<i8", docs, at := at + 4 * ranks)
    known = np.frombuffer(blob, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(blob, "<u4", docs, at := at + docs)
    control = np.frombuffer(blob, np.uint8, -(-ids // 4), at := at + 4 * docs)
    data = np.frombuffer(blob, np.uint8, data_bytes, at + len(control))
    out = np.empty(ids, np.uint32)
    # Values are decoded in blocks to keep the index arrays small; a block's data bytes follow from its control bytes.
    block, used = 1 << 20, 0
    for k in range(0, ids, block):
        n = min(block, ids - k)
        c = control[k // 4 : -(-(k + n) // 4)]
        size = int(_LENGTHS[c].reshape(-1)[:n].sum())
        out[k : k + n] = table[decode_values(c, data[used : used + size], n)]
        used += size
    return pa.array(plain, mask=known == 0), lengths.astype(np.int64), out


#: Bytes that a document counts for besides its text.
_ROW_BYTES = 16
_ROWS = ["part", "path", "ids", "counts", "doc_ids", "lengths"]


def _provisional(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Ids of a range of documents to a file of plain 16- or 32-bit numbers, and a row for the file."""
    enc, part = encoder(tokenizer), TaskContext.get().partitionId()
    fs, base = filesystem(folder)
    size = max(enc.size, end_id + 1)
    counts, kind = np.zeros(size, np.int64), np.dtype("<u2" if size <= 1 << 16 else "<u4")
    stream, path, docs, lengths = None, f"{base}/ids-{part:06d}-{uuid.uuid4().hex[:8]}", [], []
    for b in batches:
        if stream is None:
            fs.create_dir(base, recursive=True)
            stream = pa.CompressedOutputStream(fs.open_output_stream(path, compression=None), "zstd")
        docs += b.column(0).to_pylist()
        for at, ids, offs in enc.encode(b.column(1)):
            n = len(offs) - 1
            lens = np.diff(offs) + 1
            out = np.full(int(lens.sum()), end_id, kind)
            out[ragged(np.cumsum(lens) - lens, lens - 1)] = ids
            counts += np.bincount(out, minlength=size)
            stream.write(out.tobytes())
            lengths.append(lens)
    if stream is not None:
        stream.close()
        seen = np.flatnonzero(counts)
        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((seen.astype(np.int32), pa.int32()), (counts[seen], pa.int64()), (docs, pa.int64()), (np.concatenate(lengths), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), *lists], _ROWS)


def _final(batches: Iterator[pa.RecordBatch], folder: str, ranks: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rewrite provisional files with ranked ids. A new attempt writes a new name, and only names in the result are read."""
    fs, base = filesystem(folder)
    rank_of_id = np.zeros(width, np.uint32)
    rank_of_id[ranks] = np.arange(len(ranks), dtype=np.uint32)
    kind = np.dtype("<u2" if width <= 1 << 16 else "<u4")
    for b in batches:
        for part, path, docs, lengths in zip(*[b.column(k).to_pylist() for k in range(3)], (np.asarray(x.values) for x in b.column(3)), strict=True):
            out = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:8]}.idsv"

            def chunks(path=path):
                with pa.CompressedInputStream(fs.open_input_stream(path, compression=None), "zstd") as src:
                    while piece := src.read(kind.itemsize << 21):
                        yield np.frombuffer(piece, kind)

            with fs.open_output_stream(out, compression=None) as dst:
                write_file(dst, docs, lengths, chunks(), ranks, rank_of_id)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out]), pa.array([int(lengths.sum())], pa.int64())], ["part", "path", "n_ids"])


def _read_back(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, _ = filesystem(folder)
    for b in batches:
        for path, before in zip(*[b.column(k).to_pylist() for k in range(2)], strict=True):
            with fs.open_input_stream(path, compression=None) as src:
                docs, lengths, ids = read_file(src.read())
            upto = np.concatenate([[0], np.cumsum(lengths)])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(before + upto[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for ids, counts in zip(b.column(0), b.column(1), strict=True):
            i = ids.values.to_numpy()
            if len(i) and i[-1] >= len(total):
                total = np.concatenate([total, np.zeros(i[-1] + 1 - len(total), np.int64)])
            total[i] += counts.values.to_numpy()
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[seen]], pa.list_(pa.int64()))], ["ids", "counts"])


def _ranks(tables: DataFrame, fan: int = 64) -> np.ndarray:
    """All ids by descending frequency. Tables of counts are added up ``fan`` at a time until at most ``fan`` are left for the driver, each no larger than the vocabulary."""
    while (n := tables.count()) > fan:
        tables = stored(tables.repartition(-(-n // fan)).mapInArrow(_add_up, "ids array<int>, counts array<long>"), "id-counts")
    total: Counter = Counter()
    for r in tables.toLocalIterator():
        for i, c in zip(r["ids"], r["counts"], strict=True):
            total[i] += c
    return np.array(sorted(total, key=lambda i: (-total[i], i)), np.int64)


def write_id_files(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_bytes: int = 128 << 20) -> DataFrame:
    """Write the files, in ascending order of the (integer) id. Returns a row for each file, in order: path, n_ids, ids_before."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # A document has an id, a length and an end id, even without a text.
    size = src.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + _ROW_BYTES), F.lit(0))).first()[0]
    n_files = max(shuffle_partitions(spark), -(-size // file_bytes))
    # The row's number parts repeats of one row; rows of one id and text may stand in any order.
    ranged = src.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(n_files, "id", F.xxhash64("t"), "r").sortWithinPartitions("id", "t").drop("r")
    rows = stored(ranged.mapInArrow(lambda it: lean(_provisional(it, tokenizer, end_id, folder)), "part int, path string, ids array<int>, counts array<long>, doc_ids array<long>, lengths array<long>"), "id-rows")
    ranks = _ranks(rows.select("ids", "counts"))
    width = max(encoder(tokenizer).size, end_id + 1)
    todo = rows.select("part", "path", "doc_ids", "lengths").repartition(shuffle_partitions(spark), "part")
    files = stored(todo.mapInArrow(lambda it: lean(_final(it, folder, ranks, width)), "part int, path string, n_ids long"), "id-parts")
    fs, _ = filesystem(folder)
    before, listing = 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):  # one row a file
        listing.append((r["path"], r["n_ids"], before))
        before += r["n_ids"]
    for r in rows.select("path").collect():
        fs.delete_file(r["path"])
    return spark.createDataFrame(listing, "path string, n_ids long, ids_before long")


def read_id_files(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document of the files: id, start, n_tokens, ids_crc32."""
    spread = files.select("path", "ids_before").repartition(shuffle_partitions(files.sparkSession), "path")
    return spread.mapInArrow(lambda it: lean(_read_back(it, folder)), "id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write the files and read them back: id, start, n_tokens, ids_crc32."""
    folder = workspace(df.sparkSession, "id-files")
    return read_id_files(write_id_files(df, tokenizer, folder, id_col, text_col, end_id), folder).withColumnRenamed("id", id_col)
