"""Hierarchical multi-length packing.

Every document is cut at multiples of the window; what is left over is routed to a tier by its length (256, 512, 1024 or 2048
tokens). Within a group of pieces the tiers are packed from the longest to the shortest: a piece opens a sequence of its tier's
size, and each gap takes the longest piece that fits from its own or a shorter tier. Sequences of each tier are then dealt to step
groups of that tier so that the groups' token counts are near equal. Lengths alone decide: token ids are never shuffled.

Pieces are grouped by a hash that takes in their row, ``group_pieces`` to a group, so that a packing task's size stays the same at
any size of input and however often a row is repeated.

Defined cases: a null or empty text is the one end id; texts of any length are cut; repeated rows are packed each; a null id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import lean, stored
from lexvane.llm.tokens import encoder


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    group_pieces: int = 20_000
    step_sequences: int = 64


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, p: PackParams, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    end = np.array([p.end_id], "<u4")
    for b in batches:
        for at, ids, offs in enc.encode(b.column(1)):
            rows: list[list] = [[], [], [], [], [], []]
            for k in range(len(offs) - 1):
                doc = np.concatenate([ids[offs[k] : offs[k + 1]].astype("<u4"), end])
                for start in range(0, len(doc), p.window):
                    piece = doc[start : start + p.window]
                    for col, v in zip(rows, (at + k, start, len(piece), zlib.crc32(piece.tobytes()), len(doc), piece.tobytes() if with_ids else None), strict=True):
                        col.append(v)
            cols = [b.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(c, pa.int64()) for c in rows[1:5]]]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(rows[5], pa.binary())] if with_ids else []), ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)


def pack_lengths(lengths: np.ndarray, p: PackParams, by_tier: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and tier of each piece. Longest first; a gap takes the longest piece left that fits it.

    ``by_tier``: the piece that opens a sequence gives it the size of the piece's tier; else every sequence may fill a window.
    """
    n, w = len(lengths), p.window
    seq, off, tier = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(w + 1)]
    for k in order[::-1]:
        stacks[lengths[k]].append(int(k))
    # longest[l]: the largest length of l or less that still has pieces, found by path halving.
    longest = np.arange(w + 1)
    for x in range(1, w + 1):
        longest[x] = x if stacks[x] else longest[x - 1]

    def find(x: int) -> int:
        while x and not stacks[x]:
            nxt = int(longest[x - 1]) if longest[x] == x else int(longest[x])
            longest[x] = nxt
            x = nxt
        return x

    number = 0
    while (x := find(w)) > 0:
        used, members = 0, []
        room = next(t for t in p.tiers if t >= x) if by_tier else w
        while x:
            k = stacks[x].pop()
            seq[k], off[k] = number, used
            members.append(k)
            used += x
            x = find(room - used)
        tier[members] = room if by_tier else next(t for t in p.tiers if t >= used)
        number += 1
    return seq, off, tier


def step_groups(used: np.ndarray, size: int) -> np.ndarray:
    """Deal sequences to groups of ``size``, fullest first and back and forth, so that the groups' tokens are near equal."""
    groups = max(1, -(-len(used) // size))
    order = np.argsort(-used, kind="stable")
    lap, at = np.divmod(np.arange(len(used)), groups)
    out = np.zeros(len(used), np.int64)
    out[order] = np.where(lap % 2, groups - 1 - at, at)
    return out


def tier_groups(used: np.ndarray, tier: np.ndarray, p: PackParams) -> np.ndarray:
    """Step groups of sequences of one tier each; those of shorter tiers have as many more, so that a step's room is the same."""
    out, first = np.zeros(len(used), np.int64), 0
    for t in p.tiers:
        at = np.flatnonzero(tier == t)
        if len(at):
            out[at] = first + step_groups(used[at], p.step_sequences * p.window // t)
            first = out[at].max() + 1
    return out


def _pack_group(pdf: pd.DataFrame, p: PackParams) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    seq, off, tier = pack_lengths(pdf["length"].to_numpy(), p, by_tier=True)
    used = np.bincount(seq, pdf["length"].to_numpy()) if len(seq) else np.zeros(0)
    first = pdf["grp"].to_numpy(np.int64) << 32
    pdf["sequence_id"], pdf["offset"], pdf["tier"] = first + seq, off, tier
    of = np.zeros(len(used), np.int64)
    of[seq] = tier
    pdf["step_group"] = first + tier_groups(used, of, p)[seq]
    return pdf


def cut_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; ``with_ids`` adds the piece's ids as little-endian bytes."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lambda it: lean(_pieces(it, tokenizer, params, with_ids)), schema)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    p = params
    pieces = stored(cut_pieces(df, tokenizer, id_col, text_col, p).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(pieces.count() / p.group_pieces))
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    schema = grouped.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id long, offset long, tier long, step_group long"
    packed = grouped.groupBy("grp").applyInPandas(lambda pdf: _pack_group(pdf, p), schema)
    return packed.drop("grp", "row").withColumnRenamed("id", id_col)
