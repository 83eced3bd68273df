"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id, row), so equal texts stand together and repeated rows can be cut apart. Size-weighted key samples give quantile
boundaries, records fall into the ranges between them, ranges that turn out overfull are sampled and cut again, and a running
sum of bytes within each range says where the shard boundaries lie. Only DataFrame operations are used.

Law: ``bytes`` - the shards' sizes differ by no more than the records at their borders.

Defined cases: a null text counts as empty (size 1); a null id sorts first; repeated rows share a key and each gets a slot of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexvane.llm.common import stored, whole_text

_NULL_ID = -(2**63)
_BLOCK = 32


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    #: Ranges for each shard; the driver holds one row for each range and sample, whatever the size of the input.
    ranges_per_shard: int = 64
    samples_per_range: int = 16
    #: Ranges with more than so many times their due are cut again, until there are none.
    overfull: float = 2.0


def _range_of(splitters: list[tuple[int, int, int]], h: Column, i: Column, r: Column) -> Column:
    """Number of splitters at or below the key, by a search over blocks of splitters."""
    if not splitters:
        return F.lit(0)
    key = F.struct(h.alias("h"), i.alias("i"), r.alias("r"))
    blocks = [[{"h": h_, "i": i_, "r": r_} for h_, i_, r_ in splitters[k : k + _BLOCK]] for k in range(0, len(splitters), _BLOCK)]
    # Parsed once, when Catalyst folds constants.
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<struct<h:bigint,i:bigint,r:bigint>>")
    all_blocks = F.from_json(F.lit(json.dumps(blocks)), "array<array<struct<h:bigint,i:bigint,r:bigint>>>")
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= key))
    block = below(heads)
    return F.when(block == 0, 0).otherwise((block - 1) * _BLOCK + below(F.element_at(all_blocks, F.greatest(block, F.lit(1)))))


def _sampled(keys: DataFrame, rate: Column, seed: int) -> list:
    """Keys drawn with a probability in proportion to their size, by a hash of the key: the same on every run."""
    u = F.pmod(F.xxhash64("h", "i", "r", F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    return keys.where(u < F.col("size") * rate).select("h", "i", "r", F.greatest(F.lit(1.0), F.col("size") * rate).alias("w")).collect()


def _quantiles(drawn: list, cuts: int) -> list[tuple[int, int, int]]:
    drawn = sorted(drawn, key=lambda r: (r["h"], r["i"], r["r"]))
    total, run, out = sum(r["w"] for r in drawn), 0.0, []
    for r in drawn:
        if len(out) < cuts and run >= total * (len(out) + 1) / (cuts + 1):
            out.append((r["h"], r["i"], r["r"]))
        run += r["w"]
    return sorted(set(out))


def shard_by_sampled_splitters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ShardParams = ShardParams()) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and range_id."""
    p = params
    text = whole_text(text_col)
    keys = stored(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("i"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("r"),
        ),
        "shard-keys",
    )
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = p.shards * p.ranges_per_shard
    splitters: list[tuple[int, int, int]] = []
    if rows:
        splitters = _quantiles(_sampled(keys, F.lit(n_ranges * p.samples_per_range / total), 1), n_ranges - 1)
    due, stats, turn = max(1.0, total / n_ranges), {}, 0
    while True:
        ranged = keys.withColumn("range_id", _range_of(splitters, F.col("h"), F.col("i"), F.col("r")))
        stats = {r["range_id"]: r for r in ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).collect()}
        over = [k for k, r in stats.items() if r["bytes"] > p.overfull * due and r["bytes"] > 2 * r["most"]]
        if not over:
            break
        # Twice as dense each time, so that a range with rows to part is parted in the end.
        rate, turn = F.lit(2**turn * 4 * p.samples_per_range / due), turn + 1
        more = _sampled(ranged.where(F.col("range_id").isin(over)), rate, 1 + turn)
        heavy = sum(stats[k]["bytes"] for k in over)
        splitters = sorted({*splitters, *_quantiles(more, max(1, round(2 * heavy / due)))})

    offsets, run_bytes, run_rows = [], 0, 0
    for k in sorted(stats):
        offsets.append((k, run_bytes, run_rows))
        run_bytes, run_rows = run_bytes + stats[k]["bytes"], run_rows + stats[k]["n"]
    starts = df.sparkSession.createDataFrame(offsets, "range_id int, bytes_before long, rows_before long")
    ordered = Window.partitionBy("range_id").orderBy("h", "i", "r")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The table of starts has one row for each range: its size is set by the parameters, so it is broadcast.
    placed = (
        ranged.withColumn("run", F.sum("size").over(upto))
        .withColumn("rn", F.row_number().over(ordered))
        .join(F.broadcast(starts), "range_id")
        .withColumn("middle", F.col("bytes_before") + F.col("run") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(p.shards - 1), F.floor(F.col("middle") * p.shards / F.lit(max(1, total)))).cast("int"))
        .withColumn("at", (F.col("rows_before") + F.col("rn") - 1).cast("long"))
        .select("id", "size", "text_crc32", "shard", "at", "range_id")
    )
    placed = stored(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range_id"
    )
