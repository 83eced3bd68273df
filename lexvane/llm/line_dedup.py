r"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case. Keys of ``min_chars`` code points or
more stay only in the smallest id that holds them. Documents are taken in batches of ascending id. A batch's distinct keys are
merge-anti-joined with the runs kept so far, and what is new becomes a run of its own. When a level holds ``fanout`` runs they
are merged into one run of the next level. A key's owner never changes once it is in a run, so one join of all line hashes with
the runs gives every line's fate. Only DataFrame operations are used.

A batch's hashes are aggregated before they are shuffled. Hashes that many lines have (more than a bucket's share: their number is
bounded by buckets and batches) find their owners by a broadcast of those few, so that no task gets all lines of one of them.

A run is a table bucketed and sorted by the hash, one file to a bucket: joins with it and merges of runs neither shuffle nor sort
it. The tables are dropped once every line's fate is known.

A document's dropped lines come as sorted positions, and its kept lines are the stretches between these, so that a long document
with many dropped lines costs what its lines cost.

Defined cases: a null text is one empty line; a null id sorts last and owns a key only where no other id has it; rows with the
same id are one document; a key repeated within its owner stays each time; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import between, discard, shuffle_partitions, stored_at, unused_name, whole_text, workspace

_BLANK = " \t\n\x0b\x0c\r"
_LAST = 2**63 - 1
#: Fixed value: lets a scan of a bucketed table with one file to a bucket say that it is sorted.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def line_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.unhex(F.md5(key.cast("binary")))


@dataclass
class LevelledRuns:
    """Runs of (h, owner), each bucketed and sorted by h and written once to the shared folder. ``drop`` removes them."""

    spark: SparkSession
    fanout: int = 3
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or shuffle_partitions(self.spark)
        self._was = self.spark.conf.get(_SORTED_SCANS)
        self.spark.conf.set(_SORTED_SCANS, "true")

    def _write(self, df: DataFrame, level: int) -> str:
        """``df`` is partitioned by h into the buckets already."""
        path = workspace(self.spark, f"line-run-l{level}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
        self.paths[name] = path
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.paths.pop(name))

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, owner), each hash once, of a batch whose ids are above those of all batches before."""
        new = batch.repartition(self.buckets, "h")
        for name in self.names():
            new = new.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(new, 0))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            together = reduce(DataFrame.union, map(self.spark.table, level))
            merged = self._write(together.groupBy("h").agg(F.min("owner").alias("owner")), k + 1)
            for name in level:
                self._remove(name)
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)

    def owners(self, lines: DataFrame) -> DataFrame:
        """``lines`` (with h) and the owner of each hash, from whichever run holds it."""
        lines = lines.repartition(self.buckets, "h")
        found = [lines.join(self.spark.table(name).hint("merge"), "h") for name in self.names()]
        return reduce(DataFrame.union, found)

    def drop(self) -> None:
        for name in self.names():
            self._remove(name)
        self.levels = []
        self.spark.conf.set(_SORTED_SCANS, self._was)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``df`` with its text less the dropped lines, and the columns n_lines and n_dropped (named with underscores in front if taken)."""
    spark = df.sparkSession
    n_lines, n_dropped = unused_name(df, "n_lines"), unused_name(df, "n_dropped")
    names = df.columns
    cols = {c: f"c{k}" for k, c in enumerate(names)}
    src = df.toDF(*cols.values())
    ident = F.coalesce(F.col(cols[id_col]).cast("long"), F.lit(_LAST))
    text = whole_text(cols[text_col])
    lines = F.split(text, "\n", -1)

    each = src.select(ident.alias("id"), F.xxhash64(text).alias("th"), F.posexplode(lines).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    hashes = each.where(F.char_length("key") >= min_chars).select("id", "th", "pos", line_hash(F.col("key")).alias("h"))
    cuts = src.agg(F.percentile_approx(ident, [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    cuts = sorted({int(c) for c in cuts or []})
    batch = sum([(F.col("id") > c).cast("int") for c in cuts], F.lit(0))
    table, table_path = stored_at(hashes.withColumn("batch", batch), "line-hashes", partition_by=["batch"])

    runs, hot, spent = LevelledRuns(spark, fanout), None, [table_path]
    share = table.count() / (runs.buckets * (len(cuts) + 1))
    try:
        for k in range(len(cuts) + 1):
            one, path = stored_at(table.where(F.col("batch") == k).groupBy("h").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")), "line-batch")
            runs.add(one.select("h", "owner"))
            many = one.where(F.col("n") > share).select("h")
            hot, spent = many if hot is None else hot.union(many), [*spent, path]
        hot, path = stored_at(runs.owners(hot.distinct()), "line-hot")
        spent.append(path)
        each = table.select("id", "th", "pos", "h")
        # At most buckets * batches ** 2 rows of 24 bytes: a hash with more than ``share`` lines in a batch, of at most all lines.
        owned = runs.owners(each.join(F.broadcast(hot), "h", "left_anti")).unionByName(each.join(F.broadcast(hot), "h"))
        dropped = owned.where(F.col("owner") != F.col("id"))
        dropped, _ = stored_at(dropped.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "lines-dropped")
    finally:
        runs.drop()
    discard(*spent)

    joined = src.withColumn("id", ident).withColumn("th", F.xxhash64(text)).join(dropped, ["id", "th"], "left").withColumn("lines", lines)
    return joined.select(
        *[(F.when(F.col("gone").isNull(), F.col(cols[c])).otherwise(F.array_join(between(F.col("lines"), F.col("gone")), "\n")) if c == text_col else F.col(cols[c])).alias(c) for c in names],
        F.size("lines").cast("long").alias(n_lines),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_dropped),
    )
