r"""Benchmark decontamination: a broadcast hash set of test windows, met by every window of the training texts.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. An item's windows are its runs of ``n`` words; an
item of fewer words, but not none, is one window. Equal windows of all items are one row of the hash set, with the items that have
them. A text's windows of each length that the set has are hashed, meet the set in a broadcast join and are then compared word by
word, so a shared hash is no hit. The hits of a text are gathered by its id and a hash of its text, summed up in each task first;
every text adds a row of its own that always matches, so one scan gives the texts without hits too. Only DataFrame functions are
used.

The set is measured before it is broadcast: beyond ``set_bytes`` it is cut by hash into parts of about that size, and the texts are
scanned once for each part.

Defined cases: null and empty texts have no words and no hits; a null id is kept, as is every repeat of a row; an item without words
has no window; a repeated item counts once by its id; an item without id removes words but is not listed; no benchmark leaves all
as it is; other columns pass through ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import between, stored, unused_name, whole_text

_SIGNS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Of the text as it stands, where capitals are parts of words.
_RAW_SIGNS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


@dataclass(frozen=True)
class DecontaminationParams:
    n: int = 10
    set_bytes: int = 64 << 20


def words_of(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, f"[{_SIGNS}]+", -1), "")


def test_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A row for each distinct window: size, words, h (hash) and items (ids as sorted strings)."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(whole_text(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = words.withColumn("size", size).select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    each = starts.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("words"))
    return each.groupBy("size", "words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("words"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """A row for each distinct id and text: id, mark (hash of the text), n_rows, n_words, hit (sorted word numbers from 0), items (sorted ids as strings)."""
    p = params
    windows = stored(test_windows(benchmark, item_col, item_text_col, p.n), "test-windows")
    weight = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("words") + F.size("items") + 4)
    total, sizes = windows.agg(F.coalesce(F.sum(weight.cast("long")), F.lit(0)), F.array_sort(F.collect_set("size"))).first()
    parts = max(1, -(-total // p.set_bytes))

    texts = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("t")).select("id", F.xxhash64("t").alias("mark"), words_of(F.col("t")).alias("words"))
    counted = texts.withColumn("n", F.size("words"))

    def hashes(size: int) -> Column:
        of = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.xxhash64(F.slice("words", i, size)))
        return F.when(F.col("n") >= size, of).otherwise(F.array().cast("array<bigint>"))

    # Windows of one length after those of another; the element at place 0 stands for the text itself.
    own = F.array(F.lit(0).cast("bigint"))
    each = counted.select("id", "mark", "n", "words", F.posexplode_outer(F.concat(own, *[hashes(s) for s in sizes])).alias("at", "h"))
    size, start, before = F.lit(0), F.lit(0), F.lit(0)
    for s in sizes:
        there = F.col("at") > before
        size, start = F.when(there, s).otherwise(size), F.when(there, F.col("at") - before).otherwise(start)
        before = before + F.greatest(F.col("n") - s + 1, F.lit(0))
    each = each.select("id", "mark", "n", "words", "h", size.alias("s"), start.alias("at"))
    alone = windows.sparkSession.range(1).select(F.lit(0).alias("size"), F.array().cast("array<string>").alias("test"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("h"))

    def met(k: int) -> DataFrame:
        some = windows.where(F.pmod("h", F.lit(parts)) == k).select("size", F.col("words").alias("test"), "items", "h")
        known = F.broadcast((some.union(alone) if k == 0 else some).withColumnsRenamed({"h": "h2"}))
        same = (F.col("h") == F.col("h2")) & (F.col("s") == F.col("size")) & ((F.col("s") == 0) | (F.slice("words", F.greatest("at", F.lit(1)), F.col("s")) == F.col("test")))
        return each.join(known, same).select("id", "mark", "n", "at", "s", "items")

    hits = reduce(DataFrame.union, [met(k) for k in range(parts)])
    real = F.col("s") > 0
    found = hits.groupBy("id", "mark", "n").agg(
        F.count(F.when(~real, 1)).alias("n_rows"),
        F.collect_set(F.when(real, F.struct("at", "s"))).alias("spans"),
        F.collect_set(F.when(real, F.col("items"))).alias("lists"),
    )
    inside = F.flatten(F.transform("spans", lambda x: F.sequence(x["at"] - 1, x["at"] + x["s"] - 2)))
    return found.select(
        F.col("id").alias(id_col), "mark", "n_rows", F.col("n").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(inside)).alias("hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, how: str = "spans", share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``df`` without what it shares with the benchmark.

    ``spans`` takes the words of hits out of the texts, with the signs before them; ``documents`` takes out the rows of which more than
    ``share`` of the words are hit.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how is 'spans' or 'documents'")
    found = contamination(df, benchmark, id_col, text_col, item_col, item_text_col, params).where(F.size("hit") > 0)
    bad = stored(found.select(F.col(id_col).alias("i"), F.col("mark").alias("m"), "hit", "n_words"), "contaminated")
    mark, names = unused_name(df, "mark"), df.columns
    src = df.withColumn(mark, F.xxhash64(whole_text(text_col)))
    same = F.col(f"a.{id_col}").eqNullSafe(F.col("b.i")) & (F.col(f"a.{mark}") == F.col("b.m"))
    if how == "documents":
        return src.alias("a").join(bad.where(F.size("hit") > F.lit(share) * F.col("n_words")).alias("b"), same, "left_anti").select(*[f"a.`{c}`" for c in names])
    pieces = F.regexp_extract_all(F.col(f"a.{text_col}"), F.lit(f"[{_RAW_SIGNS}]*[^{_RAW_SIGNS}]+"), F.lit(0))
    tail = F.regexp_extract(F.col(f"a.{text_col}"), f"[{_RAW_SIGNS}]*$", 0)
    clean = F.when(F.col("b.hit").isNull(), F.col(f"a.{text_col}")).otherwise(F.concat(F.array_join(between(pieces, F.col("b.hit")), ""), tail))
    return src.alias("a").join(bad.alias("b"), same, "left").select(*[clean.alias(c) if c == text_col else F.col(f"a.`{c}`") for c in names])
