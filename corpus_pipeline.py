"""A corpus from raw documents to packed sequences: each stage takes all rows that the one before it kept.

Stages: toxic documents go; repeated lines go; one document of each group of near copies stays; sources are sampled to target
weights; what is left is packed. Every stage but the last returns the columns of ``documents``, with n_chars as the text's length.

Defined cases: null and empty texts are scored like any text without words, are one empty line, link with nothing and become one
end id; rows without id are never learned from, lose no line to a row with an id that comes later, and are no copies of others;
repeated rows pass the first two stages each and stay once in the third; empty tables give empty results; of other columns than
those of ``documents`` none is kept; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import stored, table
from lexvane.llm.line_dedup import dedup_lines
from lexvane.llm.mixing import MixParams, mix
from lexvane.llm.ngram_join import ngram_components
from lexvane.llm.packing import pack_documents
from lexvane.llm.toxicity import ToxicityParams, fit_on_labels, score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under the threshold. The model is fitted on the labelled rows among ``docs`` that may be learned from."""
    p = ToxicityParams()
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"), p)
    return score_documents(docs.select(*COLUMNS), model).where(F.col("score") < p.threshold).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with lines that a smaller id holds taken out of their texts."""
    out = dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; equal rows once. Texts without words stay, and rows without id.

    Where one id has several texts, only those texts stay that are their group's first, one of them if several are of one group.
    """
    groups = ngram_components(docs).where(F.col("doc_id") == F.col("component_id"))
    by_group = F.when(F.col("n_shingles") > 0, F.lit(None)).otherwise(F.col("text_mark")).alias("apart")
    first = stored(groups.groupBy("doc_id", by_group).agg(F.min("text_mark").alias("mark")).select("doc_id", "mark"), "pipeline-first")
    named = docs.where("doc_id IS NOT NULL").select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    named = named.join(first, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def sample_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn with probabilities calibrated to the target weights of sources, languages and topics.

    At least 55 % of the tokens stay in expectation, so that a language with hardly any text does not take the rest with it.
    """
    return mix(docs.select(*COLUMNS), params=MixParams(least=0.55)).where("mix_keep").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, placed in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", sample_sources),
    ("packing", pack),
]

#: Learned scores, components and a tokenizer: SQL can't express these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
