"""Writers: JSON lines with sorted keys, tables, the embedding index, reports, and merged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexvane.operators.vector_index import VectorIndex

MANIFEST = "source_type string, identifier string, name string, status string, saved_path string, url string, sha256 string, version_date string, note string"


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, keys in order, nulls written."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Chunks as Parquet by source type; returns the count of each type and, with type null, of all."""
    chunks.write.mode(mode).partitionBy("source_type").parquet(path)
    return chunks.sparkSession.read.parquet(path).rollup("source_type").agg(F.count(F.lit(1)).alias("n"))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_documents(parts: list[DataFrame]) -> DataFrame:
    """Documents of several sources; of a repeated doc_id, the one of the first source that has it."""
    both = None
    for k, p in enumerate(parts):
        p = p.withColumn("_source", F.lit(k)).withColumn("_line", F.monotonically_increasing_id())
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    return first_wins(both, "doc_id", "_source", "_line").drop("_source", "_line")


def ensure_index(chunks: DataFrame, path: str, recreate: bool = False) -> VectorIndex:
    """The index of just these chunks at ``path``, written anew where the one there is of others. The whole corpus is indexed; filters come with the queries."""
    return VectorIndex.refresh(chunks, path, recreate=recreate)


def write_manifest(rows: list[dict], spark: SparkSession, path: str) -> DataFrame:
    """The rows of fetched files as JSON lines; returns them as a table."""
    manifest = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in MANIFEST.split(", ")) for r in rows], MANIFEST)
    write_json_lines(manifest, path, "overwrite")
    return manifest


def write_lock(manifest: DataFrame, path: str) -> None:
    """The lock rows of a manifest; refused unless every row is ok."""
    if manifest.where("status <> 'ok' OR status IS NULL").limit(1).count():
        raise ValueError("the manifest has rows that are not ok")
    write_json_lines(manifest.drop("status", "note"), path, "overwrite")


def write_report(report: DataFrame, cases: DataFrame, folder: str, traces: DataFrame | None = None) -> None:
    write_json_lines(report, f"{folder}/summary", "overwrite")
    write_json_lines(cases, f"{folder}/cases", "overwrite")
    if traces is not None:
        write_json_lines(traces, f"{folder}/traces", "overwrite")
