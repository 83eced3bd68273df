"""Readers: JSON lines, JSON, XML files, the driver's tables as chunks, and generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexvane.functions.schemas import CHUNK, DOCUMENT, GOLD, ROLES, checked, classification_rank
from lexvane.functions import text as T
from lexvane.functions.text import strict_date


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Strict: a line with other fields, or that is no object, fails."""
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0)
    raw = F.from_json("value", schema, {"mode": "FAILFAST"})
    if strict:
        extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, schema.fieldNames())))
        raw = F.when(F.coalesce(F.size(extra), F.lit(1)) == 0, raw).otherwise(F.raise_error(F.concat(F.lit("unknown fields: "), F.coalesce(F.array_join(extra, ", "), F.lit("not an object")))))
    return lines.select(raw.alias("r")).select("r.*")


def _defaults(df: DataFrame, roles: list[str] = ROLES) -> DataFrame:
    out = df.withColumn("security_classification", F.coalesce("security_classification", F.lit("public")))
    out = out.withColumn("allowed_roles", F.coalesce("allowed_roles", F.array(*map(F.lit, roles))))
    return out.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return checked(_defaults(read_json_lines(spark, path, DOCUMENT)), "document")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with validity as dates and the classification's rank, ready for retrieval."""
    return typed(checked(_defaults(read_json_lines(spark, path, CHUNK)), "chunk"))


def typed(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumn("security_rank", classification_rank(F.col("security_classification")))
    return out.withColumn("valid_from", strict_date(F.col("valid_from"))).withColumn("valid_to", strict_date(F.col("valid_to")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, GOLD)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: configurations, manifests, reports."""
    return spark.read.option("multiLine", True).json(path)


_FIXTURE = "doc_id string, title string, text string, jurisdiction string, security_classification string, allowed_roles array<string>, valid_from string, valid_to string, metadata map<string,string>"


def read_fixtures(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Policy (``internal_policy``) or lesson (``e_learning``) files as documents, with the defaults of their kind."""
    if kind not in ("internal_policy", "e_learning"):
        raise ValueError(f"unsupported kind {kind!r}")
    raw = spark.read.schema(_FIXTURE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_path").alias("source_path"))
    policy = kind == "internal_policy"
    roles = ["inspector", "legal_counsel"] if policy else ROLES
    own = F.create_map(F.lit("simulated_source"), F.lit("true"))
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), given)
    got = {
        "source_type": F.lit(kind),
        "jurisdiction": F.coalesce("jurisdiction", F.lit("NL")),
        "security_classification": F.coalesce("security_classification", F.lit("internal" if policy else "public")),
        "allowed_roles": F.coalesce("allowed_roles", F.array(*map(F.lit, roles))),
        "citation_path": F.col("title"),
        "effective_date": F.col("valid_from"),
        "metadata": F.to_json(merged),
    }
    out = raw.withColumns(got)
    return out.select(*[F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def lock_key(df: DataFrame) -> Column:
    """The key of a manifest or lock row."""
    return F.concat_ws("|", "source_type", "identifier", F.coalesce("version_date", F.lit("")))


def lock_index(lock: DataFrame) -> DataFrame:
    return lock.withColumn("lock_key", lock_key(lock))


def verify(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Manifest rows with ok, mismatch or unlocked, by the digest the lock has for the same key."""
    known = lock_index(lock).select("lock_key", F.col("sha256").alias("locked"))
    got = lock_index(manifest).join(known, "lock_key", "left")
    return got.withColumn("status", F.when(F.col("locked").isNull(), "unlocked").when(F.col("locked") == F.col("sha256"), "ok").otherwise("mismatch")).drop("locked", "lock_key")


def stress(chunks: DataFrame, times: int) -> DataFrame:
    """Every chunk ``times`` times under ids of its own; up to one, as it is.

    The metadata say so: synthetic_stress, stress_replica and stress_multiplier, after what is there (a JSON object, or null).
    """
    if times <= 1:
        return chunks
    n = F.col("_n").cast("string")
    out = chunks.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times))))
    for c in ("chunk_id", "doc_id"):
        if c in out.columns:
            out = out.withColumn(c, F.concat(F.col(c).cast("string"), F.lit("::stress:"), n))
    marks = F.concat(F.lit('"synthetic_stress":true,"stress_replica":'), n, F.lit(f',"stress_multiplier":{times}}}'))
    old = F.regexp_replace(F.col("metadata"), r"\s*\}\s*$", "") if "metadata" in out.columns else F.lit("{")
    old = F.coalesce(T.blank_to_null(old), F.lit("{"))
    return out.withColumn("metadata", F.concat(old, F.when(F.btrim(old) == "{", "").otherwise(","), marks)).drop("_n")


def document_chunks(documents: DataFrame) -> DataFrame:
    """The driver's ``documents`` as chunks, by a fixed rule on their ids."""
    d = F.col("doc_id")
    kind = F.when(d % 4 == 0, "legislation").when(d % 4 == 1, "case_law").when(d % 4 == 2, "internal_policy").otherwise("e_learning")
    article = F.concat((d % 97).cast("string"), F.lit("."), (d % 7).cast("string"))
    rank = F.when(d % 4 != 2, 0).when(d % 8 == 2, 1).when(d % 16 == 6, 2).otherwise(3)
    roles = F.when(kind == "internal_policy", F.array(F.lit("inspector"), F.lit("legal_counsel"))).otherwise(F.array(*map(F.lit, ROLES)))
    return documents.select(
        F.concat(F.lit("doc:"), d.cast("string")).alias("chunk_id"),
        d.cast("string").alias("doc_id"),
        "text",
        "lang",
        F.concat(F.col("source"), F.lit(" > Artikel "), article, F.lit(" > Lid "), (d % 3 + 1).cast("string")).alias("citation_path"),
        kind.alias("source_type"),
        F.when(d % 10 == 9, "BE").otherwise("NL").alias("jurisdiction"),
        rank.cast("int").alias("security_rank"),
        roles.alias("allowed_roles"),
        F.date_add(F.lit("2020-01-01").cast("date"), (d % 1500).cast("int")).alias("valid_from"),
        F.when(d % 3 != 0, F.date_add(F.lit("2024-06-01").cast("date"), (d % 900).cast("int"))).alias("valid_to"),
        F.when(kind == "legislation", article).alias("article"),
        F.when(kind == "legislation", (d % 3 + 1).cast("string")).alias("paragraph"),
        F.lit(None).cast("string").alias("subparagraph"),
        F.when(kind == "case_law", F.concat(F.lit("ECLI:NL:HR:"), (2000 + d % 25).cast("string"), F.lit(":"), d.cast("string"))).alias("ecli"),
        F.when(kind == "case_law", F.concat((2000 + d % 25).cast("string"), F.lit("-06-01"))).alias("decision_date"),
        F.lit(None).cast("string").alias("section_type"),
        F.lit("documents").alias("source_path"),
    )
