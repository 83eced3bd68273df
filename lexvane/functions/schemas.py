"""Schemas of the data model and its constraints as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StringType, StructField, StructType

from lexvane.functions.text import strict_date

# The enumerations of the data model.
SOURCE_TYPES = ["legislation", "case_law", "internal_policy", "e_learning"]
CLASSIFICATIONS = ["public", "internal", "confidential", "restricted"]
ROLES = ["helpdesk", "inspector", "legal_counsel"]
METHODS = ["lexical", "dense", "hybrid"]
GRADES = ["relevant", "ambiguous", "irrelevant"]
OUTCOMES = ["answered", "refused"]
REASONS = ["no_authorized_source", "insufficient_evidence", "conflicting_evidence", "outdated_evidence"]
#: Highest classification each role may read.
CLEARANCE = {"helpdesk": "internal", "inspector": "restricted", "legal_counsel": "restricted"}

_TYPES = {"string": StringType(), "int": IntegerType(), "date": DateType(), "array<string>": ArrayType(StringType())}


def _schema(fields: str) -> StructType:
    """A schema from "name type, ..." without a running session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


_COMMON = "source_type string, jurisdiction string, text string, source_path string, security_classification string, allowed_roles array<string>, valid_from string, valid_to string, article string, paragraph string, subparagraph string, citation_path string, ecli string, court string, decision_date string, section_type string, metadata string"
DOCUMENT = _schema(f"doc_id string, title string, effective_date string, {_COMMON}")
CHUNK = _schema(f"chunk_id string, doc_id string, {_COMMON}")
GOLD = _schema(
    "case_id string, category string, query string, role string, expected_outcome string, expected_grade string, expected_refusal_reason string, "
    "expected_citation_substrings array<string>, expected_citation_paths array<string>, expected_chunk_ids array<string>, forbidden_citation_substrings array<string>, forbidden_chunk_ids array<string>, notes string"
)
REQUEST = _schema("query_id string, query string, role string, top_k int, source_types array<string>, jurisdiction string, as_of_date date, method string")

#: Fields that may not be blank.
NOT_BLANK = {"document": ["doc_id", "title", "text", "jurisdiction", "source_path"], "chunk": ["chunk_id", "doc_id", "text", "citation_path", "jurisdiction", "source_path"]}
DATES = ["valid_from", "valid_to", "effective_date", "decision_date"]


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, F.lit(False))


def violations(df: DataFrame, kind: str = "chunk") -> Column:
    """Names of the constraints that a row breaks, in a fixed order; empty for a good row."""
    checks: list[tuple[str, Column]] = [(f"blank_{c}", not_blank(F.col(c))) for c in NOT_BLANK[kind] if c in df.columns]
    if "allowed_roles" in df.columns:
        checks.append(("empty_allowed_roles", F.coalesce(F.size("allowed_roles") > 0, F.lit(False))))
    for c in DATES:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            checks.append((f"bad_{c}", F.col(c).isNull() | strict_date(F.col(c)).isNotNull()))
    if {"valid_from", "valid_to"} <= set(df.columns):
        a, z = (strict_date(F.col(c).cast("string")) for c in ("valid_from", "valid_to"))
        checks.append(("inverted_validity", F.coalesce(z >= a, F.lit(True))))
    for c, values in (("source_type", SOURCE_TYPES), ("security_classification", CLASSIFICATIONS)):
        if c in df.columns:
            checks.append((f"unknown_{c}", F.coalesce(F.col(c).isin(values), F.lit(False))))
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))


def unknown_fields(json_text: Column, schema: StructType) -> Column:
    """Keys of a JSON object that the schema does not have."""
    return F.array_except(F.json_object_keys(json_text), F.array(*map(F.lit, schema.fieldNames())))


def checked(df: DataFrame, kind: str = "chunk") -> DataFrame:
    """``df``, failing on the first row that breaks a constraint."""
    bad = violations(df, kind)
    key = NOT_BLANK[kind][0]
    return df.withColumn(key, F.when(F.size(bad) == 0, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("constraints broken: "), F.array_join(bad, ", ")))))


def classification_rank(c: Column) -> Column:
    return reduce(lambda a, k: a.when(c == k[1], F.lit(k[0])), enumerate(CLASSIFICATIONS), F.when(F.lit(False), F.lit(-1)))
