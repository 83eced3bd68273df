"""Access and scope filters, applied before anything is scored.

Reasons are decided row by row, so a denied chunk is never let back in by an allowed one of the same id. Every unknown denies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexvane.functions.schemas import CLASSIFICATIONS, CLEARANCE, classification_rank

# Where access is decided, and what it protects.
STAGE = "pre_retrieval"
SURFACES = ("lexical", "dense", "fusion", "reranking", "generation", "cache", "evaluation")


def checked_contract(stage: str = STAGE, surfaces: tuple[str, ...] = SURFACES) -> tuple[str, tuple[str, ...]]:
    """The contract, or ValueError: access is decided before retrieval and nowhere else, for some of the known surfaces at least."""
    if stage != STAGE:
        raise ValueError(f"access must be decided in {STAGE!r}, so that what may not be seen is never scored; got {stage!r}")
    if not surfaces or set(surfaces) - set(SURFACES):
        raise ValueError(f"surfaces must be some of {SURFACES}; got {tuple(surfaces)!r}")
    return stage, tuple(surfaces)


#: Requests are broadcast; a batch of more than this is refused rather than sent to every executor.
MOST_REQUESTS = 20_000


def access_reason(role: Column, allowed_roles: Column, rank: Column, clearance: dict[str, str] = CLEARANCE) -> Column:
    """First rule that denies, or ``authorized``."""
    table = F.create_map(*[F.lit(x) for k, v in clearance.items() for x in (k, CLASSIFICATIONS.index(v))])
    may = F.try_element_at(table, role)
    return (
        F.when(may.isNull(), "unknown_role")
        .when(F.coalesce(F.size(allowed_roles), F.lit(0)) <= 0, "missing_allowed_roles")
        .when(~F.coalesce(F.array_contains(allowed_roles, role), F.lit(False)), "role_not_permitted")
        .when(~F.coalesce(rank <= may, F.lit(False)), "classification_exceeds_role_clearance")
        .otherwise("authorized")
    )


def valid_on(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Both ends count; an open end and a missing day hold always."""
    return day.isNull() | ((valid_from.isNull() | (valid_from <= day)) & (valid_to.isNull() | (day <= valid_to)))


#: Days of the calendar that is halved again and again, about 1,435 years to each side of 1970.
_SPAN_BITS = 20


def _place(day: Column, open_end: int) -> Column:
    """A day's place in the calendar; days beyond its ends lie at the ends."""
    return F.least(F.greatest(F.coalesce(F.unix_date(day) + (1 << (_SPAN_BITS - 1)), F.lit(open_end)), F.lit(0)), F.lit((1 << _SPAN_BITS) - 1))


def validity_blocks(valid_from: Column, valid_to: Column) -> Column:
    """The fewest blocks of 1, 2, 4, ... days, each in its place, that a validity is made of: at most two of each size.

    An open end reaches the calendar's end, in blocks that grow as fast; a validity that ends before it begins has none.
    """
    first, end = _place(valid_from, 0), _place(valid_to, (1 << _SPAN_BITS) - 1) + 1

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("int")
        low, high = F.ceil(first / size).cast("int"), F.floor(end / size).cast("int")
        block = lambda at: F.struct(level.alias("level"), at.alias("at"))
        there = low < high
        return F.array(F.when(there & (low % 2 == 1), block(low)), F.when(there & (high % 2 == 1), block(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_SPAN_BITS)), of)))


def day_blocks(day: Column) -> Column:
    """The block of each size that a day lies in."""
    at = _place(day, 0)
    return F.transform(F.sequence(F.lit(0), F.lit(_SPAN_BITS)), lambda n: F.struct(n.alias("level"), F.floor(at / F.pow(F.lit(2), n)).cast("int").alias("at")))


def valid_at(days: DataFrame, chunks: DataFrame, day_col: str = "day") -> DataFrame:
    """Each row of ``days`` with each row of ``chunks`` that is valid on its day, by an equi join on blocks of the calendar.

    A day lies in one block of each size and a validity is made of few blocks that do not overlap, so every pair is found once, however
    long validities are or where they are open. Rows of ``days`` without a day are left out: they ask for no date.
    """
    asked = days.where(F.col(day_col).isNotNull()).withColumn("_b", F.explode(day_blocks(F.col(day_col))))
    held = chunks.withColumn("_v", F.explode(validity_blocks(F.col("valid_from"), F.col("valid_to"))))
    same = (F.col("_b.level") == F.col("_v.level")) & (F.col("_b.at") == F.col("_v.at"))
    met = held.join(asked, same & valid_on(F.col("valid_from"), F.col("valid_to"), F.col(day_col)))
    return met.drop("_b", "_v")


def scope_reason(source_types: Column, jurisdiction: Column, day: Column, chunk_type: Column, chunk_jurisdiction: Column, valid_from: Column, valid_to: Column) -> Column:
    """First of source type, jurisdiction and validity that a chunk fails, or ``in_scope``."""
    any_type = source_types.isNull() | (F.size(source_types) <= 0)
    return (
        F.when(~(any_type | F.coalesce(F.array_contains(source_types, chunk_type), F.lit(False))), "source_type")
        .when(~(jurisdiction.isNull() | F.coalesce(jurisdiction == chunk_jurisdiction, F.lit(False))), "jurisdiction")
        .when(~valid_on(valid_from, valid_to, day), "validity")
        .otherwise("in_scope")
    )


def with_rank(chunks: DataFrame) -> DataFrame:
    return chunks if "security_rank" in chunks.columns else chunks.withColumn("security_rank", classification_rank(F.col("security_classification")))


def local_requests(requests: DataFrame) -> DataFrame:
    """The requests as a local table, their number checked: plans that read them need no job of their own for it.

    Requests made of records are local already, and then nothing is run here.
    """
    rows = requests.limit(MOST_REQUESTS + 1).toArrow()
    if rows.num_rows > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests in one batch")
    return requests.sparkSession.createDataFrame(rows, requests.schema)


def as_requests(requests: DataFrame) -> DataFrame:
    """Requests under names of their own, marked for broadcast once their number is checked."""
    some = local_requests(requests)
    return F.broadcast(some.select(*[F.col(c).alias(f"q_{c}") if c != "query_id" else F.col(c) for c in requests.columns]))


def access_of(clearance: dict[str, str] = CLEARANCE) -> Column:
    return access_reason(F.col("q_role"), F.col("allowed_roles"), F.col("security_rank"), clearance)


def scope_of() -> Column:
    return scope_reason(*[F.col(c) for c in ("q_source_types", "q_jurisdiction", "q_as_of_date", "source_type", "jurisdiction", "valid_from", "valid_to")])


def may_see(clearance: dict[str, str] = CLEARANCE) -> Column:
    """Access and scope of a joined request and chunk, in one condition."""
    return (access_of(clearance) == "authorized") & (scope_of() == "in_scope")


#: What the filters look at.
KINDS = ["allowed_roles", "security_rank", "source_type", "jurisdiction", "valid_from", "valid_to"]


def chunk_kinds(chunks: DataFrame) -> DataFrame:
    """Chunks counted by what the filters look at."""
    return with_rank(chunks).groupBy(*KINDS).agg(F.count(F.lit(1)).alias("n"))


def request_counts(requests: DataFrame, chunks: DataFrame, clearance: dict[str, str] = CLEARANCE, kinds: DataFrame | None = None) -> DataFrame:
    """For each request: chunks in all, denied, out of scope by first reason, and candidates.

    Chunks are first counted by what the filters look at, so the work with requests does not grow with the corpus. With ``kinds``
    (``chunk_kinds`` of the chunks, as an index keeps them) the chunks are not read at all.
    """
    kinds = chunk_kinds(chunks) if kinds is None else kinds
    met = kinds.join(as_requests(requests), F.lit(True)).withColumn("access", access_of(clearance)).withColumn("scope", F.when(F.col("access") == "authorized", scope_of()))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    counted = met.groupBy("query_id").agg(
        F.sum("n").cast("long").alias("total_chunk_count"),
        total(F.col("access") != "authorized").alias("denied_count"),
        *[total(F.col("scope") == r).alias(f"{r}_filtered_count") for r in ("source_type", "jurisdiction", "validity")],
        total(F.col("scope") == "in_scope").alias("authorized_candidate_count"),
    )
    names = [c for c in counted.columns if c != "query_id"]
    return requests.select("query_id").join(counted, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])
