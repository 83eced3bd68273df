"""The queries of this subpackage and the SQL that DuckDB holds them against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.toxicity import ToxicityParams, fit_on_labels, score_documents

    p = ToxicityParams()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_on_labels(docs, table(spark, sf_dir, "labels"), p))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_prob").alias("prob"), F.col("mix_keep").alias("selected"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.sharding import shard_by_sampled_splitters

    return shard_by_sampled_splitters(table(spark, sf_dir, "documents"))


def op4_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.vector_dedup import vector_components

    return vector_components(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.ngram_join import NgramParams, ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), params=NgramParams(n=4, threshold=85)).select("doc_id", "n_shingles", "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.id_output import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return each.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text. Where crc32 of the id says so, words from the a-th on become repeats of the p words from there, joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "").alias("w"))
    sized = words.withColumn("n", F.size("w")).withColumn("a", (F.col("g") % F.expr("nullif(n, 0)")).cast("int"))
    sized = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.runs import collapse_runs

    found = collapse_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "n_words")
    # Runs come by start and period; of equal ratios the first stays.
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    judged = found.withColumn("best", best)
    return judged.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Messages less those dropped, with the faults that crc32 of ``conv_id:turn`` plants; nulls of role and text are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    said = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return said.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexvane.llm.conversations import repair_conversations

    rows = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged_conversations(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_vector_codes": op4_vector_codes,
    "op5_packing": op5_packing,
    "op6_media_columns": op6_media_columns,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_ids": op10_token_ids,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LEAST = """reach AS (SELECT {id} AS id, {id} AS r FROM nodes UNION SELECT reach.id, b FROM reach JOIN links ON reach.r = links.a)"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII string: one step for each bit of it, a byte entering at every eighth."""
    steps = f"list_filter(flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda b: true)"
    return f"xor(list_reduce({steps}, lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295)"


def _plus(held: str, cost: str, edit: str) -> str:
    """A (cost, audit) held as twelve digits and letters, with one more edit; null stays null."""
    return f"(lpad(CAST(CAST(left({held}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({held}, 13) || '{edit}')"


def _stay(held: str, edit: str, initial: str = "") -> str:
    """What keeping (only messages of this initial) or renaming a message makes of a state; null for blank and duplicate ones."""
    fits = f" AND initial = '{initial}'" if initial else ""
    return f"CASE WHEN fault IN (0, 3){fits} THEN {_plus(held, f'{int(edit == "R")} + CASE fault WHEN 3 THEN 5 ELSE 0 END', edit)} END"


ORACLES: dict[str, str] = {
    "op4_vector_codes": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings),
        sized AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM nodes WHERE label IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sized x JOIN sized y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
                  WHERE list_dot_product(x.v, y.v) / (x.s * y.s) >= 0.98),
        {_LEAST.format(id="vec_id")},
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), least_ AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM nodes LEFT JOIN counts ON a = vec_id JOIN least_ ON id = vec_id""",
    "op7_ngram_jaccard": f"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        nodes AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS grams FROM words),
        grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM nodes),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
                  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        {_LEAST.format(id="doc_id")},
        least_ AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT doc_id, len(grams) AS n_shingles, component_id FROM nodes JOIN least_ ON id = doc_id""",
    "op9_line_dedup": f"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
        judged AS (SELECT doc_id, pos, line, owner IS NULL OR owner = doc_id AS stays FROM keyed LEFT JOIN owners USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_decontamination": """
        WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
        bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        tests AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM bw WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM tests),
        places AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw JOIN sizes ON len(w) >= n),
        windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
        hits AS (SELECT doc_id, windows.n, i, item_id FROM windows JOIN tests ON windows.g = tests.g AND windows.n = tests.n),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) WHERE item IS NOT NULL GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN listed ON listed.doc_id = dw.doc_id""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
        counted_rows AS (SELECT *, rtrim(text, {_BLANK}) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM counted_rows),
        judged AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
        layers AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS n, CAST(NULL AS VARCHAR) AS s, '000000000005I' AS u, '000000000010II' AS a FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL
          SELECT conv_id, i, n, s, u, least(a, {_plus("u", "5", "I")}) AS a FROM (
            SELECT conv_id, i, n, s, least(u, {_plus("n", "5", "I")}, {_plus("s", "5", "I")}, {_plus("a", "5", "I")}) AS u, a FROM (
              SELECT layers.conv_id, judged.i, {_plus("n", "2", "D")} AS n, least({_plus("s", "2", "D")}, {_stay("n", "K", "s")}) AS s,
                least({_plus("u", "2", "D")}, {", ".join(_stay(x, "K", "u") + ", " + _stay(x, "R") for x in "nsa")}) AS u,
                least({_plus("a", "2", "D")}, {_stay("u", "K", "a")}, {_stay("u", "R")}) AS a
              FROM layers JOIN judged ON judged.conv_id IS NOT DISTINCT FROM layers.conv_id AND judged.i = layers.i + 1))),
        ended AS (SELECT conv_id, arg_max(least(n, a), i) AS held FROM layers GROUP BY conv_id),
        edits AS (SELECT conv_id, unnest(string_split(substr(held, 13), '')) AS edit, generate_subscripts(string_split(substr(held, 13), ''), 1) AS k FROM ended WHERE length(held) > 12),
        numbered AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS nth, sum((edit <> 'D')::INT) OVER w AS place FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        met AS (SELECT e.conv_id, place, edit, j.role AS own, CASE WHEN edit = 'I' THEN '' ELSE j.text END AS text FROM numbered e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.nth WHERE edit <> 'D'),
        opened AS (SELECT *, coalesce(max((place = 1 AND edit = 'K' AND left(own, 1) = 's')::INT) OVER (PARTITION BY conv_id), 0) AS opens FROM met),
        repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN own WHEN (place - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS said FROM opened GROUP BY conv_id),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                      count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
        SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(left(held, 12) AS BIGINT) AS cost, substr(held, 13) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM ended LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ended.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ended.conv_id""",
}
