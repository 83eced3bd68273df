from collections import Counter

from lexvane.llm.line_dedup import dedup_lines
from lexvane.llm.sharding import ShardParams, shard_by_sampled_splitters

_BLANK = " \t\n\x0b\x0c\r"


def _lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot', 40) ELSE repeat(sha2(cast(id AS string), 256), 1 + cast(id % 7 AS int)) END AS text")
    rows = shard_by_sampled_splitters(docs).collect()
    assert len(rows) == 3000
    by = Counter()
    for r in rows:
        by[r.shard] += r.size
    assert set(by) == set(range(16))
    assert max(by.values()) - min(by.values()) <= 2 * max(r.size for r in rows)
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    # Equal texts stand together: their shards follow one another.
    hot = sorted({r.shard for r in rows if r.doc_id % 3 == 0})
    assert hot == list(range(hot[0], hot[-1] + 1))


def test_overfull_ranges_are_cut_again(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'one text for all' AS text")
    rows = shard_by_sampled_splitters(docs, params=ShardParams(samples_per_range=1, ranges_per_shard=4)).collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1


def test_sharding_odd_rows(odd, nothing):
    rows = shard_by_sampled_splitters(odd).collect()
    assert len(rows) == odd.count()
    assert next(r for r in rows if r.doc_id == 3).size == 1
    assert shard_by_sampled_splitters(nothing).count() == 0


def brute_lines(rows, min_chars=10):
    last = 2**63 - 1
    own = {}
    for i, text, *_ in rows:
        i = last if i is None else i
        for line in (text or "").split("\n"):
            k = _lower(line.strip(_BLANK))
            if len(k) >= min_chars:
                own[k] = min(own.get(k, i), i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := _lower(x.strip(_BLANK))) < min_chars or own[k] == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(odd, nothing):
    got = dedup_lines(odd, batches=3, fanout=2).selectExpr("doc_id", "_n_lines", "n_dropped", "coalesce(text, '') AS text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines([tuple(r) for r in odd.collect()])
    assert dedup_lines(nothing).count() == 0
    assert dedup_lines(odd).columns == [*odd.columns, "_n_lines", "n_dropped"]


def test_runs_are_joined_and_merged_without_shuffling_them(spark):
    from pyspark.sql import functions as F

    from lexvane.llm.line_dedup import LevelledRuns, line_hash

    lines = spark.range(900).select(line_hash(F.concat(F.lit("line "), (F.col("id") % 400).cast("string"))).alias("h"), "id")
    batch = lambda k: lines.where(f"id DIV 300 = {k}").groupBy("h").agg(F.min("id").alias("owner"))
    runs = LevelledRuns(spark, fanout=3)
    try:
        runs.add(batch(0))
        runs.add(batch(1))
        # Only the lines are shuffled and sorted, once for each run; the runs are read in order.
        plan = runs.owners(lines)._jdf.queryExecution().executedPlan().toString()
        assert len(runs.names()) == 2 and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2
        runs.add(batch(2))
        assert len(runs.names()) == 1
        got = {r.id: r.owner for r in runs.owners(lines).collect()}
        assert got == {i: i % 400 for i in range(900)}
    finally:
        runs.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_long_document_of_repeated_lines(spark):
    own = "\n".join(f"a line of number {k}" for k in range(20_000))
    rows = [(1, own), (2, "first of its own\n" + own + "\n\nlast of its own"), (2, "other text of 2\n" + own), (3, own)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(df).selectExpr("doc_id", "n_lines", "n_dropped", "coalesce(text, '') AS text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def brute_shards(rows, shards=16):
    """(size, crc32 of the text) of every row, and the shares of bytes: shards differ by no more than two of the largest rows."""
    import zlib

    return sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)


def test_sharding_matches_brute_force(spark, odd):
    rows = [(None, "", 1)] * 400 + [(7, "the same text", 1)] * 300 + [(k, f"text {k} " * (k % 9), 1) for k in range(300)] + [(None, None, 1), (5, "é" * 50, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, r int").repartition(5)
    for data, params in ((df, ShardParams()), (df, ShardParams(ranges_per_shard=8, samples_per_range=2)), (odd, ShardParams())):
        got = shard_by_sampled_splitters(data, params=params).collect()
        want = brute_shards([(r.doc_id, r.text) for r in data.collect()])
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        by = Counter()
        for r in got:
            by[r.shard] += r["size"]
        assert all(0 <= s < 16 for s in by)
        due, most = sum(by.values()) / 16, max(x[1] for x in want)
        assert all(abs(by[s] - due) <= most for s in range(16))
    # Repeated rows are cut into several ranges like any others.
    got = shard_by_sampled_splitters(df, params=ShardParams(ranges_per_shard=8)).collect()
    assert len({r.range_id for r in got if r.doc_id == 7}) > 1
