import corpus_pipeline as cp
from lexvane.llm.mixing import MixParams
from tests.conftest import SF
from tests.llm.test_native import brute_lines
from tests.llm.test_ngram_join import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    every = {r.doc_id: r for r in docs.collect()}
    clean = cp.drop_toxic(spark, docs, SF).persist()
    ids = {r.doc_id for r in clean.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert clean.columns == cp.COLUMNS and ids < set(every)
    assert sum(labels.get(i) == 0 for i in ids) > 0.9 * sum(v == 0 for v in labels.values())
    lines = cp.drop_repeated_lines(spark, clean, SF).persist()
    got = sorted(((r.doc_id, r.text) for r in lines.collect()), key=str)
    assert got == [(i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in clean.collect()])]
    one = cp.keep_one_of_each_group(spark, lines, SF).persist()
    want = [(i, c) for i, _, c in brute([(r.doc_id, r.text) for r in lines.collect()], 5, 80)]
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in want if i == c)
    mixed = cp.sample_sources(spark, one, SF).persist()
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in one.collect()}
    tokens = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(tokens(mixed) / tokens(one) - MixParams().keep) < 0.2
    packed = cp.pack(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]


def test_odd_rows(spark, odd, nothing):
    odd = odd.selectExpr(*cp.COLUMNS)
    for docs in (odd, nothing.selectExpr(*cp.COLUMNS)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
    assert cp.keep_one_of_each_group(spark, odd, SF).where("doc_id = 7").count() == 0
    assert cp.keep_one_of_each_group(spark, odd, SF).where("doc_id = 6").count() == 1


def test_copies_under_repeated_ids(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long), (3, "quite another text of its own with some words"), (3, long + " more"), (4, long), (4, long.replace("word7", "x")), (5, None), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.keep_one_of_each_group(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, long), (3, rows[1][1]), (5, ""), (5, " ")]
