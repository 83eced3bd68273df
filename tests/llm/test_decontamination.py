import re

import pytest

from lexvane.llm.decontamination import DecontaminationParams, contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "The quick brown fox, jumps over 12 lazy dogs and É runs Away again"
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "brown fox jumps"), (3, None), (4, " .,! "), (None, "secret word pair"), (5, "zzz"), (6, PASSAGE + " until the day is over")]
TEXTS = [
    (1, "before " + PASSAGE.upper().replace(",", " --") + " after."),
    (2, "brown FOX; jumps! brown fox jumps"),
    (3, "The quick brown fox jumps over 12 lazy cats"),
    (4, None), (5, ""), (6, "!!! ..."), (None, "a secret word pair here"), (None, "a secret word pair here"), (7, "zzz"), (8, "zzzz"),
    (9, "word " * 5000 + "zzz " + "wörd " * 5000), (9, "another text of id nine"),
]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(texts, items, n):
    tests = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(len(w) - min(len(w), n) + 1) if w else []:
            tests.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in texts:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for g, owners in tests.items():
            for k in range(len(w) - len(g) + 1):
                if w[k] == g[0] and tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= {str(x) for x in owners if x is not None}
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def frames(spark):
    docs = spark.createDataFrame([(*r, "x", k, 1, "y") for k, r in enumerate(TEXTS)], "doc_id long, text string, h string, n int, size int, items string").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize(("n", "most"), [(10, 1 << 26), (10, 200), (3, 1000), (1, 1 << 26)])
def test_against_brute_force(spark, n, most):
    docs, items = frames(spark)
    found = []
    for r in contamination(docs, items, params=DecontaminationParams(n, most)).collect():
        found += [(r.doc_id, r.n_words, r.hit, r["items"])] * r.n_rows
    assert sorted(found, key=str) == sorted(brute(TEXTS, ITEMS, n), key=str)


def test_spans_and_documents_go(spark):
    docs, items = frames(spark)
    clean = decontaminate(docs, items)
    assert clean.columns == docs.columns
    texts = {(r.doc_id, r.n): r.text for r in clean.collect()}
    assert len(texts) == len(TEXTS)
    assert texts[1, 0] == "before after." and texts[3, 2] == "The quick over 12 lazy cats"
    assert texts[2, 1] == "" and texts[4, 3] is None and texts[6, 5] == "!!! ..." and texts[7, 8] == "" and texts[8, 9] == "zzzz"
    assert texts[None, 6] == texts[None, 7] == "a here"
    assert texts[9, 10] == ("word " * 5000 + "wörd " * 5000)
    assert sorted(r.n for r in decontaminate(docs, items, "documents").collect()) == [3, 4, 5, 9, 11]
    assert sorted(r.n for r in decontaminate(docs, items, "documents", share=0.5).collect()) == [2, 3, 4, 5, 9, 10, 11]
    with pytest.raises(ValueError, match="how"):
        decontaminate(docs, items, "all")


def test_empty_tables_and_native_plan(spark, odd, nothing):
    _, items = frames(spark)
    assert contamination(nothing, items).count() == 0 and decontaminate(nothing, items).count() == 0
    rows = contamination(odd, items.where("false")).collect()
    assert sum(r.n_rows for r in rows) == odd.count() and all(not r.hit and not r["items"] for r in rows)
    plan = contamination(odd, items)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
