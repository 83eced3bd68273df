import html
import re

import numpy as np
import pytest

from lexvane.llm.html_extract import HtmlParams, Labeller, blocks_of, extract_pages, labelled, main_texts, padded, trained
from tests.conftest import SF


def article(page):
    """Main text by the layout that the tables' pages share."""
    a, z = page.find("<article>"), page.find("</article>")
    body = page[a + 9 : z if z >= 0 else None]
    body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", body)))
    return "\n\n".join(x for x in (" ".join(html.unescape(s).split()) for s in body.split("\0")) if x)


def test_gradients_match_differences():
    model = Labeller(HtmlParams(hidden=3, embed=4))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    xs, ys = labelled(1, 3)
    x, mask = padded([v[:6] for v in xs])
    y = np.zeros(mask.shape)
    for k, v in enumerate(ys):
        y[: len(v[:6]), k] = v[:6]
    _, g = model.gradients(x, mask, y)
    for name in ("e", "fx", "bh", "bb", "o"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, step, losses = model.w[name][at], 1e-2, []
        for d in (step, -step):
            model.w[name][at] = keep + d
            losses.append(model.gradients(x, mask, y)[0])
        model.w[name][at] = keep
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[name][at], rel=0.02, abs=1e-5)


def test_held_out_layouts():
    xs, ys = labelled(4321, 200)
    said = trained().keep(xs)
    assert np.mean(np.concatenate(said) == (np.concatenate(ys) > 0)) > 0.97


def test_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in df.collect()}
    for r in extract_pages(df).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_blocks():
    assert [t for _, t, _ in blocks_of("<p>a &amp; b&nbsp; c<br>d<p>e <b>f</b>g<!-- x --><script>if (a < b) '</p>'</script> h &lt;i&gt; 1 < 2<div class='x")] == ["a & b c d", "e fg", "h <i> 1 < 2"]
    assert blocks_of("") == [] and blocks_of("<") == [("", "<", 0.0)]
    assert blocks_of("<div class=ad><ul id='Top Menu'><li><a href=x>q</a></ul>z")[0] == ("div .ad ul .top .menu li a", "q", 1.0)
    assert len(blocks_of("<p>x " * 5000)) == 5000


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<article><p>" + "text of some length, said plainly. " * 20000 + "</p></article>"), (4, "w", "no tags at all"), (5, "x", "<<<>>> &#0; &bogus; <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS text", "3 AS n_chars")
    out = extract_pages(df).collect()
    assert sorted(str(r.page_id) for r in out) == sorted(str(r[0]) for r in rows)
    assert [r.text for r in out if r.page_id in (1, 2)] == [""] * 3
    assert next(r.n_chars for r in out if r.page_id is None) == len(("text of some length, said plainly. " * 20000).strip())
    assert extract_pages(df.where("false")).count() == 0
    assert main_texts([None], trained()) == [""]


def test_deep_pages_cost_what_their_bytes_cost():
    import time

    t0 = time.process_time()
    deep = blocks_of("<div class='a b'>x" * 50_000 + "</span>" * 50_000)
    assert len(deep) == 50_000 and {t for _, t, _ in deep} == {"x"}
    from lexvane.llm.html_extract import vectors

    from lexvane.llm.html_extract import _path_vector

    assert (deep[40][0].vector() == _path_vector(str(deep[40][0]))).all() and (deep[3][0].vector() == _path_vector(str(deep[3][0]))).all()
    v = vectors(deep)
    assert (v[100, :96] == v[-1, :96]).all() and time.process_time() - t0 < 20
    assert main_texts(["<div>" * 3000 + "<article><p>" + "one two three four five six. " * 9 + "</p></article>"], trained()) is not None
