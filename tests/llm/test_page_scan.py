"""Blocks of broken and odd markup, and the field on layouts whose labels no rule has made."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import page_crf as C


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a</p><svg width=1/><p>b</p>", ["a", "b"]),
    ("<p>a <svg><path d='M0'/><text>x</text></svg> b</p>", ["a b"]),
    ("<p>a</p><svg><g><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg><g><p>b</p><svg></svg>c", ["a", "b", "c"]),
    ("<svg><foreignObject><div>no</div></foreignObject></svg><p>a</p>", ["a"]),
    ("<svg><svg><text>no</text></svg><text>no</text></svg>a", ["a"]),
    ("<div><p>a</p><noscript></div><p>b</p>", ["a", "b"]),
    ("<p>a</p><select><option>x<p>b</p>", ["a", "x", "b"]),
    ("<p>a <select><option>x<option>y</select> b</p>", ["a b"]),
    ("<div>a<select><option>x</div><p>b</p><select></select>", ["a", "b"]),
    ("<template><p>no</p></template><p>a</p>", ["a"]),
    ("<noscript><img src=x><p>no</p></noscript>a<noscript>no</noscript>b", ["a b"]),
    ("<p>a</p><script>if (a<b) '</p><p>x'</script><p>b</p>", ["a", "b"]),
    ("<p>a</p><script src=x/><p>b</p>", ["a", "b"]),
    ("<p>a</p><script>x<p>b</p>", ["a"]),
    ("<title>a <b>c</b></title><p>b</p>", ["a <b>c</b>", "b"]),
    ("<p>a</p><textarea><p>b</p>", ["a", "b"]),
    ("<p>a<!-- <p>x --> b<!-->c<!-- <p>d", ["a bc"]),
    ("<p>a<![CDATA[ x > y ]]>b<![CDATA[ x>c", ["abc"]),
    ("<p title=don't>It's</p><p title=\"a>b\">b</p><p title=\"x>c</p>", ["It's", "b", "c"]),
    ("<p>a < b and 3 <4 </p><p>c <", ["a < b and 3 <4", "c <"]),
    ("<p>a</p></svg></p></x>b", ["a", "b"]),
    ("<p>İ</p><script>İ</SCRIPT><p>İb</p>", ["İ", "İb"]),
    ("", []), ("<", ["<"]), ("<p", ["<p"]), ("</", ["</"]), ("<!", ["<!"]),
])
def test_blocks(page, want):
    assert [b.text for b in C.leaf_blocks(page)] == want


@pytest.mark.parametrize("part", [
    "<a ", "<div>", '<a "x>y" ', "</b", "<b><p>", "<a><svg>", "<!x ", "<![CDATA[", '<p class="', "<select>", "<a><div><b></a>", "<b></i>", "<!--",
    "<script>", "<script/>", "<title>", "<svg><p>", "&amp", "<i><li>", "<p id='x' class=\"y", "<p class=x>y", '<a title="x>y">z',
])
def test_long_pages_end(part):
    """Half a megabyte of one piece of markup takes time in proportion."""
    began = time.monotonic()
    for end in ("", "\n text "):
        blocks = C.leaf_blocks((part + end) * (500_000 // len(part + end)))
        C.block_features(blocks)
    assert time.monotonic() - began < 10


def plain(page):
    """The page with the elements that mark an article renamed."""
    for tag in ("article", "main", "section"):
        page = page.replace(f"<{tag}", "<div").replace(f"</{tag}>", "</div>")
    return page


def accuracy(model, pages):
    right = total = 0
    for page in pages:
        blocks = C.leaf_blocks(page)
        got = model.decode([C.block_features(blocks)])[0]
        right += sum(int(a) == (b.label or 0) for a, b in zip(got, blocks))
        total += len(blocks)
    return right / total


@pytest.fixture(scope="module")
def drawn(spark):
    """Layouts of another seed around texts of pages that no model has read, tags renamed."""
    rng = random.Random(99)
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy(F.desc("page_id")).limit(80).collect()]
    texts = [[b.text for b, y in zip(bs, C.plain_labels(bs)) if y] for bs in map(C.leaf_blocks, pages)]
    sentences = [t for ts in texts for t in ts[:2]]
    return [plain(C.laid_out(ts[:25], rng.sample(sentences, 5), rng)) for ts in texts if ts]


def test_drawn_layouts_held_out(sf, drawn):
    assert accuracy(C.trained_field(sf("pages")), drawn) > 0.85


def test_no_page_marks_its_article(sf, drawn):
    """Then layouts drawn around the pages' long blocks train the field; texts are not lost."""
    pages = sf("pages").withColumn("html", F.regexp_replace("html", "(</?)(article|main|section)", "$1div"))
    model = C.trained_field(pages)
    assert accuracy(model, drawn) > 0.8
    marked = {r.page_id: r.text for r in C.main_texts(sf("pages")).collect()}
    got = {r.page_id: r.text for r in C.main_texts(pages, model).collect()}
    words = sum(len(t.split()) for t in marked.values())
    kept = sum(len(set(marked[k].split()) & set(t.split())) / max(len(set(marked[k].split())), 1) for k, t in got.items()) / len(got)
    assert words and kept > 0.8


def test_few_marked_pages_train(sf, spark):
    """Marked pages are looked for in the whole table, copies count once, and long chains are cut, not left out."""
    marked = sf("pages").limit(3).select("page_id", "url", "html").collect()
    other = [(1000 + k, "u", f"<div>page {k}</div>") for k in range(2000)]
    pages = spark.createDataFrame(other + [tuple(r) for r in marked for _ in range(200)], "page_id bigint, url string, html string")
    texts = C.sampled_pages(pages.where(F.col("html").contains("<article")), 240)
    assert sorted(texts) == sorted({r.html for r in marked})
    assert np.abs(C.trained_field(pages).unary).sum() > 0
    long = "<article>" + "<p>Some words of one long article, all in full.</p>" * 200 + "</article>"
    assert sum(len(y) for _, y in C.training_pages([long], layouts=0)) == 200
