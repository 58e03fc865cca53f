"""Wrappers: they accept every page they were made of, and the main text against a plain reading of the pages' markup."""

import html
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galvan.llm import wrappers

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, host string, rule string, text string, task bigint"


def tree_of(page):
    """The page's balanced stream as nested lists [name, children]; a text is "#"."""
    stack = [["", []]]
    for kind, value, _ in wrappers.events(page):
        if kind == "text" and value.strip():
            stack[-1][1].append("#")
        elif kind == "open":
            stack.append([value, []])
        elif kind == "close":
            node = stack.pop()
            stack[-1][1].append(node)
    assert len(stack) == 1
    return stack[0][1]


def accepts(content, children):
    """Whether the expression accepts the children, by the regular expression of its names, and each of them inside."""
    names = {x[0]: chr(256 + i) for i, x in enumerate(wrappers.leaves(content))}
    inner = {x[0]: x[1] for x in wrappers.leaves(content)}
    one = lambda x: re.escape(names[x[0]]) + (("*" if x[2] else "+") if x[3] else "?" if x[2] else "")
    shape = "".join(f"[{''.join(names[x[0]] for x in unit[1])}]*" if unit[0] == "*" else one(unit) for unit in content)
    seen = ["#" if c == "#" else c[0] for c in children]
    return len(names) == len(inner) and all(s in names for s in seen) and re.fullmatch(shape, "".join(names[s] for s in seen)) is not None and all(accepts(inner[c[0]], c[1]) for c in children if c != "#")


TAGS = ["p", "div", "ul", "li", "h1", "section", "b", "br", "td", "article", 'div class="ad"', 'span class="share"']
PIECES = st.lists(st.one_of(st.sampled_from(TAGS).map(lambda t: f"<{t}>"), st.sampled_from(TAGS).map(lambda t: f"</{t.split()[0]}>"), st.sampled_from(["x", "two words", " ", "a < b", "&amp;"])), max_size=25).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(PIECES, min_size=1, max_size=6))
def test_wrapper_accepts_its_pages(pages):
    each = [wrappers.expression(p) for p in pages]
    for p, e in zip(pages, each, strict=True):
        assert accepts(e, tree_of(p))
    whole = each[0]
    for e in each[1:]:
        whole = wrappers.merged(whole, e)
    half = wrappers.expression("")
    for e in reversed(each):
        half = wrappers.merged(json.loads(json.dumps(e)), half)
    for p in pages:
        assert accepts(whole, tree_of(p)) and accepts(half, tree_of(p))
    # what slots held is summed in any order
    assert sorted(map(str, slots(whole))) == sorted(map(str, slots(half)))
    wrappers.pattern(whole)
    wrappers.rule(whole)


def slots(content, path=()):
    return [x for leaf in wrappers.leaves(content) for x in ([(path, leaf[1])] if leaf[0] == "#" else slots(leaf[1], (*path, leaf[0])))]


def test_alignment():
    a = wrappers.expression("<body><h1>x</h1><p>a</p><p>b</p></body>")
    b = wrappers.expression("<body><h1>y</h1><p>a</p><div>z</div></body>")
    assert wrappers.pattern(a) == "<body><h1>#</h1>(<p>#</p>)+</body>"
    assert wrappers.pattern(wrappers.merged(a, b)) == "<body><h1>#</h1>(<p>#</p>)+(<div>#</div>)?</body>"
    swapped = wrappers.expression("<body><p>a</p><h1>y</h1></body>")
    assert wrappers.pattern(wrappers.merged(a, swapped)) == "<body>((<h1>#</h1>)?(<p>#</p>)?)*</body>"
    assert wrappers.pattern(wrappers.expression("<ul><li>1<li>2<li><p>3<p>4</ul>")) == "<ul>(<li>(#)?(<p>#</p>)*</li>)+</ul>"


def test_generated_class_names_stay_bounded():
    letters = [a + b + c for a in "abcdefg" for b in "hijklmn" for c in "opqrst"]
    whole = wrappers.expression("")
    for x in letters:
        whole = wrappers.merged(whole, wrappers.expression(f'<body><div class="{x}">text {x}</div><article><p>own {x}</p></article></body>'))
    assert len(json.dumps(whole)) < 20_000
    assert wrappers.main_text('<body><div class="zzz">t</div><article><p>mine</p></article></body>', json.loads(json.dumps(wrappers.rule(whole)))) == "mine"


def plain(page):
    """Main text of the tables' pages: the inside of `article` cut at its block tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_pages_of_the_table(spark, data):
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r for r in wrappers.query(spark, data).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


SITE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p > b {{}}</style></head><body class="menu-open"><header><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href=/a>Home</a><li>More</ul></nav><div class="layout with-sidebar"><article class="post-{0} comments-open"><h1>Title&nbsp;&#{1};{0}</h1><p class=lead>One  <b>bo</b>ld<br>line &lt;{0}&gt;
<p>Two <span class="share">Share!</span>rest<div class="ad-slot">Buy</div><ul><li>i<li>ii</ul><form><p>Name<input></form><script>var x = "</article><p>no</p>";</script><!-- <p>no</p> -->
<section class="comments"><p>Nice post {0}</p></section></article><aside>Side {0}</aside></div><footer>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings(spark):
    rows = [(i, f"http://u:p@Site.example:80/{i}", SITE.format(i, 65 + i), "h", "r", "t", 1) for i in range(5)]
    rows += [(5, "http://site.example/x", None, "h", "r", "t", 1), (6, None, "", "h", "r", "t", 1), (None, "no url", "<p>only", "h", "r", "t", 1), (1, rows[1][1], rows[1][2], "h", "r", "t", 1), (7, "http://site.example/y", "<article>a < b <!-- open", "h", "r", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = wrappers.extract(df, wrappers.infer(df)).collect()
    want = {i: f"Title {chr(65 + i)}{i}\nOne bold line <{i}>\nTwo rest\ni\nii" for i in range(5)} | {5: "", 6: "", None: "only", 7: "a < b"}
    assert len(got) == len(rows) and {(r.page_id, r.text) for r in got} == set(want.items()) and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_pages for r in wrappers.infer(df).filter("host = 'site.example'").collect()} == {7}


def test_without_article(spark):
    page = '<body><div class="top">Welcome to us</div><div><a href="/">Home</a></div><div class="text"><p>{0} is a long story that differs.</p><p>Second of {0}, as long as that.</p><p>Always the same words</p></div></body>'
    df = spark.createDataFrame([(i, "http://h.example/", page.format(f"Page {i}"), "", "", "", 0) for i in range(4)], SCHEMA)
    got = {r.page_id: r.text for r in wrappers.extract(df, wrappers.infer(df)).collect()}
    assert got == {i: f"Page {i} is a long story that differs.\nSecond of Page {i}, as long as that.\nAlways the same words" for i in range(4)}


def test_merging_by_levels_and_joins(spark, monkeypatch):
    want = {r.page_id: r.text for r in wrappers.query(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").repartition(9)
    monkeypatch.setattr(wrappers, "FAN", 2)
    found = wrappers.infer(pages)
    assert found.count() == found.select("host").distinct().count() and found.agg({"n_pages": "sum"}).first()[0] == pages.count()
    for limits in ({"BROADCAST_BYTES": 0}, {"BROADCAST_BYTES": 4000, "HOT_HOSTS": 4, "HOT_PAGES": 1}):
        for k, v in limits.items():
            monkeypatch.setattr(wrappers, k, v)
        assert {r.page_id: r.text for r in wrappers.extract(pages, found).collect()} == want


def test_no_rows_and_long_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert wrappers.extract(none, wrappers.infer(none)).collect() == []
    deep = "<div>" * 3000 + "<article>" + "<p>word</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "http://x.example", deep, "", "", "", 0), (2, "http://y.example", "<article>" + "<p>word <i>more</i>" * 50_000, "", "", "", 0)], SCHEMA)
    got = {r.page_id: r.text for r in wrappers.extract(df, wrappers.infer(df)).collect()}
    assert got[2] == "\n".join(["word more"] * 50_000) and got[1] == "\n".join(["word"] * 20_000)
