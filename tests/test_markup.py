"""Markup as Column expressions against plain versions made from the standard library."""

import html
import json
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from jobloom.functions import markup as M
from jobloom.functions.urls import absolute_url
from tests.conftest import SF


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts += [" ".join(data.split())]


def plain_text(page):
    nodes = _Nodes()
    nodes.feed(page or "")
    nodes.close()
    return " ".join(p for p in nodes.parts if p)


def applied(spark, fn, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", fn("c").alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_every_reference(spark):
    numbers = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 99999999, 10**9, 10**30]
    cells = [f"&{n}" for n in html5] + [f"x&{n[:-1]}y; z" for n in html5] + [f"&#{n};" for n in numbers] + [f"&#x{n:x}&" for n in numbers]
    cells += ["", "&", "&&amp;&", "&#;", "&#x;", "&#xZ;", "a&notit;b&#38", "&" + "a" * 50 + ";", "&#000000000000065;", "&amp;amp;lt;", "\0&lt"]
    assert applied(spark, M.unescaped, cells) == [html.unescape(c) for c in cells]
    assert applied(spark, M.unescaped, [None]) == [None]


PAGES = ["a < b", "a<3", "<style>p>q&amp;</style>&amp;", '<SCRIPT a="</script>">v</SCRIPT >w', '<a href="x>y">z</a>', "<p title=it's>q</p>", "<!DOCTYPE html>x", "<?php x ?>y", "</>x", "</ p>x", "<br/>x<br />y", "a<!-->b-->c", "t  u", "<title>a&amp;<b></title>c", "<p/a='x'>y", "&lt;p&gt;", "", "  ", None]


def test_page_text_equals_the_parser(spark):
    assert applied(spark, M.page_text, PAGES) == [plain_text(p) for p in PAGES]
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html", M.page_text("html").alias("t")).collect():
        assert r["t"] == plain_text(r["html"])


def test_page_text_without_ends(spark):
    assert applied(spark, M.page_text, ["x<p", "x<!--y<b>z", "<script>a<b", "<a href='x>y"]) == ["x", "x", "a<b", "y"]
    long = "<p title=\"a>b\" x='>'>t</p>" * 50_000 + "<script>" + "x<y " * 100_000 + "</script>"
    assert applied(spark, M.page_text, [long]) == [plain_text(long)]


def walked(value):
    if isinstance(value, str):
        return html.unescape(value)
    if isinstance(value, list):
        return [walked(v) for v in value]
    return {k: walked(v) for k, v in value.items()} if isinstance(value, dict) else value


def test_json_strings_at_any_depth(spark):
    cells = ['{"a&amp;b": "x&amp;y", "l":[1,"&lt;\\u0026gt;\\"q\\"\\\\", {"k" : "&eacute;\\n\\t"}], "n": null, "t": true, "f": 1.50}', '"&amp;"', "[]", "3", '{"u": "\\u00e9&copy;\\ud83d\\ude00"}', '{"a": "' + "x\\n&amp;" * 100_000 + '"}']
    assert [json.loads(x) for x in applied(spark, M.unescaped_json, cells)] == [walked(json.loads(c)) for c in cells]
    assert applied(spark, M.unescaped_json, ["{bad", None, ""]) == [None, None, None]


def test_no_python_runs(spark):
    df = spark.createDataFrame([("a",)], "c string").select(M.page_text("c").alias("a"), M.unescaped_json("c").alias("b")).where(F.col("a") != "")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fn", [M.page_text, M.unescaped, M.unescaped_json])
def test_empty_table(spark, fn):
    assert spark.createDataFrame([], "c string").select(fn("c")).collect() == []


def test_absolute_urls_equal_the_library(spark):
    bases = ["https://x.io", "https://x.io/", "https://x.io/list/?page=2", "https://x.io/a/b/c.html?q=1#top", "http://x.io/a//b/"]
    links = ["job/1", "/job/1", "../job", "../../../job", "./a/./b", "a/../b/..", "a/.", "?p=3", "#end", "//y.io/z", "https://z.io/a/../b", "mailto:a@b.c", "", "a//b", "/a//b/../c", "a?x=/../y#z", "/..", "a b"]
    cells = [(b, k) for b in bases for k in links] + [("", "a/b"), ("", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, base string, link string").select("base", "link", absolute_url("base", "link").alias("v")).collect()
    assert {(r["base"], r["link"]): r["v"] for r in rows} == {c: urljoin(*c) for c in cells}
    assert spark.createDataFrame([(None, "a"), ("https://x.io/b", None)], "base string, link string").select(absolute_url("base", "link").alias("v")).toPandas()["v"].tolist() == ["a", "https://x.io/b"]
