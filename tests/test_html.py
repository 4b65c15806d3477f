"""HTML text and links against a parser with a stack, and on broken pages."""

import html
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidentia.operators import html as H
from tests.conftest import SF


class Stack(HTMLParser):
    """The same rules by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.skip, self.out, self.raw = [], 0, [], None

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in H.RAW.split("|"):
            self.raw = tag
            return
        if tag in ("br", "hr"):
            self.put("\n")
        elif tag in H.FRAMED:
            self.put("\n" if tag not in H.CELLS else "")
            if tag in ("p", "li") and self.stack and self.stack[-1] == tag:
                self.stack.pop()
                if self.skip and len(self.stack) < self.skip:
                    self.skip = 0
            self.stack.append(tag)
            if not self.skip and tag in H.SKIPPED:
                self.skip = len(self.stack)

    def handle_endtag(self, tag):
        if self.raw:
            if tag == self.raw:
                self.raw = None
            return
        if tag in H.FRAMED and tag != "hr":
            self.put("\t" if tag in H.CELLS else "\n")
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass
                if self.skip and len(self.stack) < self.skip:
                    self.skip = 0

    def handle_data(self, data):
        if not self.raw:
            self.put(re.sub(r"[\n\r\t\f ]+", " ", data))

    def put(self, text):
        if not self.skip:
            self.out.append(text)


def brute(page):
    p = Stack()
    p.feed(page)
    p.close()
    t = re.sub(r" ?\t ?", "\t", re.sub(r"[\xa0 ]+", " ", "".join(p.out)))
    t = re.sub(r" ?\t[ \t]*(?=\n|$)", "", t)
    return re.sub(r" ?\n[ \n]*", "\n", t).strip(" \n\t")


def texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r["t"] for r in df.select("id", H.html_text(F.col("html")).alias("t")).orderBy("id").collect()]


def test_supplied_pages(spark):
    pages = [r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    assert texts(spark, pages) == [brute(p) for p in pages]


BROKEN = {
    "<nav>a<nav>b</nav>c</nav>d": "d",
    "<div><nav><ul><li>menu</div><p>text": "text",
    "<article><header><h1>head</h1></header><p>one<p>two <b>bold</b></article><aside>x<aside>y</aside></aside>end": "one\ntwo bold\nend",
    "</nav>text</div> on": "text\non",
    "<table><tr><td>a<td>b</td></tr><tr><td> c </td><td>d</td></tr></table>": "ab\nc\td",
    "x<script>var a = '</p>'; if (a<b) {}</script>y<style>p{}</style>z<script>never closed <p>w": "xyz",
    "a <!-- <p>no</p> --> b<!-- open": "a b",
    "1 < 2 and 3 > 2 &amp; &#65;&#x42;&nope; &lt;p&gt; &#0; &euro;&AMP;": None,
    "<p title='a > b'>quoted</p><P CLASS=x>caps<BR/>line": "quoted\ncaps\nline",
    "<nav/>kept": "kept",
    "": "",
    "<p>" * 300 + "deep" + "</div>" * 300: "deep",
    "<div>" * 200 + "<footer>" + "<div>" * 5 + "f" + "</div>" * 5 + "</footer>g": "g",
}


def test_broken_pages(spark):
    got = dict(zip(BROKEN, texts(spark, list(BROKEN)), strict=True))
    want = {k: v for k, v in BROKEN.items() if v is not None}
    assert {k: got[k] for k in want} == want
    assert got["1 < 2 and 3 > 2 &amp; &#65;&#x42;&nope; &lt;p&gt; &#0; &euro;&AMP;"] == "1 < 2 and 3 > 2 & AB&nope; <p> &#0; €&AMP;"
    assert texts(spark, [None]) == [None]


def test_long_attributes_and_texts(spark):
    page = f'<p data-x="{"y" * 300_000}">start</p>' + "<p>word</p>" * 5_000 + "<" * 5_000
    assert texts(spark, [page])[0] == "start\n" + "word\n" * 5_000 + "<" * 5_000


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<a href='/a?x=1&amp;y=2' class=b>one</a><a class=\"k > l\" href=\"/b\"><b>two</b> <i>three</i></a>", [("/a?x=1&y=2", 1, "one"), ("/b", 2, "two three")]),
        ("<a href=/c rel=nofollow>four</a><a name=x>no link</a><A HREF = '/d'\n>five\n six</A >", [("/c", 1, "four"), ("/d", 2, "five six")]),
        ("<a href='/e'>first</a><a href='/e'>again</a><!-- <a href='/f'>c</a> --><a data-href='/g'>no</a><a href=''>empty</a>", [("", 3, "empty"), ("/e", 1, "first")]),
        ("<a href='/h'>open <a href='/i'>next</a> <abbr href='/j'>no</abbr><article href=/k></article>", [("/h", 1, "open"), ("/i", 2, "next")]),
        (None, []),
    ],
)
def test_links(spark, page, want):
    got = H.html_links(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").collect()
    assert sorted((r["href"], r["ord"], r["label"]) for r in got) == want


def test_front_matter(spark):
    text = "---\ntitle: \"A title: with colon\"\nдата: 'x'\ntags:\n  - one\n  - \"two, three\"\n\t- four\nempty:\nlist: [a, 'b, c', \"d\"]\nurl: http://x/y\n---\nbody: no\n"
    df = spark.createDataFrame([(1, text), (2, text.replace("\n", "\r\n")), (3, "no head\n---\na: b\n---\n"), (4, None), (5, "---\nopen: never\n")], "id int, t string")
    got = {}
    for r in sorted(H.front_matter(df, "id", "t").collect(), key=lambda r: (r["id"], r["field"], r["ord"])):
        got.setdefault(r["id"], {}).setdefault(r["field"], []).append(r["value"])
    want = {"title": ["A title: with colon"], "дата": ["x"], "tags": ["one", "two, three", "four"], "empty": [""], "list": ["a", "b, c", "d"], "url": ["http://x/y"]}
    assert got == {1: want, 2: want}


def test_references_are_those_of_the_standard(spark):
    df = spark.createDataFrame([(f"&{k};",) for k in H.NAMED], "r string")
    assert all(r["d"].replace(" ", "\xa0") == html.unescape(r["r"]).replace(" ", "\xa0") for r in df.select("r", H.decoded(F.col("r")).alias("d")).collect())
