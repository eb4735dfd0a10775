import os
import re
import time
import zlib
from html.parser import HTMLParser

import pytest

from lakeglean.llm import htmltext
from lakeglean.llm.htmltext import Weights, extract

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """The text of ``article`` elements, block by block, by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]
        self.feed(html)
        self.close()

    def edge(self, tag):
        if tag in htmltext.BLOCK:
            self.blocks.append("")

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        self.edge(tag)
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.edge(tag)
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


@pytest.fixture(scope="module")
def pages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no table")
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r["page_id"]).encode()) % 2]
    ids = [r["page_id"] for r in held]
    return held, spark.read.parquet(f"{SF}/pages.parquet").where(f"page_id NOT IN ({','.join(map(str, ids))})")


def exact_share(held, weights, change=lambda x: x):
    return sum(extract(change(r["html"]), weights) == Article(r["html"]).text() for r in held) / len(held)


def renamed(html):
    return re.sub(r"(</?)(?:article|main)\b", r"\1div", html)


def test_held_out_pages(pages):
    held, train = pages
    for prior in (None, {}):  # with the prior names, and with all names learned
        weights = htmltext.fit(train, prior=prior)
        assert exact_share(held, weights) >= 0.95
        assert exact_share(held, weights, renamed) >= 0.95
        # it is the weights and the scan that find the text
        assert exact_share(held, Weights(features={}, start=1.0, tags={}, other_tag=0.0)) < 0.05
        whole = [" ".join(extract(r["html"], Weights(features={}, start=1.0, other_tag=0.0)).split()) for r in held]
        assert sum(w == " ".join(extract(r["html"], weights).split()) for w, r in zip(whole, held, strict=True)) < 0.05 * len(held)


def test_scan_leaves_far_islands_and_keeps_what_is_between():
    text = "<p>" + "word " * 30 + "</p>"
    island = "<p>short note</p>"
    apart = "<div><ul>" + "<li><a href=x>go</a></li>" * 12 + "</ul></div>"
    page = f"<body>{island}{apart}<div>{text}<ul><li>one</li><li>two words</li></ul>{text}</div>{apart}{island}</body>"
    w = Weights(tags={"p": -0.5, "ul": -0.5, "li": -0.5, "div": -1.0, "a": -1.0, "body": -0.1})
    got = extract(page, w).split("\n")
    assert got == [("word " * 30).strip(), "one", "two words", ("word " * 30).strip()]


def test_classes_around_the_article_and_parts_inside():
    for attrs in ('class="sidebar-left"', 'class="layout has-sidebar"', 'id="widget"', 'class="share comments"'):
        assert extract(f"<div {attrs}><p>menu</p><article><p>one two three four</p></article></div>", Weights()).endswith("one two three four")
    for part in ('<div class="ad">x y</div>', '<aside><p>x</p></aside>', '<section id="comments"><p>x y z</p></section>', "<form>x <input> y</form>", "<footer>x</footer>", '<div role="alert">x</div>', "<nav><li>x</nav>", "<div hidden>x</div>", "<script>x</script>", "<style>x</style>", "<!-- x -->", "<select><option>x</select>"):
        assert extract(f"<article><p>one two three</p>{part}<p>four five six</p></article>", Weights()) == "one two three\nfour five six"
    assert extract('<main><p>a <a href="x">link here</a> in text &lt;b&gt; &amp;c</p></main>', Weights()) == "a link here in text <b> &c"


@pytest.mark.parametrize("piece", ['<p class="foo>word ', "<b>", "</i>", "<b><p>", "<li><p>w", "<p a='x\" b=\"y'>", "<!--", "< ", "<div class=x", "<article>", "<td><p><dt>", "<a '>", "<div class='a{i}b c{i}'>w ", "<script>", "&amp"])
def test_linear_time(piece):
    def took(n):
        source = "".join(piece.replace("{i}", chr(97 + i % 26) * (1 + i // 26 % 40)) for i in range(n // len(piece)))
        began = time.process_time()
        extract(source, Weights())
        return time.process_time() - began

    took(10_000)
    assert took(400_000) < max(0.4, 4 * 2.5 * took(100_000))


def test_broken_markup():
    assert extract('<article><p title="a > b">one two three <p class="x>four', Weights()) == "one two three\nfour" or extract('<article><p title="a > b">one two three', Weights()) == "one two three"
    assert extract("<article><p>one two three</div></b>four</p></article>", Weights()) in ("one two three four", "one two three\nfour", "one two threefour")
    assert extract("a < b and c", Weights(start=1.0)) == "a < b and c"
    assert extract("<article><b><p>one two three</b></p>four five", Weights()) == "one two three\nfour five"


def test_fit_without_both_sides_and_repeats(spark):
    rows = [(1, "u", "<nav>menu</nav><article><p>hello world again</p></article>")] * 3 + [(2, "v", None), (None, None, "<p>no label</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, h string, text int")
    assert htmltext.fit(df).features["<p>"] > htmltext.PRIOR["<p>"]
    assert htmltext.fit(df.where("page_id = 2")).features == htmltext.PRIOR
    got = htmltext.extracted(df, htmltext.fit(df)).collect()
    assert sorted(r["text"] for r in got) == ["", *["hello world again"] * 3, "no label"]
