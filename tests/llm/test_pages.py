"""Pages that wrap their text in odd ways, hostile pages, and what the style tree decides."""

import random
import re
import time

import duckdb
import pytest

from sightline.llm import html_extract
from sightline.llm.html_extract import extract, main_text, parse

PROBES = [
    ("<html><body><form><article><h1>T</h1><p>Body</p></article><input></form></body></html>", "T Body"),
    ("<html><body><form action='/x'><div><h1>T</h1><p>Body of it</p></div><input type=text><select><option>a</select></form></body></html>", "T Body of it"),
    ("<body><p>Body text that is longer.</p><form><p>Your name</p><input></form></body>", "Body text that is longer."),
    ("<div class='layout sidebar-left'><p>Body</p></div>", "Body"),
    ("<div class='has-footer no-sidebar'><h2>A</h2><p>Body</p></div>", "A Body"),
    ("<main><h1>Title</h1><p>intro</p><article><p>art</p></article><p>outro</p></main>", "Title intro art outro"),
    ("<main><article><p>art</p></article><ul><li><a href=x>more</a></li></ul><div class='related'><p>x</p></div><article class='teaser'>t</article></main>", "art"),
    ("<main><h1>T</h1><article><p>one</p><nav>x</nav></article><article><p>two</p></article></main>", "T one two"),
    ("<article><blockquote><p>Q</p><footer>cite</footer></blockquote><footer>x</footer></article>", "Q cite"),
    ("<article><p>Text</p></article><section class='user-discussion'><article><p>I say</p></article></section>", "Text"),
    ("<article><p>Text</p><section class='discussion'><p>What it means</p></section></article>", "Text What it means"),
    ("<div id=a><p>Real text of the page.</p></div><div class='comments'><p>" + "many words of readers " * 50 + "</p></div>", "Real text of the page."),
    ("<div hidden><p>x</p></div><p>seen</p>", "seen"),
]


@pytest.mark.parametrize("page,text", PROBES)
def test_odd_wrappers(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("bad,seconds", [('<a "' * 1_300_000, 2), ("<a '" * 1_300_000, 2), ('<a ">x"' * 100_000, 4), ("<a \"'>" * 100_000, 4), ("<!--" * 1_000_000, 2), ("<script>" * 500_000, 2)])
def test_unclosed_quotes_in_linear_time(bad, seconds):
    start = time.perf_counter()
    main_text(bad)
    assert time.perf_counter() - start < seconds


@pytest.mark.parametrize("make", [lambda n: "<span>" * n + "</x>" * n, lambda n: "<p><ul>" + "<span>" * n + "</p>" * n, lambda n: "<ul>" * n + "<li>x", lambda n: "<div class=sidebar>" * n + "x", lambda n: "<b><p>" * n, lambda n: "<table><tr><td>" * n + "x"])
def test_deep_pages_take_time_in_proportion(make):
    def took(n):
        start = time.perf_counter()
        main_text(make(n))
        return time.perf_counter() - start

    took(1_000)
    assert took(40_000) < 10 * max(took(10_000), 0.05)


WORDS = "stone river cloud light paper house garden winter music window letter ocean bridge forest mirror".split()


def soup(r, host, i):
    """A page without telling names: a banner, a menu, a notice and an imprint that the site repeats, and its own text."""
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    body = [f"{say(9)} {i}." for _ in range(r.randint(2, 5))]
    html = (f"<html><body><div><div>The {host} daily</div><ul><li><a href=/a>Home {host}</a><li><a href=/b>World</a></ul></div><div><p>Read our terms on {host}, which we have changed.</p></div>"
            f"<div><h1>{say(4)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div><p>Imprint of {host}, all rights with it.</p></div></body></html>")
    return html, " ".join([re.search("<h1>(.*?)</h1>", html)[1], *body])


def test_the_tree_decides_where_names_do_not(spark):
    r = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        page, want[k] = soup(r, f"h{k % 3}", k)
        rows.append((k, f"http://h{k % 3}.example.org/{k}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in extract(pages).collect()} == want
    low = {}
    for x in html_extract.unimportant_paths(pages).collect():
        low.setdefault(x.host, set()).add(x.path)
    removed = 0
    for k, url, page in rows:
        root = parse(page)
        quiet = html_extract._noise(root, frozenset(low[re.search("//([^/]+)", url)[1]]))
        removed += sum(id(x) in quiet and id(x.parent) not in quiet for x in html_extract._walk(root) if x.parent is not None)
        assert main_text(page) != want[k]  # without the tree the repeated parts stay
    assert removed >= 3 * len(rows)


def test_given_pages_without_names(spark):
    """The given pages without their telling elements, on a site of their own with parts that repeat: what the tree takes away is those parts."""
    rows, want = [], {}
    for page_id, html in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id LIMIT 120").fetchall():
        own = re.search("<article>(.*)</article>", html, re.S)[1]
        rows.append((page_id, "http://one.example.org/x", f"<html><body><div>The daily paper<ul><li><a href=/>Home</a><li><a href=/w>World</a></ul></div><div>{own}</div><div>All of it is ours.</div></body></html>"))
        want[page_id] = main_text(f"<article>{own}</article>")
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == want


def test_small_sites_keep_what_repeats(spark):
    rows = [(k, "http://few.example.org/", "<html><body><div><p>Same on both.</p></div></body></html>") for k in range(2)]
    assert [x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["Same on both."] * 2
