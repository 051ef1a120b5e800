"""The ten operators against brute-force versions, and their defined cases."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sightline.llm import chat_format, exact_dedup, html_extract, license_scan, minhash_dedup, mixing, packing, quality_rules, suffix_dedup, token_files, tokens  # noqa: E402
from sightline.llm.shared import fresh_path  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Longish words repeat here and there. " * 4000
ODD = [(3, None, None, None, None), (1, "", "en", "s", 0), (2, "  \n\t ", None, "s", 5), (5, "Same  text\nhere", "en", None, 1), (4, "Same text here", "en", "t", 1), (4, "Same text here", "en", "t", 1), (9, LONG, "en", "t", 9), (None, "no id at all", "en", "u", 2), (7, "é́ ÿ 😀 \x00 nul", "fr", "u", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    # names that operators might use themselves
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("_id", "id", "_norm", "_salt", "_hash", "node", "k", "size", "target", "times", "bucket", "length", "_src", "_osrc", "_osize", "_row", "rank", "hash", "doc", "place", "component", "class", "salt", "kept", "n")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# licenses


def test_license_rules(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or
substantial portions of the Software."""
    texts = [mit, "Intro.\nLicensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "nothing", None, ""]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].license == "MIT" and got[0].sentence_ids == "<11><12>"
    assert got[1].license == "CC-BY-NC-4.0"
    assert got[2].licenses == "MIT,Apache-2.0" and got[2].n_sentences == 2
    assert got[3].license is None and got[4].n_sentences == 0 and got[5].licenses == ""


def test_rules_use_up_what_they_match(spark):
    """A rule contained in another matches only where it has a text of its own."""
    say = lambda *ids: "\n".join(license_scan.SENTENCES[i] + "." for i in ids)
    cases = {
        (29, 23): "LGPL-3.0", (29,): "LGPL-2.1", (29, 31): "LGPL-2.1", (50, 51, 52, 53): "BSD-3-Clause", (50, 51, 52): "BSD-2-Clause",
        (50, 51, 52, 53, 50, 51, 52): "BSD-3-Clause,BSD-2-Clause", (50, 51, 52, 50, 51, 52, 53): "BSD-3-Clause,BSD-2-Clause", (24, 23, 10, 24, 25): "GPL-3.0,GPL-2.0,MIT",
        (2, 10, 3): "MIT,Apache-2.0", (60, 63): "MPL-2.0", (67, 68, 69): "Zlib", (53,): "", (23, 24): "", (30, 23, 29): "AGPL-3.0,LGPL-2.1"}
    docs = spark.createDataFrame([(k, say(*ids)) for k, ids in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [got[k].licenses for k in range(len(cases))] == list(cases.values())
    assert [got[k].sentence_ids for k in range(len(cases))] == ["".join(f"<{i}>" for i in ids) for ids in cases]
    known = license_scan.SENTENCES.values()
    assert len(set(known)) == len(known) and all(i in license_scan.SENTENCES for _, ids in license_scan.RULES for i in ids)


def test_license_cases(odd, none):
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(none).count() == 0


# packing


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 4096])
    counts = {r.randint(1, capacity): r.randint(1, 300) for _ in range(r.choice([0, 1, 3, 60]))}
    plan = packing.Plan(dict(counts), capacity)
    used, ranks = np.zeros(plan.n_sequences, np.int64), {}
    for length, a, b, first, offset in sorted(plan.slots, key=lambda s: s[4]):
        assert (used[first : first + b - a] == offset).all()
        used[first : first + b - a] += length
        ranks.setdefault(length, []).append((a, b))
    assert (used > 0).all() and (used <= capacity).all()
    for length, n in counts.items():
        spans = sorted(ranks[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in itertools.pairwise(spans))


def test_plan_uses_exact_complements():
    assert packing.Plan({6: 5, 4: 5}, 10).n_sequences == 5
    assert packing.Plan({5: 4, 3: 4, 2: 4}, 10).n_sequences == 4
    assert packing.Plan({4: 3, 3: 3, 2: 3, 1: 3}, 10).n_sequences == 3


def placed_ok(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_cases(spark, odd, none):
    rows = packing.pack_documents(odd, VOCABULARY, capacity=64).collect()
    placed_ok(rows, 64)
    library = tokens.encoder(VOCABULARY).tokenizer
    want = []
    for doc_id, text, *_ in ODD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(1, 20)], "doc_id long, text string")
    from sightline.llm.shared import written

    pieces = written(packing.tokenised_pieces(docs, VOCABULARY, 1, 32, carry_ids=True), "t")
    out = packing.sequences(packing.place_pieces(pieces, 32)).collect()
    library = tokens.encoder(VOCABULARY).tokenizer
    assert sum(len(r.ids) for r in out) == sum(len(library.encode("some words " * i, add_special_tokens=False).ids) + 1 for i in range(1, 20))
    assert all(len(r.ids) <= 32 for r in out)


# near duplicates


def shingles(text):
    w = words(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [1, 256])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, small):
    """Also with nodes that branch (small = 1), down to the last level."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "MAX_LEVELS", 2)
    r = random.Random(small)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["a b", "A  b", "", None, "one"]
    docs = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components_of(docs)


def test_recall_in_a_large_node(spark, monkeypatch):
    """A node far larger than a small one, most of whose pairs lie around the threshold: links found of all pairs."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 40)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 10)
    monkeypatch.setattr(minhash_dedup, "STAR", 30)
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(400):
        own = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3])):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    near = minhash_dedup.similar_pairs(minhash_dedup.shingle_sets(texts))
    one, two = np.nonzero(np.triu(near, 1))
    assert 0.2 < len(one) / (400 * 399 / 2) < 0.9
    comp = {x.doc_id: x.component_id for x in minhash_dedup.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([comp[a] == comp[b] for a, b in zip(one.tolist(), two.tolist())]) >= 0.99


def test_long_documents_are_compared_in_blocks(spark, monkeypatch):
    """Sets too many for one comparison, though members are few."""
    monkeypatch.setattr(minhash_dedup, "SET_ROWS", 500)
    monkeypatch.setattr(minhash_dedup, "MAX_LEVELS", 1)
    r = random.Random(9)
    texts = []
    for b in range(3):
        base = [f"b{b}w{i}" for i in range(300)]
        texts += [" ".join(w if r.random() > 0.01 else "z" for w in base) for _ in range(5)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == components_of(list(enumerate(texts)))


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    from sightline.llm import components as c

    monkeypatch.setattr(c, "ONE_TASK", one_task)
    r = random.Random(1)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in links for x in e}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {x.id: x.component for x in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if any(a != b and k in (a, b) for a, b in links)}


def test_near_duplicate_cases(odd, none):
    rows = minhash_dedup.linked(odd).collect()
    assert len(rows) == len(ODD) and minhash_dedup.linked(none).count() == 0
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in rows}
    assert {(4, 1, 4, True), (5, 1, 4, False), (1, 0, 1, True), (None, 1, None, True)} <= got
    twins = odd.sparkSession.createDataFrame([(None, "one two three")] + [(i, "one two three") for i in range(100)], "doc_id long, text string")
    assert {x.component_id for x in minhash_dedup.linked(twins).collect()} == {None, 0}  # a row without an id isn't linked, whatever its text
    assert sorted(minhash_dedup.drop_near_copies(odd).columns) == sorted(odd.columns)


def test_shingle_sets_match():
    for t in ["a b c d e f a b c d e f", "x", "x Y z", "", None, "A b\tC d e", "ÄÖ ä b c d e é"]:
        assert len(minhash_dedup.shingle_sets([t])[0]) == len(shingles(t))


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div id="layout-with-sidebar"><article class="post"><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;line.<br>Second<p>Third &lt;tag&gt;
<aside>Related</aside><form><p>Subscribe</p></form><div class="advert">Buy</div></article><div class="sidebar">Side</div>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></div><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert html_extract.main_text(PAGE) == "Title & more First bold line. Second Third <tag>"


def test_broken_pages():
    assert html_extract.main_text("<article><p>open <b>x") == "open x"
    assert html_extract.main_text("<p>a<p>b<!-- rest") == "a b"
    assert html_extract.main_text("<div class='x>un<p>closed</p>") != ""
    assert html_extract.main_text("no markup & all") == "no markup & all"
    assert html_extract.main_text("<script>only()") == "" and html_extract.main_text("") == "" and html_extract.main_text(None) == ""


def test_site_style_tree_removes_what_pages_share(spark):
    body = lambda i: f"<body><div class='top'>Same banner words</div><div class='main-text'><p>Own words {i} of page {i * 7}</p></div><div class='bottom'>Same closing words</div></body>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(8)] + [(100, None, None), (101, "x", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Own words 3 of page 21" and got[3].n_chars == len(got[3].text)
    assert got[100].text == "" and got[101].text == "" and len(got) == 10


def test_site_style_tree_by_join(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i}", f"<div class='t'>Same</div><div class='u'>Own {i}</div>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.extract(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_extract.extract(pages).collect())) == want and want[0][2] == "Own 0"
    assert html_extract.extract(pages.limit(0)).count() == 0


def site(spark, page, n=8):
    """Texts of n pages of one host."""
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(n)]
    return [r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("around", ["<div class='wrap'>{}</div>", "<main><div class='wrap'>{}</div></main>", "<main><div><section>{}</section></div></main>"])
def test_wrappers_of_different_text_stay(spark, around):
    page = lambda i: "<body><div class='top'><p>Same banner</p></div>" + around.format(f"<h1>Title {i}</h1><p><b>First {i}</b></p><p>Second {i}</p>") + "<div class='low'><div><p>Same end</p></div></div></body>"
    assert site(spark, page) == [f"Title {i} First {i} Second {i}" for i in range(8)]


def test_inline_text_counts_as_content(spark):
    assert site(spark, lambda i: f"<div class='u'><p><b>Only bold {i}</b></p></div><div class='t'><p><b>Same</b></p></div>") == [f"Only bold {i}" for i in range(8)]


def test_boxes_that_a_site_repeats_inside_its_articles_go(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><div class='box'><p>Same offer</p></div><div class='wrap'><p>Own text {i}</p></div></article>"
    assert site(spark, page) == [f"Title {i} Own text {i}" for i in range(8)]
    assert site(spark, page, 4)[0] == "Title 0 Same offer Own text 0"  # too few pages to tell


def test_an_article_that_a_site_repeats_whole_stays(spark):
    assert site(spark, lambda i: "<article><h1>Title</h1><p>Text</p></article>") == ["Title Text"] * 8


def test_names_of_prose_and_ids_of_sections_tell_no_role():
    kept = "<h2 id='search'>A</h2><section id='related-work'><p>b</p></section><h3 id='cookies-and-sessions'>C</h3><p class='notice'>d <a class='share'>e</a></p><div id='search'>f</div><div class='search-engines'>g</div>"
    assert html_extract.main_text(f"<article>{kept}<div class='related-posts'>x</div><ul class='social'><li>x</ul></article>") == "A b C d e f g"
    assert html_extract.main_text("<div class='content has-sidebar'><p>All of it</p><section id='search'>a</section></div><div class='post-comments'>x</div><div id='sidebar'>x</div>") == "All of it a"


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad", "cookie-notice", "relatedPosts", "share-buttons", "site-header", "comment-list", "page-footer", "ad_box text-center"])
def test_names_of_containers_tell_roles(name):
    assert html_extract.main_text(f"<div class='wrap'><p>Text</p></div><div class='{name}'><p>x</p></div>") == "Text"


def test_all_articles_but_teasers_count(spark):
    assert html_extract.main_text("<article><p>First part</p></article><article><p>Second</p></article>") == "First part Second"
    assert html_extract.main_text("<article><p>Text</p></article><article class='post-teaser'>x</article><section class='related'><article>x</article></section>") == "Text"
    assert html_extract.main_text("<div class='sidebar'><article>Text</article></div>") == "Text"
    assert site(spark, lambda i: f"<article><p>Own {i}</p></article><article class='b'><p>Same</p></article>") == [f"Own {i}" for i in range(8)]


def test_all_mains_count():
    assert html_extract.main_text("<main><p>one</p></main><p>aside of both</p><main><div class='main'><p>two</p></div></main>") == "one two"


@pytest.mark.parametrize("name", ["post-share", "article-related", "main-nav", "entry-comments", "share-story"])
def test_parts_of_an_article_are_no_content(name):
    assert html_extract.main_text(f"<article><p>Text</p><div class='{name}'>x</div></article>") == "Text"


def test_hidden_is_an_attribute_of_that_name():
    assert html_extract.main_text("<p title='the hidden room' data-x=' hidden '>a</p><p hidden>b</p><p HIDDEN=''>c</p><p class=x hidden/>d") == "a d"
    assert html_extract.main_text("<div style='display: none'>x</div><p id=hidden>a</p>") == "a"


def test_importance_equals_brute_force(spark):
    """Entropies of all paths of three sites, one of them without articles or mains."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        part = lambda *c: f"<div class='{r.choice(['a', 'b'])}'><p>{r.choice(c)}</p>{r.choice(['', '<ul><li>x</ul>'])}</div>"
        rows.append((i, f"http://{r.choice(['h1', 'h2', 'h3'])}.example/p", part("same", "same", "same", "other") + part(f"own {i}") + "<footer><p>end</p></footer>"))
    hosts = {}
    for _, url, page in rows:
        for path, look, said in html_extract.style_nodes(page):
            for kind, v in enumerate((look, said)):
                hosts.setdefault((url.split("/")[2], path), [[], []])[kind].append(v)

    def entropy(values):
        p = np.array([values.count(v) for v in set(values)]) / len(values)
        return float(-(p * np.log(p)).sum() / np.log(len(values)))

    want = {k for k, kinds in hosts.items() if len(kinds[0]) >= 5 and max(map(entropy, kinds)) < 0.5}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x.host, x.path) for x in html_extract.unimportant_paths(pages, 0.5, 5).collect()}
    assert got == want and 3 < len(want) < len(hosts)


def test_paths_stream_ahead_of_pages(spark, monkeypatch):
    """Several sites, some without unimportant paths, dealt by host and salt: the texts of the other way."""
    rows = [(i, f"http://h{i % 4}.example/{i}", f"<div class='t'>Same {i % 4 if i % 4 < 2 else i}</div><div class='u'>Own {i}</div>") for i in range(48)] + [(None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.extract(pages).collect()), key=repr)
    assert sum("Same" in r[2] for r in want) == 24
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    for salts in (1, 5):
        monkeypatch.setattr(html_extract, "SALTS", salts)
        assert sorted(map(tuple, html_extract.extract(pages).collect()), key=repr) == want


def test_page_cases(spark, none):
    """No page, repeated rows, null ids and addresses, columns of other names that the operator may use itself."""
    schema = "page_id long, url string, html string, host string, paths string, path long, text string, n long"
    rows = [(1, None, "<p>a</p>", "x", "x", 1, "x", 1)] * 2 + [(None, "http://h/", None, None, None, None, None, None), (2, None, "  ", "", "", 0, "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "a", 1), (1, None, "a", 1), (None, "http://h/", "", 0), (2, None, "", 0)], key=repr)
    assert html_extract.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and html_extract.extract(df.limit(0)).count() == 0
    long = "<p>" + "word &amp; " * 200_000 + "</p>"
    assert html_extract.main_text(long).count("&") == 200_000


# quality


def repeated(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    at = {j for i, g in enumerate(windows) if windows.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(at)


def test_repeated_words():
    r = random.Random(1)
    for _ in range(200):
        w = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 14))]
        assert quality_rules.n_repeated(w) == repeated(w)


def test_lines_decide():
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + f" ends line{i}." for i in range(8))
    junk = " | ".join(f"item{i}" for i in range(60))
    assert quality_rules.judge(prose)[0]["kept"]
    m, text = quality_rules.judge(prose + "\nHome\n" + prose.split("\n")[0] + "\nAccept our cookie policy, click here.")
    assert m["kept"] and m["n_dup_lines"] == 1 and m["failed_lines"] == "boilerplate:1,navigation:1,repeated:1" and text == prose
    assert not quality_rules.judge(prose.split("\n")[0] + "\n" + junk)[0]["kept"]
    assert not quality_rules.judge("\n".join(f"WORD{i} SHOUT{i} AGAIN{i}!! LOUD{i}!!" for i in range(30)))[0]["kept"]


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten.", "Cookie-Richtlinie unserer Seite ansehen.", "Tous droits réservés.", "Conditions d’utilisation du site.", "Política de privacidad.", "Haga clic aquí para ver todo.", "All rights reserved."])
def test_boilerplate_of_four_languages(line):
    assert quality_rules.line_fails(line.encode(), len(words(line))) == "boilerplate"
    text = line + "\n" + " ".join(f"Wort{i}" for i in range(60)) + "."
    found, stay = quality_rules.judge(text)
    assert found["kept"] and found["failed_lines"] == "boilerplate:1" and stay == text.split("\n")[1]


def test_kept_documents_go_on_without_failing_lines(spark):
    good = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, f"Home | About | Blog | More\n{good}\nMenu", 500), (2, "Menu", 4), (3, None, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in quality_rules.keep_good(docs, size_col="n_chars").collect()] == [(1, good, len(good))]


def test_quality_cases(odd, none):
    rows = quality_rules.rate(odd, cleaned=True).collect()
    assert len(rows) == len(ODD) and quality_rules.rate(none).count() == 0
    assert {r.doc_id: r.n_words for r in rows}[3] == 0 and not any(r.kept for r in rows)
    assert quality_rules.keep_good(odd).columns == odd.columns


# mixing


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_the_best_sum(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.choice(np.arange(0, 30), r.integers(1, 6), replace=False))
    counts, budget = r.integers(1, 4, len(lengths)), int(r.integers(0, 70))
    take = mixing.fit(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    sums = {sum(a * b for a, b in zip(c, lengths.tolist(), strict=True)) for c in itertools.product(*[range(int(n) + 1) for n in counts])}
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def best_miss(lengths, counts, budget):
    sums = {0}
    for length, n in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return min((abs(s - budget), s) for s in sums)


LONG_FITS = [([200_000, 100], [1, 50], 150_000), ([240_000, 260_000], [1, 1], 250_000), ([0, 240_000, 260_000], [2, 1, 1], 255_000), ([60_000, 50_000], [2, 3], 150_000)]


@pytest.mark.parametrize("case", [*LONG_FITS, *range(40)])
def test_fit_is_the_best_sum_of_long_lengths(case):
    if isinstance(case, int):
        r = np.random.default_rng(case)
        lengths = np.unique(r.integers(1, [300_000, 300, 5_000_000][case % 3], r.integers(2, 7))) * int(r.choice([1, 1, 1000]))
        counts = r.integers(1, 5, len(lengths))
        case = lengths.tolist(), counts.tolist(), int(r.integers(1 << 15, max(1 << 17, int((lengths * counts).sum()))))
    lengths, counts, budget = case
    order = np.argsort(lengths)
    lengths, counts = np.array(lengths)[order], np.array(counts)[order]
    take = mixing.fit(lengths, counts, budget)
    total = int((take * lengths).sum())
    assert ((take >= 0) & (take <= counts)).all() and (abs(total - budget), total) == best_miss(lengths.tolist(), counts.tolist(), budget)


def test_fit_of_many_long_documents():
    r = np.random.default_rng(1)
    lengths = np.unique(r.integers(100_000, 1_000_000, 2000))
    assert int((mixing.fit(lengths, np.ones(len(lengths), np.int64), 400_000_001) * lengths).sum()) == 400_000_001


def test_targets():
    assert mixing.targets({"a": 10, "b": 100, None: 5, "c": 1000}) == {"a": 30.0, None: 15.0, "b": 300.0, "c": 770.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


@pytest.mark.parametrize("seed", range(8))
def test_targets_of_a_table(spark, seed):
    r = random.Random(seed)
    sizes = {r.choice([None, "a", "é", "Z"]) if r.random() < 0.2 else f"s{r.randint(0, 99)}": r.choice([0, 1, 7, 50, 1000, 10**7]) for _ in range(r.randint(1, 12))}
    df = spark.createDataFrame([("n" if k is None else "s" + k, v) for k, v in sizes.items()], "_src string, source_size long")
    got = {None if x._src == "n" else x._src[1:]: x.target for x in mixing.source_targets(df).collect()}
    assert got == pytest.approx(mixing.targets(sizes), rel=1e-12)


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["x", "y", "z", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(docs).collect()}
    assert all(got[i].size == len(words(t)) and got[i].taken <= 3 * got[i].size for i, t, _ in rows)
    for s in ("x", "y", "z", None):
        own = [got[i] for i, _, source in rows if source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 1 and own[0].source_size == sum(x.size for x in own)
    assert {x.doc_id: x.taken for x in mixing.mix(docs).collect()} == {i: x.taken for i, x in got.items()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and sum(len(words(x.text)) for x in out.collect()) == sum(x.taken for x in got.values())


def test_mix_cases(odd, none):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns and mixing.mixed_rows(none).count() == 0


# token files


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 96).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == 96 * bits // 8 and (token_files.unpack(data, bits) == ids).all()


def test_writer_and_reader(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    r = np.random.default_rng(0)
    docs = [(None if i == 0 else i, r.integers(0, 49408, r.integers(1, 300)).astype(np.uint32)) for i in range(20)]
    with open(tmp_path / "x", "wb") as f:
        w = token_files.Writer(f, 16)
        for d in docs:
            w.add(*d)
        w.close()
    with open(tmp_path / "x", "rb") as f:
        got = token_files.Reader(f, (tmp_path / "x").stat().st_size)
        for k in r.permutation(20):
            assert got.doc_ids[k] == docs[k][0] and (got.document(int(k)) == docs[k][1]).all()


def test_token_file_cases(spark, odd, none):
    folder = fresh_path(spark, "test-tokens")
    rows = token_files.read_token_files(token_files.write_token_files(odd, folder, VOCABULARY, 49408, 2), folder).collect()
    library = tokens.encoder(VOCABULARY).tokenizer
    at = 0
    for doc_id, text, *_ in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (doc_id, at, len(ids), zlib.crc32(ids.tobytes())) in set(map(tuple, rows))
        at += len(ids)
    assert len(rows) == len(ODD)
    folder = fresh_path(spark, "test-tokens")
    assert token_files.read_token_files(token_files.write_token_files(none, folder, VOCABULARY, 49408, 2), folder).count() == 0


def test_encoder_equals_the_library():
    e = tokens.WordEncoder(VOCABULARY, max_words=50)
    r = random.Random(0)
    parts = ["Hello", "WORLD.", "don't", "x's.", "é,", "É.", "H̱", "ß", "ª", "foo...", "<|endoftext|>", "<|ENDOFTEXT|>", "3rd", "😀", "a b", "\x1c", "naïve", "—", "ﬁ", "İ", "K"]
    parts += ["end!!", "a,b", "(so)", "it's!", "good$$$", "don'", "ÀÉ?", "x<y>", "A\u0301B", "_under_", "ﬀ."]
    texts = [r.choice([" ", "\n", "  "]).join(r.choice(parts) for _ in range(r.randint(0, 12))) + r.choice(["", " ", "\t"]) for _ in range(400)]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.by_words and [x.tolist() for x in e.encode(texts)] == want
    e.chunk = 40
    assert [x.tolist() for x in e.encode(texts)] == want and e.encode([]) == []
    assert tokens.crc32(np.array(want[0] + want[1], np.uint32)) == zlib.crc32(np.array(want[0] + want[1], "<u4").tobytes())


def test_other_tokenizers_get_whole_texts():
    e = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  WORLD", "", "it's\n\nso <|endoftext|> far", "é ß"]
    assert not e.by_words and [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# passages


def brute_removal(docs, length):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(raw), int(gone.sum()), int((edge > 0).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [suffix_dedup.BATCH, 300])
def test_repeats_equal_brute_force(spark, batch):
    """Also with groups larger than a batch, which take several passes."""
    r = random.Random(batch)
    passages = ["".join(r.choice("abcde fgh") for _ in range(r.randint(40, 300))) for _ in range(6)]
    docs = []
    for i in range(60):
        text = "".join(r.choice([r.choice(passages), "".join(r.choice("xyz é") for _ in range(r.randint(0, 60)))]) for _ in range(r.randint(0, 5)))
        docs.append((i, text))
    docs += [(100, "a" * 500), (101, "ab" * 300), (102, None), (103, "a" * 99), (104, "a" * 100), (None, passages[0])]
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batch_bytes=batch, cut_bytes=2 * batch).collect()}
    assert got == brute_removal(docs, 100)


@pytest.mark.parametrize("remembered", [3, 20_000])
def test_a_passage_in_every_document(spark, monkeypatch, remembered):
    """Tasks deal a common anchor's places apart, and its contexts are cut into strings: equal to brute force, and few rows by the anchor."""
    dealer = suffix_dedup.Dealer
    monkeypatch.setattr(suffix_dedup, "Dealer", lambda: dealer(remembered))
    r = random.Random(remembered)
    noise = lambda: "".join(r.choice("qrstuvw") for _ in range(r.randint(0, 150)))
    passage = "".join(r.choice("abcde fgh") for _ in range(260))
    docs = [(i, noise() + passage + noise() + (passage[40:] if i % 5 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6, "doc_id")
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(df, batch_bytes=300, cut_bytes=600).collect()}
    assert got == brute_removal(docs, 100)
    rows = suffix_dedup._rows(df, "doc_id", "text")
    work = suffix_dedup._joined(rows, suffix_dedup._repeated_anchors(rows, 100, 32))
    assert max(suffix_dedup._cut_anchors(work, 100, 600).values()) > 3


def test_places_of_an_anchor_are_dealt_apart():
    d = suffix_dedup.Dealer()
    unknown, repeated, apart, settled = range(4)
    h, c = np.array([5, 5, 5, 7, 5]), np.array([1, 1, 2, 3, 2])
    deal, context, kind = d.deal(h, c, np.array([3, 2, 4, 1, 9]), np.zeros(5, int), np.zeros(5, int))
    assert kind.tolist() == [settled, repeated, apart, unknown, settled] and context.to_pylist() == [None, 1, 2, 3, None]
    assert deal[1] == 5 and deal[2] == 5 ^ 2 and deal[3] == 7
    deal, context, kind = d.deal(h[:3], c[:3], np.array([8, 1, 3]), np.zeros(3, int), np.zeros(3, int))
    assert kind.tolist() == [settled, apart, apart] and context.to_pylist() == [None, 1, 2]


def test_repeat_cases(odd, none):
    rows = suffix_dedup.remove_repeats(odd, spans=True).collect()
    assert len(rows) == len(ODD) and suffix_dedup.remove_repeats(none).count() == 0
    long = next(x for x in rows if x.doc_id == 9)
    assert long.n_removed == len(LONG) - len("Longish words repeat here and there. ") and long.spans == [[37, len(LONG)]]


def test_suffixes_are_sorted():
    r = np.random.default_rng(0)
    for case in range(150):
        n, length = int(r.integers(20, 300)), int(r.choice([8, 12, 20]))
        d = r.integers(97, 97 + r.integers(1, 5), n).astype(np.uint8)
        data = np.concatenate([d, np.zeros(2 * length + 32, np.uint8)])
        own = np.zeros(len(data), bool)
        own[: max(1, n - length + 1)] = r.random(max(1, n - length + 1)) < 0.7
        found = suffix_dedup.sorted_suffixes(data, own, length)
        keys = [data.tobytes()[i : i + length] for i in found]
        assert len(found) == own.sum() and keys == sorted(keys), case


# chats


def test_layouts():
    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from-value", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": "b", "system": "s"}, "prompt-response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "c", "output": "b"}, "instruction", [("user", "a\n\nc"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"question": "a", "answer": "b"}, "question-answer", [("user", "a"), ("assistant", "b")]),
        ({"prompt": {"text": "a"}, "answer": {"text": "b"}}, "nested-prompt", [("user", "a"), ("assistant", "b")]),
        ({"role": "user", "text": None}, "turn-rows", [("user", "")]),
        ({"what": 1}, None, []),
    ]
    for record, name, turns in cases:
        assert chat_format.canonical_turns(record) == (name, turns)


def test_further_fields_do_not_hide_a_layout():
    record = {"messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": "b", "weight": 1}], "tags": []}
    assert chat_format.canonical_turns(record) == ("messages", [("user", "a"), ("assistant", "b")])
    assert chat_format.canonical_turns({"prompt": "a", "response": "b", "score": {"of": 2}})[0] == "prompt-response"
    assert chat_format.canonical_turns({"prompt": "a", "score": 1}) == (None, []) and chat_format.canonical_turns({}) == (None, [])


def test_shared_folder(spark, tmp_path):
    from sightline.llm import shared

    folder = shared.shared_folder(spark)
    assert folder.startswith("file:///") and not folder.endswith("/")
    shared.WRITTEN.clear()
    table = shared.written(spark.range(3), "test")
    assert table.count() == 3 and shared.forget_written(spark) == 1 and shared.WRITTEN == []


def test_turns_round_trip():
    r = random.Random(0)
    parts = [*chat_format.CONTROLS, "\\", "\\\\", "\n", "a", "<", "|", "[", "é", "😀"]
    for _ in range(500):
        role, text = ("".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(2))
        formatted, lo, hi = chat_format.render(role, text)
        assert chat_format.parse(formatted) == (role, text)
        inner = formatted[len(chat_format.OPEN) : -len(chat_format.CLOSE)]
        assert not chat_format.CONTROL.search(inner) and (lo is None) == (role != "assistant")
    formatted, lo, hi = chat_format.render("assistant", chat_format.CONTROL_TEXT)
    assert chat_format.unescape(formatted[lo:hi]) == chat_format.CONTROL_TEXT


def test_chat_cases(spark):
    records = [(1, 0, json.dumps({"question": "q", "answer": "a"})), (1, 1, json.dumps({"unknown": 1})), (1, None, "not json"), (None, 0, None), (2, 0, json.dumps({"role": None, "text": None}))]
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_records(df, "conv_id", ["turn"], "record")).collect()}
    assert (out[1].n_turns, out[1].n_unknown, out[1].loss_chars) == (2, 2, 1) and out[None].n_unknown == 1 and out[2].n_turns == 1
    assert chat_format.read_back(chat_format.format_records(df.limit(0), "conv_id", ["turn"], "record")).count() == 0


# exact copies


def test_exact_groups(spark, odd, none):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == len(ODD) and exact_dedup.exact_groups(none).count() == 0
    groups = {}
    for doc_id, text, *_ in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    for r in rows:
        own = next(v for v in groups.values() if r.doc_id in v)
        assert r.group_size == len(own) and r.keep_id == min((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == len(groups)


def test_large_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy  of a text' ELSE concat('text ', id) END AS text")
    rows = exact_dedup.exact_groups(docs).where("group_size > 1").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {0} and {r.group_size for r in rows} == {1000}


@pytest.mark.parametrize("cut", [{"piece_rows": 7}, {"piece_bytes": 60}])
def test_copies_in_pieces_of_a_range(spark, cut):
    """Groups larger than a piece lie in several; neighbours of the second sort join them again."""
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy  of a text' WHEN id % 3 = 1 THEN concat('one of few', id % 50) ELSE concat('copy of a text ', id) END AS text", "id % 2 AS _row")
    own = {}
    for r in docs.collect():
        own.setdefault(" ".join(r.text.split()), []).append(r.doc_id)
    local, merged = exact_dedup._sorted(docs, "doc_id", "text", False, **{"piece_rows": 1000, "piece_bytes": 1 << 20} | cut)
    assert local.where("_at is not null").select("_at._hash", "_at._piece").distinct().groupBy("_hash").count().agg({"count": "max"}).first()[0] > 20
    assert merged.where("_leads").count() < merged.count()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, **cut).collect()}
    assert got == {i: (min(v), len(v), i == min(v)) for v in own.values() for i in v}
    out = exact_dedup.drop_copies(docs, **cut)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(min(v) for v in own.values())
