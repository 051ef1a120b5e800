"""Phrase collocations, the line classifier and spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import collocations as co
from sightline.llm import quality_crf as crf
from sightline.llm import spelling as sp
from sightline.llm.queries import queries

SF = "/root/testdata/sf0.01"

# Collocations


def brute_phrases(rows, min_count, max_words, cover, top):
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in good.items():
            if any(100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def made_texts(seed, n=60, words="ab a b ba ña X x zz 字"):
    r = random.Random(seed)
    return [("".join(r.choice(words.split()) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", ";"]) for _ in range(r.randrange(0, 60))), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("seed,max_words,bits,shard", [(1, 3, 20, 1 << 20), (2, 3, 6, 40), (3, 4, 12, 7), (4, 2, 27, 300)])
def test_collocations(spark, seed, max_words, bits, shard):
    rows = [*made_texts(seed), (None, "en"), ("", "de"), (" .. ", None)]
    df = spark.createDataFrame([(i, t, x, "e") for i, (t, x) in enumerate(rows)], "rank long, text string, lang string, phrase string")
    got = co.collocations(df, min_count=3, max_words=max_words, cover=50, top=12, filter_bits=bits, shard=shard)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 3, max_words, 50, 12)


def test_search_in_small_steps(monkeypatch):
    monkeypatch.setattr(co, "STEP", 5)
    rows = [t for t, _ in made_texts(9)]
    batch = pa.record_batch([pa.array(["en"] * len(rows)), pa.array(rows)], ["lang", "text"])
    full = np.full(1, 2**64 - 1, np.uint64)
    found = Counter()
    for shard in co.shards([batch], full, 1 << 20):
        for text, n, _ in shard.phrases(full, 3):
            found.update(dict.fromkeys(set(text.to_pylist()), 0))
            for p, c in zip(text.to_pylist(), n.tolist(), strict=True):
                found[p] += c
    want = {p: a for _, _, p, a, *_ in brute_phrases([(t, "en") for t in rows], 1, 3, 10**9, 10**9)}
    assert found == want


def test_packed_counts():
    r = np.random.default_rng(2)
    hashes, n = r.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2), r.choice([1, 2, 254, 255, 256, 510, 511, 100_000], 200)
    packed, found = co.packed(hashes, n).view(np.uint64), Counter()
    for h in packed.tolist():
        found[h >> 8] += h & 255
    assert found == {h >> 8: c for h, c in zip(hashes.tolist(), n.tolist(), strict=True)} and ((packed & np.uint64(255)) > 0).all()


def test_no_phrases(spark):
    schema = "text string, lang string"
    assert co.collocations(spark.createDataFrame([], schema)).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None), ("one", "en"), ("a.b" * 2000, "en")], schema)).collect() == []


def test_long_word_and_large_counts(spark):
    long = "w" * 100_000
    rows = [(f"{long} b " * 3, "en")] * 4
    got = co.collocations(spark.createDataFrame(rows, "text string, lang string"), min_count=10).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 10, 3, 50, 2000)
    words = spark.createDataFrame([("en", "x", 9 * 10**12), ("en", "y", 8 * 10**12)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "x y", 2, 7 * 10**12)], "lang string, phrase string, k int, f long")
    assert co.scores(words, pairs, 10).first().score == 10**6 * 49 * 10**24 // (72 * 10**24)


# The line classifier


def flat(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])]


def test_lines_and_features():
    r = random.Random(3)
    texts = ["", "a b c a b c\n\n  \nX!! y|z 12\na b c", None, "é ü\r\n x", "\n", *("".join(r.choice("ab \n!|") for _ in range(r.randrange(80))) for _ in range(60))]
    lines = crf.read_lines(*flat(texts))
    at, col = 0, {f: i for i, f in enumerate(crf.FEATURES)}
    for d, t in enumerate(texts):
        windows = Counter()
        rows = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()]
        every = [(k, w) for k, (_, x) in enumerate(rows) for w in re.findall("[^ \t-\r]+", x)]
        windows.update(tuple(w for _, w in every[i : i + 3]) for i in range(len(every) - 2))
        hit = {j for i in range(len(every) - 2) if windows[tuple(w for _, w in every[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        for j, (k, x) in enumerate(rows):
            words = x.split()
            row = lines.x[at]
            assert lines.doc[at] == d and lines.number[at] == k and lines.length[at] == len("".join(words).encode())
            assert row[col["words"]] == pytest.approx(np.log1p(len(words)))
            assert row[col["pipes"]] == pytest.approx(x.count("|") / (0.2 * len(words) + x.count("|")))
            assert row[col["seen before"]] == (x.strip() in {y.strip() for _, y in rows[:j]})
            assert row[col["repeated words"]] == pytest.approx(1 - len(set(words)) / len(words))
            assert row[col["repeated windows"]] == pytest.approx(sum(1 for i in hit if every[i][0] == j) / len(words))
            assert (row[col["first"]], row[col["last"]]) == (j == 0, j == len(rows) - 1)
            n, s = len(crf.FEATURES), len(crf.SHARED)
            assert np.allclose(row[n : n + s], lines.x[at - 1][crf.SHARED] if j else 0) and np.allclose(row[n + s :], lines.x[at + 1][crf.SHARED] if j < len(rows) - 1 else 0)
            at += 1
    assert at == len(lines.doc)


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(5)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    score, start, trans = r.normal(0, 3, 9), r.normal(size=2), r.normal(size=(2, 2))
    p, first, pairs, norm = crf.Chains(doc).marginals(score, start, trans)
    want, want_first, want_pairs, log = np.zeros((9, 2)), np.zeros(2), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        every = {y: np.exp(sum(score[i] * s for i, s in zip(at, y, strict=True)) + start[y[0]] + sum(trans[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(at))}
        z = sum(every.values())
        log += np.log(z)
        for y, v in every.items():
            want_first[y[0]] += v / z
            for i, s in zip(at, y, strict=True):
                want[i, s] += v / z
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += v / z
    assert np.allclose(p, want) and np.allclose(first, want_first) and np.allclose(pairs, want_pairs) and norm == pytest.approx(log)


def test_extreme_scores_stay_finite():
    p = crf.Chains(np.zeros(4, int)).marginals(np.array([900.0, -900, 0, 900]), np.zeros(2), np.zeros((2, 2)))[0]
    assert np.isfinite(p).all() and p[0, 1] > 0.99 and p[1, 1] < 0.01


def test_op12_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries()["op12_quality_classifier"](spark, SF).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert sorted(got) == [d for d, in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    told = [(labels[d], r.score) for d, r in got.items() if r.held_out and d in labels]
    good, bad = [s for y, s in told if y], [s for y, s in told if not y]
    assert len(bad) > 5 and sum(a > b for a in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum((s >= 0.5) == bool(y) for y, s in told) >= 0.95 * len(told)


def test_classifier_cases(spark):
    schema = "doc_id long, text string, label int, x string, at int"
    good, bad = "Ein Satz mit Punkt.\nUnd noch ein Satz, wie er ist.", "### $$$ ### %%%\n!! !! !!"
    rows = [(i, good if i % 2 else bad, 1, "x", 2) for i in range(40)] + [(None, None, 0, "", 0), (100, "", 0, "", 0), (100, "", 0, "", 0), (101, "z" * 300_000, 0, "", 0), (102, "\n" * 1000 + "a\n" * 3000, 0, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(3)] + [(3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = crf.fit(docs, labels)
    got = crf.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert crf.fit(docs, labels).weights.tolist() == model.weights.tolist()
    lines = crf.label_lines(docs.where("doc_id = 1"), model).orderBy("line").collect()
    assert [(r.line, r.good) for r in lines] == [(0, True), (1, True)]
    none = crf.fit(docs, labels.where("false"))
    assert {r.score for r in crf.score_documents(docs, none).collect()} == {0.5}
    one = crf.fit(docs, labels.where("quality = 1"))
    assert all(r.predicted == 1 for r in crf.score_documents(docs, one).collect())
    assert crf.score_documents(docs.where("false"), model).collect() == []


def test_lines_of_mixed_documents(spark):
    """Good lines inside bad documents are told from bad ones, though labels are of documents."""
    r = random.Random(8)
    sentence = lambda: " ".join(r.choice(["wald", "und", "feld", "der", "himmel"]) for _ in range(9)).capitalize() + "."
    noise = lambda: " ".join(r.choice(["a###", "b$$$", "c%%%"]) for _ in range(14))
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, "\n".join([sentence(), *(noise() if bad else sentence() for _ in range(4))])))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = crf.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = crf.label_lines(docs, model).collect()
    assert sum(x.good == (x.doc_id % 3 != 0 or x.line == 0) for x in got) >= 0.97 * len(got)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=5):
    out, form = set(), {}
    found = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), None if form[w] is None else n[form[w]]))
    return out


@pytest.mark.parametrize("seed,length,alphabet", [(1, 6, "ab"), (2, 7, "abé"), (3, 9, "ab"), (4, 2, "xyz")])
def test_near_pairs(seed, length, alphabet):
    r = random.Random(seed)
    words = sorted({"".join(r.choice(alphabet) for _ in range(length + r.randrange(2))) for _ in range(150)})
    got = []
    for a, b in ((0, length // 2), (length // 2, length), (length, length + 1)):
        if a < b:
            x, y, _ = sp.near_pairs(words, length, a, b)
            got += zip(x.tolist(), y.tolist(), strict=True)
    want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if i != j and near(u, v) and length in (len(u), len(v))}
    assert len(got) == len(set(got)) and set(got) == want


def test_wavelet_tree():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        places = r.permutation(n)
        lo, least = r.integers(0, n, 50), r.integers(0, n, 50)
        hi, end = r.integers(lo, n + 1), r.integers(least, n + 1)
        q, p = sp.WaveletTree(places).report(lo, hi, least, end)
        assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted((i, int(v)) for i in range(50) for v in places[lo[i] : hi[i]] if least[i] <= v < end[i])


@pytest.mark.parametrize("limit,step", [(10**6, 10**6), (40, 100), (1, 1)])
def test_variants(spark, limit, step):
    r = random.Random(limit)
    every = Counter()
    rows = []
    for i in range(150):
        text = "".join("".join(r.choice("aabÉéB") for _ in range(r.choice([3, 6, 6, 7, 8]))) + r.choice([" ", "-", "\n", "7"]) for _ in range(60))
        rows.append((i if i % 10 else None, text, "w"))
    rows += [(900, None, ""), (901, "", ""), (901, "q" * 5000 + " ", ""), (3, "zzzzzz " * 9, "")] + [(902, "q" * 5000, "")] * 6
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            every[run] += len(run) >= 6
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = [tuple(x) for x in sp.variants(df, limit=limit, step=step, ratio=2).collect()]
    want = brute_variants({w: n for w, n in every.items() if n >= 5}, 2)
    assert len(got) == len(want) > 50 and set(got) == want
    chain = {"aaaaaa": 700, "aaaaab": 100, "aaaabb": 40, "aaabbb": 16, "aabbbb": 8, "zzzzzz": 5}
    df = spark.createDataFrame([(7, " ".join(w for w, n in chain.items() for _ in range(n)))], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in sp.variants(df, limit=limit, step=step, ratio=2).collect()}
    assert len(got) == 6 and got["aabbbb"] == ("aaabbb", "aaaaaa") and got["zzzzzz"] == (None, "zzzzzz")


def test_dealt_groups_end_small(spark):
    words = spark.createDataFrame([("a" * 5 + x + y + z, 5) for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh"], "word string, n long")
    rows = sp.dealt(words, 6, 200)
    sizes = rows.groupBy("length", "a", "b", "key").agg({"length": "sum"}).collect()
    assert all(r[4] <= 200 or r.b - r.a == 1 for r in sizes)
    assert {(r.word, r.n_near) for r in sp.near_words(words, 6, 200, 100).collect()} == {(r.word, 21) for r in words.collect()}


def test_no_words(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sp.variants(spark.createDataFrame([(1, None), (None, "short")], "doc_id long, text string")).collect() == []
