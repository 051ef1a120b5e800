"""Spelling variants: words one code point apart, by two-dimensional range reporting.

Words stand in two orders: as they are, and reversed. For each edit position of a word
the words that share what is before it are an interval of the first order, and those that
share what is after it one of the second. Near words are the points in both: each word is
a point (its place in either order), and a wavelet tree over the places, one for the
words of either length, reports those of a rectangle level by level.

No task sees all words. Edit positions of words of one length are cut into ranges; two near
words agree in all that is before their range and in all that is after it, so words are
dealt by that text, first in two ranges (first half, second half), in four copies at most. A
group of more than `limit` code points is cut again: its range is halved, and the words are
dealt by the longer text that they then share. A range of one position leaves one free
code point (two where one is inserted), so every group ends small. A pair meets in the
group of its edit's range alone (an insertion into a run of equal code points counts at
its first place), so no pair is found twice and none is sent on: a task sums up each word's pairs.

Defined cases: a null text has no word; a null id counts as an empty string in the key of
deletions; repeated rows count each; an empty table gives an empty result; texts and words
have any length; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

RUNS = re.compile("[a-zÀ-ÿ]+")
#: Words that a counting task holds; code points of a group that is cut again, and that a step takes at once.
HELD, LIMIT, STEP = 300_000, 1_000_000, 1_000_000
#: One deletion in so many runs.
DELETED = 199


def runs_of(doc_id: int | None, text: str | None, least: int) -> Counter:
    """Words of a text after its deletions, of `least` code points and more."""
    found: Counter = Counter()
    key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUNS.findall((text or "").encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), key)
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: words of `least` code points that occur `min_count` times or more."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(runs_of(doc_id, text, least))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """Places 0..n-1 in some order, stored level by level from the highest bit; equal prefixes of bits are a node."""

    def __init__(self, places: np.ndarray):
        self.depth = max(1, int(len(places) - 1).bit_length()) if len(places) else 0
        self.zeros, self.n_zeros = [], []
        for level in reversed(range(self.depth)):
            one = (places >> level) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            self.n_zeros.append(int(self.zeros[-1][-1]))
            places = np.r_[places[~one], places[one]]

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles lo <= index < hi, least <= place < end: (number of the rectangle, place) of every point."""
        query = np.flatnonzero((hi > lo) & (end > least))
        lo, hi, node = lo[query], hi[query], np.zeros(len(query), np.int64)
        for level, (zeros, n_zeros) in zip(reversed(range(self.depth)), zip(self.zeros, self.n_zeros, strict=True), strict=True):
            a, b = zeros[lo], zeros[hi]
            query, node = np.r_[query, query], np.r_[node * 2, node * 2 + 1]
            lo, hi = np.r_[a, lo - a + n_zeros], np.r_[b, hi - b + n_zeros]
            go = np.flatnonzero((hi > lo) & (node << level < end[query]) & ((node + 1) << level > least[query]))
            query, node, lo, hi = query[go], node[go], lo[go], hi[go]
        return query, node


class Order:
    """Words in an order, with the intervals of those that share their first code points."""

    def __init__(self, words: list[str], width: int):
        text = np.array(words, f"U{width}")
        self.order = np.argsort(text, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        points = text.view(np.uint32).reshape(len(words), width)
        rows = points[self.order]
        self.points, self.shared = points, np.r_[-1, np.argmax(rows[1:] != rows[:-1], axis=1)]

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By rank: start and end of the words that share n code points with the one there."""
        starts = np.flatnonzero(self.shared < n)
        which = np.cumsum(self.shared < n) - 1
        return starts[which], np.r_[starts[1:], len(self.shared)][which]


def near_pairs(words: list[str], length: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, Order]:
    """Pairs (x, y), as indexes of words of `length` or one code point more, that differ by an edit in [a, b): both ways round."""
    width = length + 1
    forward, back = Order(words, width), Order([w[::-1] for w in words], width)
    long = np.fromiter(map(len, words), np.int64, len(words)) == width
    found: list[tuple[np.ndarray, np.ndarray]] = []
    trees = []
    for kind in (~long, long):
        # Places among the words of one length, from places among all.
        sub_f, sub_b = (np.r_[0, np.cumsum(kind[o.order])] for o in (forward, back))
        members = forward.order[kind[forward.order]]
        by_place = back.order[kind[back.order]]
        trees.append((sub_f, sub_b, by_place, WaveletTree(sub_b[back.rank[members]])))
    own = np.flatnonzero(~long)
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), forward
    for i in range(a, b):
        lo, hi = (x[forward.rank[own]] for x in forward.intervals(i))
        for replaced in (True, False):
            if i == length and replaced:
                continue
            sub_f, sub_b, by_place, tree = trees[0 if replaced else 1]
            least, end = (x[back.rank[own]] for x in back.intervals(length - i - replaced))
            box = sub_f[lo], sub_f[hi], sub_b[least], sub_b[end]
            # A word is alone with itself in an interval of one word.
            go = np.flatnonzero((box[1] - box[0] > replaced) & (box[3] - box[2] > replaced))
            query, place = tree.report(*(x[go] for x in box))
            x, y = own[go[query]], by_place[place]
            if replaced:
                found.append((x[x != y], y[x != y]))
            else:
                if i:
                    first = forward.points[y, i] != forward.points[x, i - 1]
                    x, y = x[first], y[first]
                found += [(x, y), (y, x)]
    return *(np.concatenate(z) for z in zip(*found, strict=True)), forward


def _summed(words: list[str], counts: list[int], length: int, a: int, b: int) -> pa.RecordBatch | None:
    """Number of near words and the most frequent of them, of each word that has any, from the groups of one range."""
    x, y, forward = near_pairs(words, length, a, b)
    if not len(x):
        return None
    n = np.array(counts, np.int64)
    order = np.lexsort((forward.rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    near = np.diff(np.r_[first, len(x)])
    return pa.record_batch([pa.array([words[i] for i in x[first]]), pa.array(near), pa.array(n[y[first]]), pa.array([words[i] for i in y[first]])], ["word", "n_near", "near_n", "near"])


def _found(step: int):
    def run(batches):
        at, words, counts, cut, size = None, [], [], 0, 0  # at: length and range; cut: where the last group begins
        key = None
        for batch in batches:
            for length, a, b, k, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, a, b) != at or k != key:
                    if at is not None and ((length, a, b) != at or size >= step):
                        if (out := _summed(words, counts, *at)) is not None:
                            yield out
                        words, counts, size = [], [], 0
                    elif len(words) == cut + 1:  # a group of one word: no pair
                        size -= len(words.pop())
                        counts.pop()
                    at, key, cut = (length, a, b), k, len(words)
                words.append(word)
                counts.append(n)
                size += length
        if words and (out := _summed(words, counts, *at)) is not None:
            yield out

    return run


def _keyed(df: DataFrame) -> DataFrame:
    """What a word shares with those that differ from it in the range [a, b) only."""
    return df.withColumn("key", F.expr("concat(substring(word, 1, a), ' ', substring(word, length(word) - greatest(0, length - b) + 1, greatest(0, length - b)))"))


def dealt(words: DataFrame, least: int, limit: int) -> DataFrame:
    """Words by length, range and shared text (length, a, b, key, word, n), groups of over `limit` code points cut until they are small."""
    group = ["length", "a", "b", "key"]
    df = words.withColumn("length", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {least})")))
    df = df.withColumn("r", F.explode(F.expr("array(struct(0 as a, length div 2 as b), struct(length div 2 as a, length + 1 as b))")))
    todo = _keyed(df.select("length", F.col("r.a").cast("int").alias("a"), F.col("r.b").cast("int").alias("b"), "word", "n"))
    done = []
    while True:
        hot = written(todo.groupBy(*group).agg(F.sum("length").alias("size")).where(F.col("size") > limit).where("b - a > 1").select(*group), "hot-groups")
        if hot.isEmpty():
            break
        done.append(todo.join(hot, group, "left_anti"))
        halves = F.explode(F.expr("array(struct(a, (a + b) div 2 as b), struct((a + b) div 2 as a, b))"))
        cut = todo.join(hot, group).withColumn("r", halves).select("length", F.col("r.a").cast("int").alias("a"), F.col("r.b").cast("int").alias("b"), "word", "n")
        todo = written(_keyed(cut), "cut-groups")
    for df in done:
        todo = todo.unionByName(df.select(*todo.columns))
    return todo.select(*group, "word", "n")


def near_words(words: DataFrame, least: int = 6, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """word, n_near, and near, near_n: its near word of largest n (ties: smallest). Words without near words are left out."""
    group = ["length", "a", "b", "key"]
    rows = dealt(words, least, limit).repartition(*group).sortWithinPartitions(*group)
    found = rows.mapInArrow(_found(step), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, most_n: int, ratio: int, min_count: int) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Each step multiplies n by `ratio`, so the longest way is known; a round doubles it."""
    steps = max(1, math.ceil(math.log(max(most_n / min_count, 1), ratio)) + 1)
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, min_count: int = 5, ratio: int = 5, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(word_counts(docs, id_col, text_col, least, min_count), "words")
    near = near_words(words, least, limit, step)
    is_form = F.col("near_n") >= ratio * F.col("n")
    every = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    every = written(every, "variants")
    most = every.agg(F.max("n")).first()[0] or 0
    root = roots(every.where("form is not null").select("word", "form"), most, ratio, min_count)
    return every.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
  FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM shorter x JOIN shorter y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON y.word = x.rest
  UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON y.word = x.rest),
best AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS root FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT way.word, way.root FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN last l USING (word)
"""
