"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's score comes from features of its own bytes
and words (marks, capitals, repetition, lengths) and of the lines before and after
it; the field adds weights for the first line's state and for each pair of neighbouring
states. Forward and backward sums give each line's probability of being good; their mean,
weighted by the lines' lengths, is the quality of the document, which a logistic curve
turns into the probability of label 1.

Labels are of documents. A first fit takes a document's label for all its lines, from
each line's own features alone; then, in documents of label 0, the lines that it calls good
with `sure` and more count as good, as long as half the text stays bad, and the whole
field is fitted to these states. The fit is on the
driver, on a bounded sample: the `sample_docs` labelled documents with the smallest
hashes of their ids, of those with up to `sample_lines` lines (at most 4096 x 256 lines of
35 numbers by default). Everything is scored, in one map over whole texts.

Lines are split at \\n; those without a word are left out. Defined cases: a null or empty
text is scored as one line without features; a null id is not held out; repeated rows
repeat; ids with labels of both kinds and null labels are not learnt from; without labels
of both kinds every score is the share of label 1 (0.5 without labels); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at in one go (a longer text is one go of its own).
STEP = 1 << 21

# Classes of bytes.
SPACE, UPPER, LOWER, DIGIT, SYMBOL, PIPE, SHOUT, STOP, HIGH = 1, 2, 3, 4, 5, 6, 7, 8, 9
CLASS = np.zeros(256, np.uint8)
for _kind, _chars in ((SPACE, b" \t\n\v\f\r"), (UPPER, bytes(range(65, 91))), (LOWER, bytes(range(97, 123))), (DIGIT, b"0123456789"), (SYMBOL, b"#*$%&<>"), (PIPE, b"|"), (SHOUT, b"!?"), (STOP, b".,;:")):
    CLASS[list(_chars)] = _kind
CLASS[128:] = HIGH

FEATURES = ["words", "bytes", "word length", "capitals", "digits", "symbols", "pipes", "shouts", "stops", "other letters", "begins upper", "ends with a mark", "seen before", "repeated words", "repeated windows", "first", "last"]
#: Those that a line also takes from its neighbours.
SHARED = [FEATURES.index(f) for f in ("words", "capitals", "symbols", "pipes", "shouts", "stops", "seen before", "repeated words", "repeated windows")]
WIDTH = len(FEATURES) + 2 * len(SHARED)

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key stands before each, and whether any other is equal."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return before, any_


@dataclass
class Lines:
    """Lines with words of some documents, in order: their features, lengths, documents and numbers (from 0) in these."""

    x: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    number: np.ndarray


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines of documents that lie one after another in data (bytes)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Lines(np.zeros((0, WIDTH), np.float32), none, none, none)
    kind = CLASS[data]
    starts = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1])
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(line_doc, line_doc)
    ends = np.r_[starts[1:], len(data)]
    begins = np.zeros(len(data), bool)
    begins[starts] = True
    full = kind != SPACE
    word_start = np.flatnonzero(full & (begins | np.r_[True, ~full[:-1]]))
    word_end = np.flatnonzero(full & np.r_[begins[1:] | ~full[1:], True]) + 1
    word_line = np.searchsorted(starts, word_start, "right") - 1

    # A word's or line's hash: a sum of bytes times powers, moved to place 0.
    powers = np.full(len(data), _P, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)]

    def hashes(a, b):
        back = np.full(len(data), _P_INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        return _mixed((sums[b] - sums[a]) * back[a])

    words = hashes(word_start, word_end)
    n_words = np.bincount(word_line, minlength=len(starts))
    word_doc = line_doc[word_line]
    repeated, _ = _seen(words + _mixed(word_line.astype(np.uint64)))
    in_window = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = word_doc[2:] == word_doc[:-2]
        window = _mixed(words[:-2] + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9)) + _mixed(word_doc[2:].astype(np.uint64))
        _, twice = _seen(np.where(inside, window, _mixed(np.arange(len(window), dtype=np.uint64) * _P)))
        for k in range(3):
            in_window[k : len(words) - 2 + k] |= twice & inside
    content = np.r_[0, np.cumsum(full)]
    length = content[ends] - content[starts]
    by_class = {k: np.add.reduceat(kind == k, starts, dtype=np.int64) for k in (UPPER, LOWER, DIGIT, SYMBOL, PIPE, SHOUT, STOP, HIGH)}
    last = np.zeros(len(starts), np.int64)
    first = np.zeros(len(starts), np.int64)
    first[word_line[::-1]] = kind[word_start[::-1]]
    last[word_line] = kind[word_end - 1]
    line_end = np.zeros(len(starts), np.int64)
    line_end[word_line] = word_end
    line_start = np.array(starts)
    line_start[word_line[::-1]] = word_start[::-1]
    kept = np.flatnonzero(n_words > 0)
    before, _ = _seen(hashes(line_start[kept], line_end[kept]) + _mixed(line_doc[kept].astype(np.uint64)))

    def share(what, of):
        return what / np.maximum(of, 1)

    w, doc = n_words[kept], line_doc[kept]
    letters = (by_class[UPPER] + by_class[LOWER])[kept]
    ratio = lambda k: (lambda r: r / (0.2 + r))(share(by_class[k][kept], w))
    edge = np.r_[True, doc[1:] != doc[:-1], True]
    own = np.column_stack([
        np.log1p(w), np.log1p(length[kept]), share(length[kept], w), share(by_class[UPPER][kept], letters), share(by_class[DIGIT][kept], length[kept]),
        ratio(SYMBOL), ratio(PIPE), ratio(SHOUT), ratio(STOP), share(by_class[HIGH][kept], length[kept]),
        first[kept] == UPPER, np.isin(last[kept], (SHOUT, STOP)), before,
        share(np.bincount(word_line[repeated], minlength=len(starts))[kept], w), share(np.bincount(word_line[in_window], minlength=len(starts))[kept], w),
        edge[:-1], edge[1:]]).astype(np.float32)
    x = np.zeros((len(kept), WIDTH), np.float32)
    n, s = len(FEATURES), len(SHARED)
    x[:, :n] = own
    x[1:, n : n + s] = own[:-1][:, SHARED] * ~edge[1:-1, None]
    x[:-1, n + s :] = own[1:][:, SHARED] * ~edge[1:-1, None]
    return Lines(x, length[kept], doc, number[kept])


def with_empty(lines: Lines, n_docs: int) -> Lines:
    """A line without features for documents that have none."""
    empty = np.setdiff1d(np.arange(n_docs), lines.doc)
    doc = np.r_[lines.doc, empty]
    order = np.argsort(doc, kind="stable")
    more = lambda a, v: np.r_[a, np.full(len(empty), v, a.dtype)][order]
    return Lines(np.r_[lines.x, np.zeros((len(empty), lines.x.shape[1]), np.float32)][order], more(lines.length, 1), doc[order], more(lines.number, -1))


class Chains:
    """Documents' lines as chains, worked on side by side: the t-th lines of all documents that have so many."""

    def __init__(self, doc: np.ndarray):
        self.first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.diff(np.r_[self.first, len(doc)])
        order = np.argsort(-sizes, kind="stable")
        left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        self.steps = [self.first[order[:k]] + t for t, k in enumerate(left)]
        self.n = len(doc)

    def marginals(self, score: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Probabilities of the lines' states (bad, good), sums of those of first states and of pairs, and the log of the norms."""
        scale = np.maximum(score, 0)
        node = np.column_stack([np.exp(-scale), np.exp(score - scale)])
        alpha, norm, beta = np.empty((self.n, 2)), np.empty(self.n), np.ones((self.n, 2))
        pairs, move = np.zeros((2, 2)), np.exp(trans)
        for t, at in enumerate(self.steps):
            a = node[at] * (np.exp(start) if t == 0 else alpha[self.steps[t - 1][: len(at)]] @ move)
            norm[at] = a.sum(1)
            alpha[at] = a / norm[at][:, None]
        for t in range(len(self.steps) - 1, 0, -1):
            at, before = self.steps[t], self.steps[t - 1][: len(self.steps[t])]
            onward = node[at] * beta[at] / norm[at][:, None]
            pairs += (alpha[before].T @ onward) * move
            beta[before] = onward @ move.T
        p = alpha * beta
        return p, p[self.first].sum(0), pairs, float(np.log(norm).sum() + scale.sum())


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights[:-1] + self.weights[-1]

    def good(self, lines: Lines) -> np.ndarray:
        """Each line's probability of being good."""
        if not len(lines.doc):
            return np.zeros(0)
        return Chains(lines.doc).marginals(self.line_scores(lines.x), self.start, self.trans)[0][:, 1]

    def document_scores(self, lines: Lines, n_docs: int) -> np.ndarray:
        every = with_empty(lines, n_docs)
        return 1 / (1 + np.exp(-(self.slope * weighted_means(self.good(every), every, n_docs) + self.shift)))


def weighted_means(p: np.ndarray, lines: Lines, n_docs: int) -> np.ndarray:
    length = lines.length.astype(float)
    return np.bincount(lines.doc, p * length, n_docs) / np.maximum(np.bincount(lines.doc, length, n_docs), 1)


def _fit_chain(model: Model, lines: Lines, state: np.ndarray, rounds: int, penalty: float, alone: bool) -> None:
    """Maximum likelihood of the lines' states with a quadratic penalty, by Adam steps over all lines; alone: lines know nothing of their neighbours."""
    chains = Chains(lines.doc)
    x = np.column_stack([np.clip((lines.x - model.mean) / model.spread, -6, 6), np.ones(len(lines.doc))])
    inner = np.flatnonzero(lines.doc[1:] == lines.doc[:-1])
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (state[inner], state[inner + 1]), 1)
    seen_first = np.bincount(state[chains.first], minlength=2)
    theta = np.r_[model.weights, model.start, model.trans.ravel()]
    mean, square, d = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    free = np.ones_like(theta)
    if alone:
        free[FEATURES.index("first") : WIDTH] = 0
        free[d:] = 0
    for k in range(1, rounds + 1):
        p, first, pairs, _ = chains.marginals(x @ theta[:d], theta[d : d + 2], theta[d + 2 :].reshape(2, 2))
        slope = np.r_[x.T @ (state - p[:, 1]), seen_first - first, (seen_pairs - pairs).ravel()] / len(state) - penalty * theta
        slope *= free
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    model.weights, model.start, model.trans = theta[:d], theta[d : d + 2], theta[d + 2 :].reshape(2, 2)


def fit_model(lines: Lines, labels: np.ndarray, rounds: int = 150, penalty: float = 1e-3, sure: float = 0.5) -> Model:
    """The field and the logistic curve, from lines of documents 0..n-1 with labels (0, 1)."""
    n = len(labels)
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), np.zeros(2), np.zeros((2, 2)), 0.0, 0.0)
    share = labels.mean() if n else 0.5
    if not n or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        model.shift = float(np.log(share / (1 - share)))
        return model
    lines = with_empty(lines, n)
    model.mean, model.spread = lines.x.mean(0), np.maximum(lines.x.std(0), 1e-3)
    state = labels[lines.doc].astype(int)
    _fit_chain(model, lines, state, rounds, penalty, alone=True)
    p = model.good(lines)
    bad = np.flatnonzero(labels[lines.doc] == 0)
    order = bad[np.lexsort((-p[bad], lines.doc[bad]))]  # the surest lines of each document first
    total = np.cumsum(lines.length[order])
    first = np.searchsorted(lines.doc[order], lines.doc[order])
    within = total - (total[first] - lines.length[order][first])
    of = np.bincount(lines.doc, lines.length, n)
    turn = order[(p[order] >= sure) & (2 * within <= of[lines.doc[order]])]
    state[turn] = 1
    _fit_chain(model, lines, state, rounds, penalty, alone=False)
    mean = weighted_means(model.good(lines), lines, n)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps
        q = 1 / (1 + np.exp(-(a * mean + b)))
        weight = np.maximum(q * (1 - q), 1e-9)
        grad = np.array([(mean * (labels - q)).sum() - 0.05 * a, (labels - q).sum() - 0.05 * b])
        curve = np.array([[(weight * mean * mean).sum() + 0.05, (weight * mean).sum()], [(weight * mean).sum(), weight.sum() + 0.05]])
        move = np.linalg.solve(curve, grad)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def _pieces(batch: pa.RecordBatch, column: int):
    """Rows [lo, hi) of a batch whose texts have up to STEP bytes, with their bytes and offsets."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    lo = 0
    sizes = np.cumsum(np.r_[0, pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)]).astype(np.int64)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + STEP, "right")) - 1)
        part = pa.concat_arrays([texts.slice(lo, hi - lo)])
        offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        held = part.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
        yield lo, hi, data, offsets - offsets[0]
        lo = hi


def _line_tables(sample_lines: int):
    """For the fit: a row per document with its lines' features and lengths."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in _pieces(batch, 1):
                lines = read_lines(data, offsets)
                of = np.searchsorted(lines.doc, np.arange(hi - lo + 1))
                keep = [i for i in range(hi - lo) if of[i + 1] - of[i] <= sample_lines]
                cells = [(lines.x[of[i] : of[i + 1]].tobytes(), lines.length[of[i] : of[i + 1]].astype(np.int64).tobytes()) for i in keep]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(keep, pa.int64())), batch.column(2).slice(lo, hi - lo).take(pa.array(keep, pa.int64())), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], ["label", "at", "x", "length"])

    return run


def third(id_col: str):
    """crc32 of the id as text, mod 3: 1 is held out."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 4096, sample_lines: int = 256) -> Model:
    """Learns from labelled documents that are not held out."""
    told = labels.where(f"`{label_col}` in (0, 1)").groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(label_col).cast("double").alias("label"), F.max(label_col).cast("double").alias("most"))
    told = told.where("label = most and id is not null").where(third("id") != 1).select("id", "label", F.xxhash64("id").alias("at")).orderBy("at", "id").limit(sample_docs)
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(told), "id").select("label", "text", "at")
    rows = sorted(read.mapInArrow(_line_tables(sample_lines), "label double, at long, x binary, length binary").limit(2 * sample_docs).collect(), key=lambda r: (r["at"], bytes(r["x"])))
    sizes = [len(r["length"]) // 8 for r in rows]
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, WIDTH)
    length = np.frombuffer(b"".join(r["length"] for r in rows), np.int64)
    number = np.concatenate([np.arange(n) for n in sizes]) if rows else np.zeros(0, np.int64)
    return fit_model(Lines(x, length, np.repeat(np.arange(len(rows)), sizes), number), np.array([r["label"] for r in rows]))


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line with words: id, line (from 0), length (bytes that are no white space), p_good, good."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in _pieces(batch, 1):
                lines = read_lines(data, offsets)
                p = model.good(lines)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(lines.doc)), pa.array(lines.number.astype(np.int64)), pa.array(lines.length.astype(np.int64)), pa.array(p), pa.array(p >= 0.5)], ["id", "line", "length", "p_good", "good"])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, line long, length long, p_good double, good boolean").withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in _pieces(batch, 1):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(model.document_scores(read_lines(data, offsets), hi - lo))], ["id", "score"])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (third("id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
