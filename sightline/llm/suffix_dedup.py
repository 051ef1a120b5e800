"""Removal of repeated passages by suffix arrays.

Each byte covered by a `length`-byte string that also starts earlier in the corpus
(smaller document id, or same document and earlier place) is removed.

Which strings can repeat? Every string of that length has an anchor: of its
`gram`-byte pieces the one with the smallest hash, the last of equals. Equal
strings have equal anchors at the same place inside, so only anchors whose hash
occurs twice matter. Neighbouring strings with one anchor form its context, and
contexts are dealt by the anchor's hash. Contexts equal in two 64-bit hashes are
merged beforehand: all strings of any but the first place of a context repeat.
First places alone send their bytes, so a passage with many copies is sorted once.

A passage in a third of all documents fills no task. Of an anchor's places that one
task meets, only the first is dealt by the anchor; others are known to repeat it and
are dealt by anchor and context, and those whose context the task has met before at an
earlier place are settled at once. Where the contexts of an anchor are many bytes (its edges
differ in each copy), they are cut into their strings, which are dealt by anchor and
a hash of the string. Anchors so cut are those above 1 / SHARE of all contexts' bytes,
SHARE at most.

Each task joins contexts to one text and sorts suffixes in two stages. Those that
are smaller than their successor are sorted directly (eight bytes at a time, ties
only); the others are induced by scanning the buckets of first bytes in ascending
order, each sorted suffix placing the one before it. Common prefixes of
neighbours then show the runs of equal strings; in each run the earliest place
stays. Only the suffixes that start a string, and those that these are induced
from, take part. Memory is that of the contexts of one anchor, which are cut as said.

What comes back per document is which strings of its repeated anchors are first
places; all other strings of those anchors go.

Defined cases: a null or empty text has no bytes, and a text shorter than
`length` loses none; overlapping repeats inside one document count; null ids come
after all others; rows with one id and different texts are taken in the order of
their texts' hashes; equal rows are one document and give equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .minhash_dedup import mixed, powers, splitmix
from .shared import release, written

LENGTH, GRAM = 100, 32
#: Bytes of contexts sorted at once; starts of strings taken from a text at once.
BATCH, STRETCH = 2 << 20, 1 << 20
#: Contexts of an anchor are cut into strings above this share of all contexts' bytes and above CUT bytes; a task remembers so many places of repeated contexts.
SHARE, CUT, REMEMBERED = 1 << 16, 1 << 18, 20_000
U = np.uint64
BYTE = splitmix(256, 11)
MULTIPLIER = int(splitmix(1, 12)[0]) | 1
PLACES = U((1 << 31) - 1)
NO_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each `gram`-byte piece, a power of two, by doubling."""
    h, n = BYTE[data], 1
    while n < gram:
        h = h[:-n] * U(pow(MULTIPLIER, n, 1 << 64)) + h[n:]
        n *= 2
    return mixed(h)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Per anchor: text number, hash, context's hash, first string's start, number of strings."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    n_strings = np.maximum(sizes - length + 1, 0)
    total = int(n_strings.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(data, gram)
    low, k, span = (h & ~PLACES) | (PLACES - np.arange(len(h), dtype=U)), 1, length - gram + 1
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[span - k : span - k + n])
    which = np.repeat(np.arange(len(texts)), n_strings)
    start = np.arange(total) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings) + begin[which]
    place = (PLACES - (low[start] & PLACES)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, total))
    lo, text = start[first], which[first]
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * power[: len(data)], out=sums[1:])
    context = mixed((sums[lo + count + length - 1] - sums[lo]) * inverse[lo] + count.astype(U))
    return text, h[place[first]].view(np.int64), context.view(np.int64), lo - begin[text], count


def sorted_suffixes(data: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """The starts marked in `own`, in the order of their first `length` bytes at least.

    data must go on for 2 * length bytes after the last marked start."""
    n = len(data) - 16
    steps = -(-length // 8)
    key = np.zeros(n, U)
    for j in range(8):
        key = (key << U(8)) | data[j : n + j].astype(U)
    # smaller than the successor: the next different byte is larger
    differs = np.flatnonzero(data[:-1] != data[1:])
    at = np.searchsorted(differs, np.arange(n))
    inside = at < len(differs)
    up = np.zeros(n, bool)
    turn = differs[at[inside]]
    up[inside] = data[turn] < data[turn + 1]
    # what takes part: marked starts, and after a larger one all up to the next smaller one
    ups = np.flatnonzero(up)
    larger = np.flatnonzero(own[:n] & ~up)
    stop = ups[np.minimum(np.searchsorted(ups, larger), len(ups) - 1)] if len(ups) else larger
    stop = np.maximum(stop, larger)
    edge = np.bincount(larger, minlength=n + 1) - np.bincount(stop + 1, minlength=n + 1)[: n + 1]
    part = own[:n] | (np.cumsum(edge)[:n] > 0)
    # stage one: sort the smaller ones, by eight bytes and then ties by the next eight
    direct = np.flatnonzero(part & up)
    order = np.argsort(key[direct], kind="stable")
    direct = direct[order]
    k = key[direct]
    group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)])) if len(k) else np.zeros(0, np.int64)
    tied = np.arange(len(direct))
    for step in range(1, steps + 1):
        size = np.bincount(group[tied], minlength=1)[group[tied]] if len(tied) else np.zeros(0, np.int64)
        tied = tied[size > 1]
        if not len(tied):
            break
        later = np.minimum(direct[tied] + 8 * step, n - 1)
        k, g = key[later], group[tied]
        order = np.lexsort((k, g))
        direct[tied] = direct[tied][order]
        k, g = k[order], g[order]
        new = np.cumsum(np.concatenate([[0], ((k[1:] != k[:-1]) | (g[1:] != g[:-1])).astype(np.int64)]))
        group = group.copy()
        group[tied] = new + (int(group.max()) + 1)
    # stage two: induce the larger ones, bucket by bucket
    byte = data[:n]
    cut = np.searchsorted(byte[direct], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(x: np.ndarray) -> np.ndarray:
        p = x[x > 0] - 1
        return p[part[p] & ~up[p]]

    ready = ~up & part  # larger ones without a sorted successor: those cut off at the end
    ready[: n - 1] &= ~part[1:]
    rest = np.flatnonzero(ready)
    if len(rest):
        rest = rest[np.lexsort((key[rest],))]
        for c in np.unique(byte[rest]).tolist():
            placed[c].append(rest[byte[rest] == c])
    for c in range(256):
        front = np.concatenate(placed[c]) if placed[c] else np.zeros(0, np.int64)
        done = []
        while len(front):
            done.append(front)
            p = before(front)
            front = p[byte[p] == c]
        done.append(direct[cut[c] : cut[c + 1]])
        bucket = np.concatenate(done)
        if not len(bucket):
            continue
        out.append(bucket)
        p = before(bucket)
        p = p[byte[p] > c]
        if len(p):
            p = p[np.argsort(byte[p], kind="stable")]
            ends = np.flatnonzero(np.append(byte[p][1:] != byte[p][:-1], True)) + 1
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                placed[int(byte[p[lo]])].append(p[lo:hi])
    every = np.concatenate(out) if out else np.zeros(0, np.int64)
    return every[own[every]]


def first_places(contexts: list[bytes], counts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For all strings of the contexts, joined: whether each is the first place of its bytes.

    order: the contexts' ranks by place in the corpus."""
    data = np.frombuffer(b"".join(contexts) + bytes(2 * length + 32), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin, total = np.cumsum(sizes) - sizes, int(counts.sum())
    which = np.repeat(np.arange(len(contexts)), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[which] + within
    own = np.zeros(len(data), bool)
    own[start] = True
    number = np.zeros(len(data), np.int64)
    number[start] = np.arange(total)
    found = sorted_suffixes(data, own, length)
    # common prefixes of neighbours: compared by eight bytes, down to where they differ
    same = np.arange(len(found) - 1)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for at in [*range(0, length - 8, 8), length - 8]:
        same = same[(words[found[same] + at].copy().view(U) == words[found[same + 1] + at].copy().view(U)).ravel()]
    new = np.ones(len(found), bool)
    new[same + 1] = False
    by_place = np.argsort(order, kind="stable")
    base = np.zeros(len(contexts), np.int64)
    base[by_place] = np.cumsum(counts[by_place]) - counts[by_place]
    place = base[which] + within
    if total:
        in_order = place[number[found]]
        heads = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(in_order, heads), np.diff(np.append(heads, len(found))))
        out = np.zeros(total, bool)
        out[number[found]] = in_order == least
        return out
    return np.zeros(0, bool)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.pmod(F.xxhash64(text), F.lit(1 << 17)).cast("int").alias("mark"), text.alias("text"))


#: What is known of an anchor's place, in the bits of `mark` above the document's own.
UNKNOWN, REPEATED, BY_CONTEXT, SETTLED = range(4)
MARK_BITS = 20


class Dealer:
    """Says for each anchor's place where it is dealt (deal, context, kind).

    By the anchor's hash, unknown or known to be REPEATED; of the anchor's later places, BY_CONTEXT by the hash xor the
    context; of the context's later places, SETTLED by the document, without a context."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.anchors, self.contexts = most, set(), {}

    def deal(self, h: np.ndarray, context: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        deal, kind = h.copy(), np.full(len(h), UNKNOWN, np.int32)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        some = order[np.append(same, False) | np.insert(same, 0, False)] if len(h) else order
        some = some[np.lexsort((place[some], mark[some], doc[some], context[some], h[some]))]
        begins = np.flatnonzero(np.append(True, (h[some][1:] != h[some][:-1]) | (context[some][1:] != context[some][:-1]))) if len(some) else some
        heads = some[begins]
        at = list(zip(doc[heads].tolist(), mark[heads].tolist(), place[heads].tolist(), strict=True))
        least: dict[int, int] = {}  # the first place of each anchor, if none has been dealt by it before
        keys = list(zip(h[heads].tolist(), context[heads].tolist(), strict=True))
        if len(self.contexts) + len(keys) > self.most:
            self.anchors, self.contexts = set(), {}
        for i, (anchor, _) in enumerate(keys):
            if anchor not in self.anchors and (anchor not in least or at[i] < at[least[anchor]]):
                least[anchor] = i
        kind[some] = SETTLED
        kind[heads] = BY_CONTEXT
        for i, key in enumerate(keys):
            if key in self.contexts and at[i] >= self.contexts[key]:  # an earlier place of the context has been met
                kind[heads[i]] = SETTLED
            else:
                self.contexts[key] = at[i]
        kind[heads[list(least.values())]] = REPEATED
        self.anchors.update(least)
        apart, settled = kind == BY_CONTEXT, kind == SETTLED
        deal[apart] ^= context[apart]
        deal[settled] = mixed(doc[settled].view(U)).view(np.int64)
        return deal, pa.array(context, mask=settled), kind


def _repeated_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, mark, places): per document its anchors whose hash occurs twice; place holds start and
    number of strings, hash is null but at the first places of a context (one, or one more where tasks dealt it apart)."""

    def run(batches):
        dealer = Dealer()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                docs, marks = part.column(0).to_numpy(), part.column(1).to_numpy()
                todo, texts, at, size = [], [], [], 0
                for i, t in enumerate(part.column(2).to_pylist()):
                    raw = t.encode()
                    for s in range(0, len(raw) - length + 1, STRETCH):
                        texts.append(raw[s : s + STRETCH + length - 1])
                        at.append((i, s))
                        size += len(texts[-1])
                        if size > STRETCH:
                            todo.append((texts, at))
                            texts, at, size = [], [], 0
                for texts, at in [*todo, (texts, at)]:
                    which, h, context, start, count = anchors(texts, length, gram)
                    if len(which):
                        own, off = np.array(at, np.int64).T
                        doc, mark, place = docs[own[which]], marks[own[which]], ((start + off[which]) << 8) | count
                        deal, context, kind = dealer.deal(h, context, doc, mark, place)
                        yield pa.RecordBatch.from_arrays([pa.array(deal), context, *map(pa.array, (doc, mark | kind << MARK_BITS, place))], names=["deal", "context", "doc", "mark", "place"])

    found = rows.select("doc", "mark", "text").where(F.length("text") * 4 >= length).mapInArrow(run, "deal long, context long, doc long, mark int, place long")
    own, kind = F.col("mark").bitwiseAND((1 << MARK_BITS) - 1), F.shiftright("mark", MARK_BITS)
    w = Window.partitionBy("deal").orderBy("context", "doc", own, "place")
    last, following = F.lag("context").over(w), F.lead("context").over(w)
    anchor = F.when(kind == BY_CONTEXT, F.col("deal").bitwiseXOR(F.col("context"))).otherwise(F.col("deal"))
    met = found.select(
        "doc", own.alias("mark"), "place", anchor.alias("hash"), ((kind != UNKNOWN) | last.isNotNull() | following.isNotNull()).alias("again"),
        (F.col("context").isNotNull() & (last.isNull() | (last != F.col("context")))).alias("lead"))
    kept = met.where("again").select("doc", "mark", F.struct("place", F.when(F.col("lead"), F.col("hash")).alias("hash")).alias("p"))
    return kept.groupBy("doc", "mark").agg(F.collect_list("p").alias("places"))


def _joined(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Written: each document with its repeated anchors, and its bytes, packed, if it has any; else its digest."""

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc"), batch.column("mark"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([packer.compress(t) for t in texts], pa.binary())],
                names=["id", "doc", "mark", "n_bytes", "sha", "packed"])

    packed = rows.mapInArrow(pack, "id long, doc long, mark int, n_bytes long, sha binary, packed binary")
    both = packed.join(places, ["doc", "mark"], "left")
    return written(both.withColumn("packed", F.when(F.col("places").isNotNull(), F.col("packed"))), "passages")


def _contexts(work: DataFrame, cut: dict[int, int], length: int) -> DataFrame:
    """Bytes of the first places: hash, part, doc, mark, start, count, bytes; those of anchors that are cut string by string."""
    names = ["hash", "part", "doc", "mark", "start", "count", "bytes"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                rows: list[tuple] = []
                for doc, mark, packed, places in zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "packed", "places")), strict=True):
                    raw = unpacker.decompress(packed)
                    for p in places:
                        h, start, count = p["hash"], p["place"] >> 8, p["place"] & 255
                        if h is None:
                            continue
                        if h in cut:
                            strings = ((i, raw[i : i + length]) for i in range(start, start + count))
                            rows += [(h, zlib.crc32(x) % cut[h], doc, mark, i, 1, x) for i, x in strings]
                        else:
                            rows.append((h, 0, doc, mark, start, count, raw[start : start + count + length - 1]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    some = work.where("places is not null").select("doc", "mark", "packed", "places")
    return some.mapInArrow(run, "hash long, part int, doc long, mark int, start long, count int, bytes binary")


def _cut_anchors(work: DataFrame, length: int, cut_bytes: int) -> dict[int, int]:
    """Anchors whose contexts are cut, and in how many parts: SHARE entries at most, by the share that each has."""
    sent = work.where("places is not null").select(F.explode("places").alias("p")).where("p.hash is not null")
    sizes = sent.groupBy("p.hash").agg(F.sum(F.col("p.place").bitwiseAND(255) + length - 1).alias("size"), F.sum(F.col("p.place").bitwiseAND(255)).alias("n"))
    sizes = written(sizes.where(F.col("size") > cut_bytes).unionByName(sizes.agg(F.lit(None).cast("long").alias("hash"), F.sum("size").alias("size"), F.sum("n").alias("n"))), "anchor-sizes")
    total = sizes.where("hash is null").first()["size"] or 0
    most = max(cut_bytes, total // SHARE)
    return {r["hash"]: -(-8 * r["n"] * length // most) for r in sizes.where((F.col("size") > most) & F.col("hash").isNotNull()).collect()}


def _firsts(contexts: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """(doc, mark, firsts): starts and numbers of strings that are first places."""

    def solve(held: list) -> pa.RecordBatch:
        docs, marks, starts, counts, contexts = zip(*held, strict=True)
        counts = np.array(counts, np.int64)
        order = np.empty(len(held), np.int64)
        order[np.lexsort((starts, marks, docs))] = np.arange(len(held))
        first = first_places(list(contexts), counts, order, length)
        firsts, at = [], 0
        for start, n in zip(starts, counts.tolist(), strict=True):
            own = first[at : at + n]
            at += n
            if own.all():
                firsts.append([start << 8 | n])
            else:
                edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                firsts.append([(start + a) << 8 | (b - a) for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(marks, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["doc", "mark", "firsts"])

    def run(batches):
        held, size, last, group = [], 0, None, None
        for batch in batches:
            for h, part, *row in zip(*(batch.column(c).to_pylist() for c in ("hash", "part", "doc", "mark", "start", "count", "bytes")), strict=True):
                if (h, part, *row[:3]) == last:  # of equal rows of documents
                    continue
                if (h, part) != group and size > batch_bytes:
                    yield solve(held)
                    held, size = [], 0
                group, last = (h, part), (h, part, *row[:3])
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    dealt = contexts.repartition("hash", "part").sortWithinPartitions("hash", "part", "doc", "mark", "start")
    return dealt.mapInArrow(run, "doc long, mark int, firsts array<long>")


def removed_mask(n: int, places: list[int], firsts: list[int], length: int) -> np.ndarray:
    """Which of a text's bytes go: those in strings of its places that are no first places."""
    edge = np.zeros(n + 1, np.int32)
    for sign, some in ((1, set(places)), (-1, firsts)):
        if some:
            x = np.array(list(some), np.int64)
            np.add.at(edge, x >> 8, sign)
            np.add.at(edge, (x >> 8) + (x & 255), -sign)
    starts = np.flatnonzero(np.cumsum(edge) > 0)
    cover = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(cover)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH, spans: bool = False, cut_bytes: int = CUT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with `spans` also the removed (from, to) and the bytes that stay."""
    rows = _rows(docs, id_col, text_col)
    work = _joined(rows, _repeated_anchors(rows, length, gram))
    release(docs.sparkSession)
    firsts = _firsts(_contexts(work, _cut_anchors(work, length, cut_bytes), length), length, batch_bytes).groupBy("doc", "mark").agg(F.flatten(F.collect_list("firsts")).alias("firsts"))
    some = work.where("places is not null").select("id", "doc", "mark", "packed", F.col("places.place").alias("places")).join(firsts, ["doc", "mark"], "left")

    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in range(6)]
                for packed, places, first in zip(*(part.column(c).to_pylist() for c in ("packed", "places", "firsts")), strict=True):
                    raw = unpacker.decompress(packed)
                    gone = removed_mask(len(raw), places, first or [], length)
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    stay = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    ranges = [[a, b] for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)]
                    for column, v in zip(out, (len(raw), int(gone.sum()), len(ranges), hashlib.sha256(stay).hexdigest(), ranges, stay), strict=True):
                        column.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, t) for x, t in list(zip(out, types, strict=True))[: 6 if spans else 4])], names=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept_bytes"] * spans]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept_bytes binary" * spans
    changed = some.select("id", "packed", "places", "firsts").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    whole = work.where("places is null").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))
    if spans:  # the caller has these texts
        whole = whole.withColumn("spans", F.array().cast("array<array<long>>")).withColumn("kept_bytes", F.lit(None).cast("binary"))
    return whole.unionByName(changed).withColumnRenamed("id", id_col)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
