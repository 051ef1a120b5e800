"""Phrase collocations: position bitmaps per word, extended depth-first.

A task reads its documents into shards, one per language and at most `shard` positions
long. A shard numbers the words of its texts one after another; a piece boundary takes a
position of its own at which no word has its bit, so no phrase crosses it. Each word has
a compressed bitmap of its positions: the non-empty bytes, eight positions each, with
their numbers. The occurrences of a phrase followed by a word are the phrase's bitmap,
shifted by one, AND the word's; popcounts give their number, and the result is the bitmap
that the next word extends. The search goes depth-first, a slice of prefixes at a time,
so that a shard holds few bitmaps of phrases. Spark sums the popcounts over the shards.

Three passes over the texts keep what is shuffled small, and each is a map with sums:

1. words are counted; those below `min_count` cannot be in a candidate;
2. pairs of the other words are counted, by 56-bit hashes: a pair whose hash is rarer
   than `min_count` cannot be in one either (equal hashes only let more through);
3. phrases of up to `max_words` words whose pairs all passed are counted as text, exactly.

What passes goes to the tasks as a bit set of 2^filter_bits bits (16 MB), whatever the size of
the corpus; a full one lets more through to the sums and changes no result.

Defined cases: a null text counts as empty, a null language is `und`; repeated rows count
each; an empty table gives an empty result; texts, pieces and words have any length; other
columns are not read. Ties of score and count go by phrase, in UTF-8 byte order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dealt_bucket, written

#: Ends a piece; never a byte of UTF-8.
END = b"\xff"
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
#: Distinct words that a counting task holds, positions of a shard, bytes and pairs of bytes that a step of the search holds.
HELD, SHARD, STEP = 400_000, 1 << 22, 1 << 18


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, with END between pieces."""
    return (text or "").encode().translate(CLEAN).replace(END, b" \xff ").split()


def texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str | None]]:
    for lo in range(0, len(batch), 256):
        part = batch.slice(lo, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def counted(batches):
    """Word counts of a task, by language."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, words in held.items():
            words.pop(END, None)
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())], ["lang", "phrase", "f"])
        held.clear()

    for batch in batches:
        for lang, text in texts(batch):
            held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield from flush()
    yield from flush()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the set; a hash's last 8 bits don't count."""
    size = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for shift in (8, 36):
        at = (hashes >> np.uint64(shift)) & size
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def bit_set(hashes: DataFrame, filter_bits: int) -> Broadcast:
    """The set of the column h (hashes without their last 8 bits), made of sums over its 64-bit words, of which there are
    2^(filter_bits - 6) at most; filter_bits is 28 at most."""
    places = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << filter_bits) - 1)) for s in (0, 28)]))
    words = hashes.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


class Shard:
    """The bitmaps of a run of positions: rows of (word, byte number, byte), by word and by byte number."""

    def __init__(self, lang: str, words: list[bytes], hashes: np.ndarray, at: np.ndarray, word: np.ndarray):
        self.lang, self.hashes, self.text = lang, hashes, pa.array(words, pa.binary()).cast(pa.string())
        order = np.argsort(word, kind="stable").astype(np.int32)
        word, at = word[order], at[order]
        del order
        byte, bit = at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (byte[1:] != byte[:-1])])
        self.word, self.byte, self.bits = word[new], byte[new], np.bitwise_or.reduceat(bit, new)
        there = np.argsort(self.byte, kind="stable").astype(np.int32)
        self.there_word, self.there_bits = self.word[there], self.bits[there]
        self.start = np.zeros(int(self.byte.max()) + 3, np.int32)
        np.cumsum(np.bincount(self.byte, minlength=len(self.start) - 1), out=self.start[1:])

    def shifted(self, of: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps moved on by a position; each keeps its number in `of`."""
        stay, over = (bits << np.uint8(1)), bits >> np.uint8(7)
        a, b = np.flatnonzero(stay), np.flatnonzero(over)
        return np.r_[of[a], of[b]], np.r_[byte[a], byte[b] + 1], np.r_[stay[a], over[b]]

    def meet(self, of: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        """AND with the bitmaps of all words that have bits in the same bytes: rows of (of, word, byte, byte of bits)."""
        n = self.start[byte + 1] - self.start[byte]
        ends = np.cumsum(n, dtype=np.int64)
        lo = 0
        while lo < len(of):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            m = n[lo:hi]
            row = np.repeat(np.arange(lo, hi, dtype=np.int32), m)
            skipped = self.start[byte[lo:hi]] - (np.cumsum(m, dtype=np.int32) - m)
            at = np.arange(len(row), dtype=np.int32) + np.repeat(skipped, m)
            both = bits[row] & self.there_bits[at]
            full = np.flatnonzero(both)
            row = row[full]
            yield of[row], self.there_word[at[full]], byte[row], both[full]
            lo = hi

    def extended(self, of, byte, bits) -> Iterator[tuple]:
        """Phrases one word longer: (number of the prefix, word, popcount) each, and the rows of their bitmaps."""
        for p, w, at, both in (x for lo in range(0, len(of), STEP) for x in self.meet(*self.shifted(of[lo : lo + STEP], byte[lo : lo + STEP], bits[lo : lo + STEP]))):
            if not len(p):
                continue
            key = p.astype(np.int64) * len(self.hashes) + w
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            yield p[order][first], w[order][first], np.add.reduceat(np.bitwise_count(both[order]), first, dtype=np.int64), (np.cumsum(new) - 1, at[order], both[order])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, n, _ in self.extended(self.word, self.byte, self.bits):
            yield pair_hashes(self.hashes[a], self.hashes[b]), n

    def phrases(self, bits: np.ndarray, max_words: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        """Texts and popcounts of phrases whose pairs are in the set, and their words, depth-first."""
        yield from self._deeper(self.text, np.arange(len(self.hashes)), (self.word, self.byte, self.bits), bits, 2, max_words)

    def _deeper(self, text, last, rows, bits, k, max_words):
        for p, w, n, (of, at, both) in self.extended(*rows):
            good = passes(bits, pair_hashes(self.hashes[last[p]], self.hashes[w]))
            if not good.any():
                continue
            longer = pc.binary_join_element_wise(text.take(pa.array(p[good])), self.text.take(pa.array(w[good])), " ")
            yield longer, n[good], k
            if k < max_words:
                stay = good[of]
                yield from self._deeper(longer, w[good], ((np.cumsum(good) - 1)[of[stay]], at[stay], both[stay]), bits, k + 1, max_words)


def shards(batches, known: np.ndarray, size: int) -> Iterator[Shard]:
    """The shards of a task, with the words that are in the set."""
    numbers: dict[str, defaultdict] = {}
    ids: dict[str, list[np.ndarray]] = {}
    held = 0

    def built(lang: str) -> Shard | None:
        words, every = list(numbers.pop(lang)), np.concatenate(ids.pop(lang))
        hashes = word_hashes(lang, words)
        good = passes(known, hashes)
        good[0] = False  # END
        at = np.flatnonzero(good[every]).astype(np.int32)
        new = (np.cumsum(good) - 1).astype(np.int32)
        return Shard(lang, [words[i] for i in np.flatnonzero(good)], hashes[good], at, new[every[at]]) if len(at) else None

    def flush():
        for lang in list(ids):
            if (shard := built(lang)) is not None:
                yield shard

    for batch in batches:
        for lang, text in texts(batch):
            if lang not in numbers:
                numbers[lang] = defaultdict(count().__next__)
                numbers[lang][END], ids[lang] = 0, []
                numbers[lang].default_factory = count(1).__next__
            found = tokens(text)
            found.append(END)
            ids[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found)))
            held += len(found)
            if held >= size:
                yield from flush()
                held = 0
    yield from flush()


def _pairs(known: Broadcast, size: int):
    def run(batches):
        for shard in shards(batches, known.value, size):
            for h, n in shard.pairs():
                yield pa.record_batch([pa.array(packed(h, n))], ["packed"])

    return run


def packed(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash and count in one number each, the count in the last 8 bits; larger counts are parted."""
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    each = np.full(int(parts.sum()), 255, np.int64)
    each[first + parts - 1] = n - 255 * (parts - 1)
    return ((np.repeat(hashes, parts) & ~np.uint64(255)) | each.astype(np.uint64)).view(np.int64)


def _phrases(known: Broadcast, pairs: Broadcast, size: int, max_words: int):
    def run(batches):
        for shard in shards(batches, known.value, size):
            for text, n, k in shard.phrases(pairs.value, max_words):
                yield pa.record_batch([pa.array([shard.lang] * len(text), pa.string()), text, pa.array(n), pa.array(np.full(len(text), k, np.int32))], ["lang", "phrase", "f", "k"])

    return run


def _known_hashes(batches):
    for batch in batches:
        langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), xxhash.xxh3_64_intdigest(x.encode())) for x, w in zip(langs, words, strict=True)), np.uint64, len(words))
        yield pa.record_batch([pa.array((h >> np.uint64(8)).view(np.int64))], ["h"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, filter_bits: int = 27, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Counts of all words (lang, phrase, f), and of phrases of 2 to max_words words that occur min_count times or more (k: their words)."""
    read = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words = written(read.mapInArrow(counted, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    known = bit_set(words.where(F.col("f") >= min_count).select("lang", "phrase").mapInArrow(_known_hashes, "h long"), filter_bits)
    told = read.mapInArrow(_pairs(known, shard), "packed long").groupBy(F.shiftrightunsigned("packed", 8).alias("h")).agg(F.sum(F.col("packed").bitwiseAND(F.lit(255))).alias("f"))
    pairs = bit_set(told.where(F.col("f") >= min_count).select("h"), filter_bits)
    found = read.mapInArrow(_phrases(known, pairs, shard, max_words), "lang string, phrase string, f long, k int")
    return words, written(found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrases")


def part(words: Column, first: Column | int, n: Column) -> Column:
    """The text of n words of an array, from the first (counted from 1)."""
    return F.array_join(F.slice(words, first, n), " ")


def scores(words: DataFrame, phrases: DataFrame, min_count: int) -> DataFrame:
    """Each phrase with the parts' counts l and r of its lowest-scoring cut, and that score."""
    every = words.where(F.col("f") >= min_count).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(w, F.lit(1), F.col("cut")).alias("left"), part(w, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(14, 0)) * cast(a as decimal(14, 0)) * 1000000) div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(phrases: DataFrame, cover: int) -> DataFrame:
    """Phrases that lie inside a longer one with at least `cover` percent of their count."""
    inside = phrases.where("k > 2").select("lang", "k", F.col("f").alias("long_f"), F.split("phrase", " ").alias("w"))
    inside = inside.withColumn("n", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("first", F.explode(F.expr("sequence(1, k - n + 1)")))
    most = inside.groupBy("lang", part(F.col("w"), F.col("first"), F.col("n")).alias("phrase")).agg(F.max("long_f").alias("long_f"))
    return most.join(phrases.select("lang", "phrase", "f"), ["lang", "phrase"]).where(100 * F.col("long_f") >= cover * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, cover: int = 50, top: int = 2000, filter_bits: int = 27, shard: int = SHARD) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, phrases = phrase_counts(docs, text_col, lang_col, min_count, max_words, filter_bits, shard)
    left = scores(words, phrases, min_count).join(covered(phrases, cover), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First in buckets of a language, so that the last window gets `top` rows of each bucket only.
    left = left.withColumn("_b", dealt_bucket(64, "phrase"))
    left = left.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_k") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return left.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM lists),
grams AS (
  SELECT * FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM lists
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM lists),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM parts
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM parts WHERE k = 3),
scored AS (
  SELECT c.*, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS t FROM parts WHERE k = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM parts WHERE k = 3),
gone AS (SELECT i.lang, i.phrase FROM inside i JOIN f ON f.lang = i.lang AND f.phrase = i.phrase AND f.k = 2 GROUP BY ALL HAVING bool_or(100 * i.t >= 50 * f.a)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = b.lang AND g.phrase = b.phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""
