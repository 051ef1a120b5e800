"""Best-fit packing by exact complements.

Texts become token ids with an end id; those longer than a sequence are cut.
How many pieces there are of each length is a table of at most `capacity` rows,
so the plan is made from counts alone: lengths are taken from the longest, and
the gap that one leaves is looked up among single lengths, sums of two and sums
of three, using up combinations that fill it exactly as often as their counts
allow. What is left is packed best-fit, longest first, again many equal
sequences at a time. Pieces then get places by their rank among those of their
length. Ranks come from per-bucket counts, so a length that a third of all
pieces share costs no single task.

Defined cases: a null or empty text is its end id alone; repeated rows are packed
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .shared import bucket_bases, written

#: Pieces of one length are ranked in so many buckets.
BUCKETS = 4096


class Plan:
    """Slots (length, first rank, last rank + 1, first sequence, offset): pieces of a
    length with those ranks go to successive sequences at that offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.next_rank = np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.n_sequences = 0
        for length in range(capacity, 0, -1):
            if self.left[length]:
                self._index(capacity - length)
            while self.left[length] and (fill := self._complement(length)) is not None:
                self._use((length, *fill))
        self._best_fit()

    def _index(self, gap: int) -> None:
        """Which sums up to the gap two remaining lengths have. Counts only fall, so it
        stays a superset until the next length, and _pair() decides."""
        there = np.flatnonzero(self.left[: gap + 1]).tolist()
        singles, sums = sum(1 << x for x in there), 0
        for x in there:
            sums |= singles << x
        data = (sums & ((1 << (gap + 1)) - 1)).to_bytes(gap // 8 + 1, "little")
        self.pair_sums = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: gap + 1].astype(bool)

    def _place(self, length: int, times: int, sequence: int, offset: int) -> None:
        rank = int(self.next_rank[length])
        self.slots.append((length, rank, rank + times, sequence, offset))
        self.next_rank[length] += times
        self.left[length] -= times

    def _use(self, lengths: tuple[int, ...]) -> None:
        times = min(int(self.left[x]) // lengths.count(x) for x in lengths)
        offset = 0
        for x in lengths:
            self._place(x, times, self.n_sequences, offset)
            offset += x
        self.n_sequences += times

    def _pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths with that sum, larger first, that remain beside those taken."""
        left = self.left[: gap + 1].copy()
        for x in taken:
            if x <= gap:
                left[x] -= 1
        high = np.arange(-(-gap // 2), gap)
        fits = (left[high] > 0) & (left[gap - high] > 0) & ((high * 2 != gap) | (left[high] > 1))
        return (int(high[fits][-1]), gap - int(high[fits][-1])) if fits.any() else None

    def _complement(self, length: int) -> tuple[int, ...] | None:
        """Up to three more lengths that fill the gap exactly."""
        gap = self.capacity - length
        if gap == 0:
            return ()
        if self.left[gap] > (gap == length):
            return (gap,)
        if pair := self._pair(gap, (length,)):
            return pair
        third = np.arange(gap // 3 + 1)
        for third in third[(self.left[third] > 0) & self.pair_sums[gap - third]][::-1].tolist():
            if self.left[third] > (third == length) and (pair := self._pair(gap - third, (length, third))):
                return (*pair, third)
        return None

    def _best_fit(self) -> None:
        """The rest: each length, longest first, into the fullest sequences that have room."""
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        some = np.zeros(self.capacity + 1, bool)  # by free room: are there such sequences

        def put(room: int, lo: int, hi: int) -> None:
            if lo < hi:
                groups[room].append((lo, hi))
                some[room] = True

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                if some[length:].any():
                    room = length + int(some[length:].argmax())
                    lo, hi = groups[room].pop()
                    some[room] = bool(groups[room])
                else:
                    room, lo = self.capacity, self.n_sequences
                    hi = lo + -(-n // (self.capacity // length))
                    self.n_sequences = hi
                times = min(hi - lo, n)
                self._place(length, times, lo, self.capacity - room)
                put(room - length, lo, lo + times)
                put(room, lo + times, hi)


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", carry_ids: bool = False, max_words: int = tokens.WORDS, chunk: int = tokens.CHUNK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, bucket; with carry_ids its ids too."""

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "bucket") + ("ids",) * carry_ids
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "bucket": pa.int32(), "ids": pa.list_(pa.int32())}

    def cut(batches):
        encode, turn, last = tokens.encoder(tokenizer, max_words, chunk).encode_column, 0, np.array([end_id], np.uint32)
        for batch in batches:
            at = 0
            for n, flat, ends in encode(batch.column(1)):
                rows: list[tuple] = []
                lo = 0
                for doc_id, hi in zip(batch.column(0).slice(at, n).to_pylist(), ends.tolist(), strict=True):
                    size = hi - lo + 1  # with the end id
                    for k, start in enumerate(range(0, size, capacity)):
                        stop = min(start + capacity, size)
                        ids = flat[lo + start : min(lo + stop, hi)]
                        crc = tokens.crc32(ids)
                        if stop == size:
                            crc = tokens.crc32(last, crc)
                        turn += 1
                        row = (doc_id, k, start, stop - start, crc, turn % BUCKETS)
                        rows.append((*row, np.append(ids, last) if stop == size else ids) if carry_ids else row)
                    lo = hi
                at += n
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in zip(names, columns, strict=True)], names=list(names))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int" + ", ids array<int>" * carry_ids)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to written pieces (with length and bucket)."""
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    plan = Plan({r["length"]: r["count"] for r in counts}, capacity)
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
    first = slots[:, 0] * (1 << 44) + slots[:, 1]

    def assign(batches):
        for batch in batches:
            at = np.searchsorted(first, batch.column("length").to_numpy() * (1 << 44) + batch.column("rank").to_numpy(), "right") - 1
            sequence = slots[at, 3] + batch.column("rank").to_numpy() - slots[at, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(slots[at, 4])], names=[*keep, "sequence_id", "offset"])

    bases = bucket_bases(pieces, ["length"], "bucket").select("length", "bucket", "base")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "bucket"], (F.col("base") + F.col("_in")).cast("long").alias("rank"))
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", **cache) -> DataFrame:
    pieces = written(tokenised_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, **cache), "pieces")
    return place_pieces(pieces, capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences' ids, from placed pieces that carry theirs: at most `capacity` ids a group."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
