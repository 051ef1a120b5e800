"""Token ids as fixed-width bit-packed files.

A file holds the documents of one range of ids. Layout (little-endian):

    magic "SLTOK1\\0\\0", then blocks, then the tail, then its offset (uint64)

A block packs `BLOCK` ids of `bits` bits each, `bits` being the fewest that the
vocabulary needs; the last block is filled up with zeros. As 32 ids take exactly
`bits` words of 32 bits, a block unpacks with one numpy shift per column and no
loop over ids. The tail is a zlib-packed JSON header (bits, ids, documents,
block offsets, lengths of its arrays) and three int64 arrays: document ids, a
null mark for each, and the first id of each document. A reader takes the tail,
and then only the blocks that hold the documents it wants.

Files are written by the tasks that own a range: to a name of their own per
attempt, and only the files that the finished attempts report are read.

Defined cases: a null text counts as empty, and each document has its end id, so
none is empty; null ids sort first; rows equal in id keep any order; an empty
table makes no file; a text of any length is one document; other columns are not
read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import fresh_path, written

MAGIC = b"SLTOK1\0\0"
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, a multiple of 32 of them, in `bits` bits each."""
    rows = ids.astype(np.uint64).reshape(-1, 32)
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, word] |= (rows[:, j] << np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        if shift + bits > 32:
            out[:, word + 1] |= rows[:, j] >> np.uint64(32 - shift)
    return out.astype("<u4").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u4").reshape(-1, bits).astype(np.uint64)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 32:
            x |= words[:, word + 1] << np.uint64(32 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)


class Writer:
    """Appends documents to an open binary stream; keeps at most a block of ids."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at = stream, bits, len(MAGIC)
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            every = np.concatenate(self.held)
            full = len(every) - len(every) % BLOCK
            for lo in range(0, full, BLOCK):
                self._block(every[lo : lo + BLOCK])
            self.held, self.n_held = [every[full:]], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            every = np.concatenate(self.held)
            self._block(np.concatenate([every, np.zeros(-len(every) % 32, every.dtype)]))
        head = zlib.compress(json.dumps({"bits": self.bits, "ids": self.n_ids, "docs": len(self.docs), "end": self.at, "offsets": self.offsets}).encode())
        names = np.array([d or 0 for d in self.docs], "<i8")
        nulls = np.array([d is None for d in self.docs], "<i8")
        self.stream.write(struct.pack("<Q", len(head)) + head + names.tobytes() + nulls.tobytes() + np.array(self.starts, "<i8").tobytes())
        self.stream.write(struct.pack("<Q", self.at))


class Reader:
    """Random access to the documents of a file that can seek."""

    def __init__(self, stream, size: int):
        self.stream = stream
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        tail = struct.unpack("<Q", self._bytes(size - 8, 8))[0]
        n = struct.unpack("<Q", self._bytes(tail, 8))[0]
        self.head = json.loads(zlib.decompress(self._bytes(tail + 8, n)))
        k, at = self.head["docs"], tail + 8 + n
        names, nulls, self.starts = np.frombuffer(self._bytes(at, 24 * k), "<i8").reshape(3, k)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, nulls, strict=True)]
        self.ends = np.append(self.starts[1:], self.head["ids"])
        self._have: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _block(self, k: int) -> np.ndarray:
        if self._have[0] != k:
            offsets = [*self.head["offsets"], self.head["end"]]
            self._have = k, unpack(self._bytes(offsets[k], offsets[k + 1] - offsets[k]), self.head["bits"])
        return self._have[1]

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at a place."""
        lo, hi = int(self.starts[place]), int(self.ends[place])
        parts = [self._block(k)[max(lo - k * BLOCK, 0) : hi - k * BLOCK] for k in range(lo // BLOCK, -(-hi // BLOCK))]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns their index (file, place, n_docs, n_ids), one row each, written too."""
    bits = bits_for(vocabulary)

    def write(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        context, encode = TaskContext.get(), tokens.encoder(tokenizer).encode_column
        writer = stream = None
        name = f"{top}/range-{context.partitionId():06d}-{context.taskAttemptId()}.tok"
        for batch in batches:
            at = 0
            for n, flat, ends in encode(batch.column(1)):
                if writer is None:
                    store.create_dir(top, recursive=True)
                    stream = store.open_output_stream(name)
                    writer = Writer(stream, bits)
                for doc_id, ids in zip(batch.column(0).slice(at, n).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                at += n
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "place": [context.partitionId()], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ranges = rows.repartitionByRange("_id").sortWithinPartitions("_id")
    return written(ranges.mapInArrow(write, "file string, place long, n_docs long, n_ids long"), "token-index")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, in file order inside each file.

    The index has one short row per range of ids, so the driver adds up the files' starts."""
    spark = index.sparkSession
    files, start = [], 0
    for r in sorted(index.collect(), key=lambda r: r.place):
        files.append((r.file, start))
        start += r.n_ids

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(file) as stream:
                    reader = Reader(stream, stream.size())
                    for lo in range(0, len(reader.doc_ids), 20_000):
                        at = range(lo, min(lo + 20_000, len(reader.doc_ids)))
                        crc = [tokens.crc32(reader.document(k)) for k in at]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([reader.doc_ids[k] for k in at], pa.int64()), "start": pa.array(base + reader.starts[lo : at.stop], pa.int64()),
                            "n_tokens": pa.array(reader.ends[lo : at.stop] - reader.starts[lo : at.stop], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    listed = spark.createDataFrame(files, "file string, base long") if files else spark.createDataFrame([], "file string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(spark, "token-files")
    index = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path, vocabulary_size(path), end_id=2)
    return read_token_files(index, folder)
