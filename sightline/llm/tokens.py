"""Texts to token ids with the tokenizers library, one distinct word at a time.

Where a tokenizer cuts at white space, a text's ids are those of its white-space
separated words in turn. A column of texts is split and its words are numbered by
Arrow kernels; each worker keeps the ids of words it has met (a bounded cache; when
full, it starts anew), asks the library for the others only, and gathers the ids of
all words with numpy. To meet fewer distinct words, ASCII capitals become small
first, as the tokenizer does itself (left alone in texts with combining accents,
which compose before that step). Texts that may hold the tokenizer's special strings
go to the library whole, and so do all texts if the tokenizer's steps before its
model are not those under which this holds (by_words())."""

from __future__ import annotations

import json
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, and bytes of texts split at a time (a longer text alone): with 1,000,000 and 8 MB a worker
#: takes some 450 MB, with 400,000 and 4 MB some 350 MB and a third more time.
WORDS, CHUNK = 1_000_000, 8 << 20

#: A piece that the steps before the model leave as it is (small letters, composed), then one of marks, if any.
SHAPE = "^(?P<piece>[a-z\u00df-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"

# Steps of a tokenizer that drops white space, cuts words of letters, digits and runs of marks, and makes letters small.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def by_words(tokenizer) -> bool:
    """Whether a text's ids are those of its words, made small: true of the steps above with a BPE model, special strings that start with "<|" and no step after."""
    spec = json.loads(tokenizer.to_str())
    added = all(t["content"].startswith("<|") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    return spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and not spec["post_processor"] and added


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: For pieces joined by spaces.
LETTERS = {b: c for b, c in byte_letters().items() if b != 0x20}


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids one after the other, and 0 and where each ends."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kind = np.int32 if max(int(ends[-1]), len(ids)) < 1 << 31 else np.int64  # half the memory
    place = np.repeat((starts - ends[:-1]).astype(kind), lengths)
    place += np.arange(ends[-1], dtype=kind)
    return ids[place], ends


class WordEncoder:
    """encode(texts) gives one uint32 array of ids per text; encode_column() one for all and where each text's end."""

    def __init__(self, path: str, max_words: int = WORDS, chunk: int = CHUNK):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_words, self.chunk = Tokenizer.from_file(path), max_words, chunk
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = by_words(self.tokenizer)
        self.bare = Tokenizer(self.tokenizer.model)  # the model alone, for pieces
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has: straight from the model, in short blocks, as long ones take longer a word."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(pieces), 256):
            block = pieces[lo : lo + 256]
            found = self.bare.encode(" ".join(block).encode().decode("latin-1").translate(LETTERS), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(block)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _lists(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.uint32, int(lengths.sum())), lengths

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words from the library, and how many each has: of a piece and marks after it each alone, others whole."""
        shape = pc.extract_regex(pa.array(words, pa.string()), SHAPE)
        plain = shape.is_valid().to_numpy(zero_copy_only=False)
        odd = self._lists([self._whole(words[i]) for i in np.flatnonzero(~plain).tolist()])
        both = shape.drop_null()
        pieces, marks = (both.field(k).dictionary_encode() for k in (0, 1))
        parts = [self._pieces(pieces.dictionary.to_pylist()), self._lists([self._whole(m) for m in marks.dictionary.to_pylist()]), odd]
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(lengths) - lengths
        # two stretches a word: piece and marks, or the word and nothing
        n_pieces, n_marks = len(pieces.dictionary), len(marks.dictionary)
        at = np.zeros((len(words), 2), np.int64)
        at[plain] = np.stack([pieces.indices.to_numpy(), n_pieces + marks.indices.to_numpy()], axis=1)
        at[~plain, 0] = n_pieces + n_marks + np.arange(len(odd[1]))
        long = lengths[at] if len(lengths) else np.zeros_like(at)
        long[~plain, 1] = 0
        flat, _ = gathered(ids, starts[at].ravel(), long.ravel())
        return flat, long.sum(axis=1)

    def _learn(self, words: list[str]) -> None:
        flat, lengths = self._ask(words)
        k = len(self.known)
        while k + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.starts, self.lengths))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[k : k + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k : k + len(words)] = lengths
        self.known.update(zip(words, range(k, k + len(words)), strict=True))
        self.used += len(flat)

    def _places(self, words: list[str]) -> np.ndarray:
        """Each distinct word's place in the cache."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(self.known) + len(new) > self.max_words:
            self._clear()
            new = np.arange(len(words))
        if len(new):
            found[new] = len(self.known) + np.arange(len(new))
            self._learn([words[i] for i in new.tolist()])
        return found

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of texts that go word by word."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        at, which = self._places(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        flat, ends = gathered(self.ids, self.starts[at][which], self.lengths[at][which])
        return flat, ends[words.offsets.to_numpy()[1:]]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.by_words:
            special = pc.match_substring(texts, "<|")
            small = pc.ascii_lower(texts)
            accents = pc.or_(pc.match_substring(texts.cast(pa.binary()), b"\xcc"), pc.match_substring(texts.cast(pa.binary()), b"\xcd"))
            if pc.any(accents).as_py():
                small = pc.if_else(accents, texts, small)
            if not pc.any(special).as_py():
                return self._split(small)
            flat, ends = self._split(pc.if_else(special, "", small))
            odd = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        else:
            flat, ends, odd = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), np.arange(len(texts))
        parts = np.split(flat, ends[:-1])
        for i in odd.tolist():
            parts[i] = np.array(self._whole(texts[i].as_py()), np.uint32)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode_column(self, texts: pa.Array):
        """For successive slices of texts, none null: their number, their ids and where each text's end."""
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + self.chunk, "right")) - 1)
            yield hi - lo, *self._chunk(texts.slice(lo, hi - lo))
            lo = hi
        pa.default_memory_pool().release_unused()  # workers are kept for later tasks of other kinds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, flat, ends in self.encode_column(pa.array(texts, pa.string())):
            out += np.split(flat, ends[:-1])
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, max_words: int = WORDS, chunk: int = CHUNK) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    key = (path, max_words, chunk)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def crc32(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data.cast("B") if len(ids) else b"", before)
