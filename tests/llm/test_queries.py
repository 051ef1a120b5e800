"""Queries without SQL against brute-force versions, over the whole smallest table."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm.mixing import targets
from sightline.llm.queries import queries

from .test_llm import brute_removal, placed_ok, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: t.encode(text or "", add_special_tokens=False).ids for d, text, _ in documents}


def test_op2(spark, ids):
    want = set()
    for d, x in ids.items():
        every = np.array([*x, 1], "<u4")
        want |= {(d, k, s, len(every[s : s + 4096]), zlib.crc32(every[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(every), 4096))}
    rows = queries()["op2_best_fit_packing"](spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    placed_ok(rows, 4096)
    assert len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 4096 + 1


def test_op6(spark, documents):
    rows = {r.doc_id: r for r in queries()["op6_source_mixing"](spark, SF).collect()}
    sizes = {}
    for d, text, s in documents:
        assert rows[d]["size"] == len(words(text)) and rows[d].taken <= 3 * rows[d]["size"]
        sizes.setdefault(s, []).append(d)
    aim = targets({s: sum(rows[d]["size"] for d in v) for s, v in sizes.items()})
    for s, v in sizes.items():
        assert rows[v[0]].target == aim[s]
        assert abs(sum(rows[d].taken for d in v) - aim[s]) <= max(rows[d]["size"] for d in v)


def test_op7(spark, ids):
    want, at = set(), 0
    for d in sorted(ids):
        every = np.array([*ids[d], 2], "<u4")
        want.add((d, at, len(every), zlib.crc32(every.tobytes())))
        at += len(every)
    rows = list(map(tuple, queries()["op7_token_files"](spark, SF).collect()))
    assert set(rows) == want and len(rows) == len(want)


def test_op8(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op8_suffix_array_dedup"](spark, SF).collect()}
    assert got == brute_removal([d[:2] for d in documents], 100)
