"""The pipeline's stages against brute-force versions on the smallest table."""

import re

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sightline.llm import quality_rules  # noqa: E402
from sightline.llm.mixing import targets  # noqa: E402

from .test_llm import components_of, placed_ok, words  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out.persist()
        steps[name] = out.collect()
    judged = [(r, *quality_rules.judge(r[1])) for r in rows]
    good = [(r[0], cleaned, r[2]) for r, found, cleaned in judged if found["kept"]]  # without the lines that fail
    assert sorted((r.doc_id, r.text, r.n_chars) for r in steps["quality rules"]) == [(i, t, len(t)) for i, t, _ in good]
    first = {}
    for r in good:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    single = list(first.values())
    assert sorted(r.doc_id for r in steps["exact dedup"]) == sorted(r[0] for r in single)
    component = components_of([r[:2] for r in single])
    kept = {r[0]: r for r in single if component[r[0]][1] == r[0]}
    assert sorted(r.doc_id for r in steps["MinHash near-dedup"]) == sorted(kept)
    mixed = steps["source mixing"]
    assert {r.doc_id for r in mixed} <= set(kept)
    own = {}
    for r in kept.values():
        own.setdefault(r[2], []).append(len(words(r[1])))
    for source, aim in targets({s: sum(v) for s, v in own.items()}).items():  # as near as any choice of documents comes
        passes, rest = divmod(round(aim), sum(own[source]))
        sums = {0}
        for n in own[source]:
            sums |= {x + n for x in sums}
        taken = sum(len(words(r.text)) for r in mixed if r.source == source) - passes * sum(own[source])
        assert abs(taken - rest) == min(abs(x - rest) for x in sums)
    assert max(sum(x.doc_id == i for x in mixed) for i in kept) <= 3
    pieces = steps["best-fit packing"]
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(r.doc_id for r in mixed)
    placed_ok(pieces, 4096)


def test_run_has_the_last_stage_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    rows = out.collect()
    assert len(rows) > 50
    placed_ok(rows, 4096)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_odd_rows(spark, k):
    """Each stage on no rows, and on rows with nulls, repeats, empty and long texts and a further column."""
    from pyspark.sql import functions as F

    name, stage = corpus_pipeline.STAGES[k]
    text = " ".join(f"w{i}" for i in range(60)) + "."
    odd = [(None, text, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, text, "en", None, 1), (3, text, "en", None, 1), (4, text.replace("w7 ", "w7  "), "de", "t", 1), (5, ("Longer text here. " + text + "\n") * 300, "en", "t", 9), (6, " \t\n", "fr", "u", 3)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit("own"))
    assert stage(spark, docs.limit(0), SF).count() == 0
    out = stage(spark, docs, SF)
    ids = [r.doc_id for r in out.collect()]
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    want = {"quality rules": {None, 3, 4}, "exact dedup": {1, 3, 5, 6}, "MinHash near-dedup": {None, 1, 2, 3, 6}}.get(name)
    assert want is None or set(ids) == want
    assert len(ids) > 0
