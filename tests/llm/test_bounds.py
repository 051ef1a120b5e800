"""Rules that hold at all sizes, names that Spark would take apart, and nothing left behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import chat_format, minhash_dedup, mixing, quality_rules, shared


def test_the_mix_of_lengths_does_not_jump():
    lengths, counts = np.arange(1, 201), np.full(200, 50)
    total = int((lengths * counts).sum())
    for budget in (1_000, 65_535, 65_536, 65_537, 300_000):
        take = mixing.fit(lengths, counts, budget)
        assert int((lengths * take).sum()) == budget
        even = counts * budget / total
        assert abs(int(take.sum()) - even.sum()) <= 0.05 * even.sum() + 20
        assert np.abs(take - even).max() <= 50 if budget < 10_000 else (np.abs(take - even) > 2).sum() <= 20


@pytest.mark.parametrize("line", ["Home{0} Products{0} Pricing{0} About{0} Contact{0}", "Home{0} | Products{0} | Pricing{0} About{0} Contact{0}"])
def test_documents_of_menu_lines_are_rejected(line):
    found, _ = quality_rules.judge("\n".join(line.format(i) for i in range(20)))
    assert not found["base_failed"] and not found["kept"] and found["failed_lines"] == "menu:20"


def test_headings_and_short_lists_stay():
    prose = "\n".join(" ".join(f"word{i * 20 + k}" for k in range(20)) + "." for i in range(6))
    text = "A heading of five words\n" + prose + "\nfirst thing of a list\nsecond thing of a list"
    found, stay = quality_rules.judge(text)
    assert found["kept"] and found["failed_lines"] == "" and stay == text


def test_column_names_with_dots(spark):
    prose = " ".join(f"Word{i} follows word{i + 1}, and so on." for i in range(12))
    docs = spark.createDataFrame([(1, prose, 3, "a"), (2, prose, 4, "b")], ["doc_id", "text", "meta.lang", "a b"])
    assert sorted(map(tuple, quality_rules.keep_good(docs).collect())) == [(1, prose, 3, "a"), (2, prose, 4, "b")]
    out = minhash_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, prose, 3, "a")]


def left(spark):
    folder = shared.shared_folder(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("sightline-")}


def test_no_texts_are_left_behind(spark):
    shared.forget_written(spark)
    before = left(spark)
    prose = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, prose + f" end{i}") for i in range(20)], "doc_id long, text string")
    assert minhash_dedup.linked(docs).where("kept").count() == 1
    assert not [f for f in left(spark) - before if "texts" in f]
    shared.forget_written(spark)
    assert left(spark) <= before
    broken = docs.select("doc_id", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        minhash_dedup.linked(broken).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sightline_texts")]
    assert not [f for f in left(spark) - before if "texts" in f]


def test_the_chat_query_meets_several_layouts(spark):
    roles = ["user", "assistant", "system", "human", "gpt", None, "tool"]
    rows = [(c, t, roles[(c + t) % 7], f"text {c} {t} \\ <s> \n") for c in range(9) for t in (2, 0, 1)] + [(None, 0, "user", None), (4, 1, "assistant", "same turn"), (5, 1, "assistant", "same turn"), (5, None, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_records(chat_format.in_layouts(turns), "conv_id", ["turn", "role", "text"], "record")
    got = out.orderBy("conv_id", "place").collect()
    assert {r.layout for r in got} == {"turn-rows", "messages", "from-value"}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert [(r.conv_id, *chat_format.parse(r.formatted)) for r in got] == [(c, role or "", text or "") for c, _, role, text in sorted(rows, key=key)]
