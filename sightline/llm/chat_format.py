"""Chat formatting with layouts recognised by schema fingerprints.

A record is JSON of whatever layout. Its nested field paths, sorted and hashed,
are its fingerprint; a table from fingerprints to declarative mappings says where
role and text of each turn are, so heterogeneous prompt, instruction and message
layouts become the same canonical turns. Optional fields make several
fingerprints of one layout; all are registered, and fields that no layout has (names,
weights, tags) don't count. Records of unknown layout are
kept as rows with layout null and no turn, for the caller to see.

Turns are then rendered, one row per turn, in template order:

    <|im_start|>role\\ntext<|im_end|>\\n

with the loss mask as a span of code points in that row. Inside role and text
each backslash is doubled and each control string gets a backslash after its
first character, so no text can end a turn or open one; removing one level of
backslashes restores it. A conversation's output is its rows joined in order;
rows, not conversations, are the unit, so a conversation of any length is
streamed and none is held in memory.

Defined cases: null role or text counts as empty; null turns come first; equal
turns sort by role and text; repeated rows repeat turns; a null conversation id
is a conversation; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

# Control strings of common chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>"]
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Layouts: a name, where the turns are, and their mapping. Paths end in the field; "[]" goes through an array.
#: A fixed role starts with "=". The roles of some layouts get canonical names.
LAYOUTS = [
    {"name": "turn-rows", "paths": [["role", "text"], ["role", "text", "turn"], ["conv_id", "role", "text", "turn"]], "turns": [("role", "text")]},
    {"name": "messages", "paths": [["messages[].content", "messages[].role"], ["id", "messages[].content", "messages[].role"]], "each": "messages", "turns": [("role", "content")]},
    {"name": "from-value", "paths": [["conversations[].from", "conversations[].value"], ["conversations[].from", "conversations[].value", "id"]], "each": "conversations", "turns": [("from", "value")]},
    {"name": "prompt-response", "paths": [["prompt", "response"], ["prompt", "response", "system"]], "turns": [("=system", "system"), ("=user", "prompt"), ("=assistant", "response")]},
    {"name": "prompt-completion", "paths": [["completion", "prompt"]], "turns": [("=user", "prompt"), ("=assistant", "completion")]},
    {"name": "instruction", "paths": [["instruction", "output"], ["input", "instruction", "output"]], "turns": [("=user", ("instruction", "input")), ("=assistant", "output")]},
    {"name": "question-answer", "paths": [["answer", "question"]], "turns": [("=user", "question"), ("=assistant", "answer")]},
    {"name": "nested-prompt", "paths": [["answer.text", "prompt.text"]], "turns": [("=user", "prompt.text"), ("=assistant", "answer.text")]},
]
# Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(record, at: str = "") -> set[str]:
    """Paths of all leaf fields; array elements share the path of their array."""
    if isinstance(record, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in record.items())) if record else set()
    if isinstance(record, list):
        return set().union(*(field_paths(v, at + "[]") for v in record)) if record else {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(paths): layout for layout in LAYOUTS for paths in layout["paths"]}
#: Fields of any layout; a record that has others besides is recognised by these.
KNOWN = {path for layout in LAYOUTS for paths in layout["paths"] for path in paths}


def _value(record, path) -> str | None:
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record if record is None or isinstance(record, str) else json.dumps(record, ensure_ascii=False)


def canonical_turns(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout's name and turns (role, text); (None, []) where the layout is unknown."""
    paths = field_paths(record)
    layout = REGISTRY.get(fingerprint(paths)) or REGISTRY.get(fingerprint(paths & KNOWN))
    if layout is None:
        return None, []
    turns = []
    for item in record[layout["each"]] if "each" in layout else [record]:
        for role, text in layout["turns"]:
            said = [_value(item, p) for p in ((text,) if isinstance(text, str) else text)]
            if role.startswith("="):
                if role == "=system" and not said[0]:
                    continue
                turns.append((role[1:], "\n\n".join(x for x in said if x)))
            else:
                who = _value(item, role) or ""
                turns.append((ROLES.get(who, who) if layout["name"] == "from-value" else who, said[0] or ""))
    return layout["name"], turns


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """A turn's output and its loss span [from, to), none unless the assistant speaks."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
    return head + body + CLOSE, *span


TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(CLOSE), re.S)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    m = TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a turn of this template")
    return unescape(m[1]), unescape(m[2])


def format_records(records: DataFrame, conv_col: str, order_cols: list[str], json_col: str) -> DataFrame:
    """Written output: conv_id, place, layout, formatted, loss_from, loss_to; one row per turn, a
    row with layout and formatted null per record of unknown layout. Records of a
    conversation are taken in order_cols' order, ties by their JSON."""
    names = [f"_o{i}" for i in range(len(order_cols))]
    rows = records.select(F.col(conv_col).cast("long").alias("conv_id"), *[F.col(c).alias(n) for c, n in zip(order_cols, names, strict=True)], F.col(json_col).alias("_json"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *[F.col(n).asc_nulls_first() for n in names], "_json").select("conv_id", "_json")

    def run(batches):
        last, place = (), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (conv,) != last:
                    last, place = (conv,), 0
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                layout, turns = canonical_turns(record) if isinstance(record, dict) else (None, [])
                for shown in [render(*t) for t in turns] or [(None, None, None)]:
                    for column, v in zip(out, (conv, place, layout, *shown), strict=True):
                        column.append(v)
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", "place", "layout", "formatted", "loss_from", "loss_to"])

    return written(dealt.mapInArrow(run, "conv_id long, place long, layout string, formatted string, loss_from long, loss_to long"), "chat")


def read_back(output: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unknown."""
    dealt = output.select("conv_id", "place", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches):
        state: list = []

        def row():
            conv, n, turns, n_loss, loss, chars, unknown = state
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv], pa.int64()), "n_turns": pa.array([n], pa.int64()), "turns_sha256": [turns.hexdigest()], "loss_chars": pa.array([n_loss], pa.int64()),
                "loss_sha256": [loss.hexdigest()], "formatted_chars": pa.array([chars], pa.int64()), "n_unknown": pa.array([unknown], pa.int64())})

        for batch in batches:
            done = []
            for conv, _, formatted, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state or state[0] != conv:
                    if state:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if formatted is None:
                    state[6] += 1
                    continue
                role, text = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    said = unescape(formatted[lo:hi])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(formatted)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state:
            yield row()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unknown long")


# Fixed value: a text of control strings, as conversation -1 says it.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def in_layouts(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as JSON records of three layouts, dealt by conversation: rows, messages, and from-value
    pairs with that layout's own names of roles (turns of roles that it would rename go as rows)."""
    whole = {"ignoreNullFields": "false"}
    theirs = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    as_row = F.to_json(F.struct("role", "text", "turn"), whole)
    as_messages = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), whole)
    as_pairs = F.to_json(F.struct(F.array(F.struct(theirs.alias("from"), F.col("text").alias("value"))).alias("conversations"), F.col("conv_id").alias("id")), whole)
    dealt = F.pmod("conv_id", F.lit(3))
    record = F.when(dealt == 1, as_messages).when((dealt == 2) & ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), as_pairs).otherwise(as_row)
    return rows.select("conv_id", "turn", "role", "text", record.alias("record"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_records(in_layouts(stored.unionByName(added)), "conv_id", ["turn", "role", "text"], "record"))


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
           length(text) + length(role) + len(regexp_extract_all(text || chr(0) || role, '\\'))
           + len(regexp_extract_all(text || chr(0) || role, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<\|eot_id\|>|<\|start_header_id\|>|<\|end_header_id\|>|<\|begin_of_text\|>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>'))
           + len(regexp_extract_all(role, '\n')) + 12 + 1 + 11 AS n
    FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(said))::BIGINT AS loss_chars, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS n_unknown
FROM e GROUP BY conv_id
"""
