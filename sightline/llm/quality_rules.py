"""Quality rules, line first.

Each line is judged alone: symbols (too many of `#*$%&|<>` for its words),
navigation (menu separators; a few words without an end mark), shouting (mostly
capitals, or marks like !! after its words), boilerplate (stock phrases of four
languages in short lines), repetition (equal to an earlier line) and menus (lines of 4 to 12 words
without any mark of a sentence; headings and lists have them too, so they fail only where they hold
more than half of a document's words). Failing lines go. A document is
rejected if it loses more than `max_lost` of its words with them, or if it fails
the base rules: fewer than 50 words, or over half of its words in three-word
windows that occur twice or more.

Words are maximal runs without ASCII white space. Everything is computed per
document, over its whole text, in one pass of a map; nothing is shuffled.

Defined cases: a null text has no word and fails the base rules; a line without a
word is neither judged nor repeated; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
SPACES = b" \t\n\r\x0b\x0c"
MIN_WORDS, MAX_REPEATED = 50, 50

# Stock phrases of web pages in English, German, French and Spanish, in small letters.
BOILERPLATE = re.compile("|".join([
    "lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "read more", "sign up", "log in", "subscribe to", "share this", "skip to content", "back to top",
    "cookie-richtlinie", "datenschutzerkl(?:ä|ae)rung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "weiterlesen", "mehr lesen", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen", "nach oben",
    "politique de cookies", "politique de confidentialit(?:é|e)", "conditions d(?:'|’)utilisation", "tous droits r(?:é|e)serv(?:é|e)s", "mentions l(?:é|e)gales", "cliquez ici", "lire la suite", "en savoir plus", "se connecter", "haut de page",
    "pol(?:í|i)tica de cookies", "pol(?:í|i)tica de privacidad", "t(?:é|e)rminos de uso", "condiciones de uso", "todos los derechos reservados", "aviso legal", "haga clic aqu(?:í|i)", "leer m(?:á|a)s", "iniciar sesi(?:ó|o)n", "ir al contenido"]).encode())
END_MARKS = tuple(x.encode() for x in (".", "!", "?", "…", '"', "'", "”", "»", ")", ":", ";"))
DOUBLE = re.compile(rb"!!|\?\?")
SENTENCE = re.compile("[.,;:!?]|…".encode())
MENU = range(4, 13)


def line_fails(line: bytes, n_words: int) -> str | None:
    """The first rule that a line with words breaks."""
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols:
        if b"|" in line and line.count(b"|") >= 3 and 5 * line.count(b"|") >= n_words:
            return "navigation"
        if 10 * symbols > 3 * n_words:
            return "symbols"
    capitals = len(line) - len(line.translate(None, CAPITALS))
    if capitals >= 10 and 2 * capitals > len(line) - len(line.translate(None, LETTERS)):
        return "shouting"
    if (b"!!" in line or b"??" in line) and 10 * len(DOUBLE.findall(line)) > 3 * n_words:
        return "shouting"
    if n_words <= 3 and not line.rstrip(SPACES).endswith(END_MARKS):
        return "navigation"
    if n_words <= 15 and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def n_repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, last, n = Counter(windows), -1, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 2 - max(last, i - 1)
            last = i + 2
    return n


def judge(text: str | None, max_lost: float = 0.5) -> tuple[dict, str]:
    """Measures and verdict of a text, and the text of the lines that stay."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, rules, lost, why, dup, menu = set(), [], 0, Counter(), 0, 0
    lines = raw.split(b"\n")
    for line in lines:
        n = len(line.split())
        rule = None
        if n:
            if line in seen:
                dup, rule = dup + 1, "repeated"
            else:
                seen.add(line)
                rule = line_fails(line, n)
                if rule is None and n in MENU and not SENTENCE.search(line):
                    rule, menu = "menu", menu + n
        rules.append((rule, n))
    some = 2 * menu > len(words)
    rules = [(None if rule == "menu" and not some else rule, n) for rule, n in rules]
    for rule, n in rules:
        if rule:
            lost += n
            why[rule] += 1
    stay = [line for line, (rule, _) in zip(lines, rules, strict=True) if not rule]
    n_words, repeated = len(words), n_repeated(words)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
    out = {
        "n_words": n_words, "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACES))), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup, "n_repeat_words": repeated, "base_failed": failed, "kept": not failed and lost <= max_lost * n_words,
        "lost_words": lost, "failed_lines": ",".join(f"{k}:{v}" for k, v in sorted(why.items())),
    }
    return out, b"\n".join(stay).decode()


TYPES = {"base_failed": "boolean", "kept": "boolean", "failed_lines": "string"}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "failed_lines"]


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, cleaned: bool = False) -> DataFrame:
    """One row per document: id, the measures, kept, lost_words, failed_lines; with `cleaned` also the text of the lines that stay."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                found = [judge(t, max_lost) for t in part.column(1).to_pylist()]
                columns = [part.column(0)] + [pa.array([x[0][m] for x in found], {"boolean": pa.bool_(), "string": pa.string()}.get(TYPES.get(m, ""), pa.int64())) for m in MEASURES]
                if cleaned:
                    columns.append(pa.array([x[1] for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *MEASURES] + ["cleaned"] * cleaned)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{m} {TYPES.get(m, 'long')}" for m in MEASURES) + ", cleaned string" * cleaned
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5, size_col: str | None = None) -> DataFrame:
    """The documents that pass, with all their columns, in one map without a join: the text is that of the lines that
    stay, and `size_col`, if given, its code points."""
    at = docs.columns.index(text_col)
    size = None if size_col is None else docs.columns.index(size_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                found = [judge(t, max_lost) for t in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array([x[1] for x in found], part.schema.field(at).type))
                if size is not None:
                    part = part.set_column(size, part.schema.field(size), pa.array([len(x[1]) for x in found], part.schema.field(size).type))
                yield part.filter(pa.array([x[0]["kept"] for x in found], pa.bool_()))

    # Spark takes the columns of a result by name, and one with a dot for a field: they go by plain names.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM d),
l AS (SELECT rid, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
             length(line) - length(translate(line, '|', '')) AS pipes,
             length(line) - length(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
             length(line) - length(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS letters,
             len(regexp_extract_all(line, '!!|\?\?')) AS doubles,
             row_number() OVER (PARTITION BY rid, line ORDER BY place) AS nth FROM p),
u AS (SELECT rid, n, line, CASE
          WHEN nth > 1 THEN 'repeated'
          WHEN pipes >= 3 AND 5 * pipes >= n THEN 'navigation'
          WHEN symbols > 0 AND 10 * symbols > 3 * n THEN 'symbols'
          WHEN capitals >= 10 AND 2 * capitals > letters THEN 'shouting'
          WHEN 10 * doubles > 3 * n THEN 'shouting'
          WHEN n <= 3 AND NOT regexp_matches(line, '(\.|!|\?|…|"|''|”|»|\)|:|;)[\x20\x09-\x0D]*$') THEN 'navigation'
          WHEN n <= 15 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'BOILERPLATE') THEN 'boilerplate'
      END AS rule FROM l WHERE n > 0),
v AS (SELECT *, rule IS NULL AND n BETWEEN 4 AND 12 AND NOT regexp_matches(line, '[.,;:!?]|…') AS menu FROM u),
r AS (SELECT rid, n, CASE WHEN menu AND 2 * sum(CASE WHEN menu THEN n ELSE 0 END) OVER (PARTITION BY rid) > sum(n) OVER (PARTITION BY rid) THEN 'menu' ELSE rule END AS rule FROM v),
c AS (SELECT rid, rule, count(*) AS k, sum(n) AS lost FROM r WHERE rule IS NOT NULL GROUP BY rid, rule),
f AS (SELECT rid, sum(lost)::BIGINT AS lost_words, string_agg(rule || ':' || k, ',' ORDER BY rule) AS failed_lines,
             coalesce(max(k) FILTER (rule = 'repeated'), 0) AS n_dup_lines FROM c GROUP BY rid),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)),
g AS (SELECT rid, i, w || chr(1) || lead(w) OVER o || chr(1) || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS twice FROM g),
m AS (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM h),
s AS (SELECT rid, count(*) AS n_words, sum(covered)::BIGINT AS n_repeat_words FROM m GROUP BY rid),
j AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(lost_words, 0) AS lost_words, coalesce(failed_lines, '') AS failed_lines
      FROM d LEFT JOIN s USING (rid) LEFT JOIN f USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 2 * lost_words <= n_words AS kept, lost_words, failed_lines FROM b
""".replace("BOILERPLATE", BOILERPLATE.pattern.decode().replace("'", "''"))
