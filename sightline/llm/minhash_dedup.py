"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Documents with equal
sets form a class, merged before anything else by counts that combine early.
Each class has a sketch of minwise tokens. In each of TREES independent trees
the classes branch by a token of their own: those that share it meet in a node.
At a node the smallest class is compared with one of each other component, which
connects most groups of copies with as many comparisons as members. Nodes whose members are
all connected need nothing more. Small nodes (by members and by the bytes of their
sets) are compared exhaustively; the others branch again by further tokens chosen by
the node, each level from tokens of its own (a second one in half of the cases, so that
pairs at the threshold stay together on average), level by level. Nodes still mixed
after MAX_LEVELS are compared whole. Exhaustive comparisons go by pairs of blocks.

Comparisons outside small nodes first drop pairs that set sizes or sketches rule
out (an agreement under LEAST_AGREEMENT of the sketch is 3.9 standard deviations
below the threshold). All links are confirmed on the full sets. A pair at the threshold
meets in no tree with probability 0.25 ** TREES, about one in a million. In nodes
larger than SMALL each level loses more of such pairs, if no other link joins
them: with f(0) = 0, g(k) = 0.25 + 0.75 f(k) and f(k+1) = (g(k) + g(k)**2) / 2, a
pair in large nodes of all trees for k levels is missed with probability
g(k) ** TREES: 4.5e-5 after one, 2.6e-4 after two, after which the rest is compared
whole.

Links stay tables; components come from alternating star steps. Hot keys: equal
sets are merged by (set, salt), and what is known of a node is summed up by (node, salt)
and comes back to its members so; a large node's star is compared in parts, each with
the centre; an exhaustive comparison has at most two blocks, bounded by BLOCK and SET_ROWS.

Defined cases: null and empty texts, and those of white space, have an empty set
and are linked with nothing; fewer words than five make one shingle of all;
repeated rows with equal ids are one document in linking and give repeated
results; a row with a null id takes no part, gets a null component and is kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import dealt_bucket, dropped, fresh_path, written

WORDS, PERCENT = 5, 75
TREES, TOKENS, SMALL, MAX_LEVELS = 10, 128, 2048, 2
LEAST_AGREEMENT = 0.6
SALTS, NODE_SALTS, BROADCAST_ROWS = 16, 64, 2_000
#: Shingles of all sets that are compared with each other at once; members of a node that one task compares with its centre; members of a block of which two are compared exhaustively.
SET_ROWS, STAR, BLOCK = 2_000_000, 256, 512
LEVEL_TOKENS = (TOKENS - TREES) // MAX_LEVELS

U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


BYTE, FACTOR, ADDEND = splitmix(256, 1), splitmix(TOKENS, 2) | U(1), splitmix(TOKENS, 3)
BASE = int(splitmix(1, 4)[0]) | 1
_POWERS: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 21), b, U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    out, group, size = [], [], 0
    for text in texts:
        plain = b" ".join((text or "").encode().lower().split())
        if group and size + len(plain) > 1 << 20:
            out += _sets(group)
            group, size = [], 0
        group.append(plain)
        size += len(plain) + 1
    return out + (_sets(group) if group else [])


def _sets(plain: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * power[: len(data)], out=sums[1:])
    gap = data <= 32
    gap &= (data == 32) | (data == 10)
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & ~np.concatenate([[True], gap[:-1]]))
    doc_end = np.cumsum([len(p) + 1 for p in plain])
    last_word = np.searchsorted(start, doc_end)  # words up to each document's end
    out, lo = [], 0
    first = np.concatenate([[0], last_word[:-1]])
    n_words = last_word - first
    n_here = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    which = np.repeat(np.arange(len(plain)), n_here)
    w = np.arange(len(which)) - np.repeat(np.cumsum(n_here) - n_here, n_here) + first[which]
    s, e = start[w], end[w + np.minimum(WORDS, n_words[which]) - 1]
    h = mixed((sums[e] - sums[s]) * inverse[s])
    for n in n_here.tolist():
        out.append(np.unique(h[lo : lo + n]))
        lo += n
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For non-empty sets: minwise tokens (sets x TOKENS), and two sums that tell sets apart."""
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    tokens = np.empty((len(sets), TOKENS), np.uint32)
    for i in range(TOKENS):
        tokens[:, i] = np.minimum.reduceat(((every * FACTOR[i] + ADDEND[i]) >> U(32)).astype(np.uint32), at)
    return tokens, np.add.reduceat(mixed(every ^ U(0x5851F42D4C957F2D)), at).view(np.int64), np.add.reduceat(mixed(every * U(0x14057B7EF767814F)), at).view(np.int64)


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: id, n, s1, s2, sketch (null where the set is empty)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets(part.column(1).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                s1 = s2 = sketch = [None] * len(sets)
                if some:
                    tokens, one, two = sketches([sets[i] for i in some])
                    s1, s2, sketch = ([None] * len(sets) for _ in range(3))
                    for k, i in enumerate(some):
                        s1[i], s2[i], sketch[i] = int(one[k]), int(two[k]), tokens[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary())], names=["id", "n", "s1", "s2", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "id long, n long, s1 long, s2 long, sketch binary"), "sketches")


def _confirmed(pairs: DataFrame, table: str) -> DataFrame:
    """Written: those of pairs (a, b) whose full sets are similar enough. One centre's set
    is kept while its partners stream by; a centre with many partners is dealt by salt."""
    texts = pairs.sparkSession.table(table)
    if pairs.count() <= BROADCAST_ROWS:
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = texts.join(F.broadcast(ends), "id", "left_semi")
    salted = pairs.withColumn("salt", dealt_bucket(SALTS, "b"))
    right = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        centre = np.zeros(0, U)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                keep = []
                for i, s in enumerate(shingle_sets(part.column("text").to_pylist())):
                    if b[i] is None:
                        centre = s
                    else:
                        both = len(np.intersect1d(centre, s, assume_unique=True))
                        if 100 * both >= PERCENT * (len(centre) + len(s) - both):
                            keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], names=["a", "b"])

    return written(dealt.mapInArrow(run, "a long, b long"), "links")


def _branch(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Children of nodes (node, id, n, tree): by one token the node chooses, and in half of the nodes by a second."""
    pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(LEVEL_TOKENS - k))
    one, two = pick(0), F.pmod(pick(0) + 1 + pick(1), F.lit(LEVEL_TOKENS))
    token = lambda c: F.substring(F.col("sketch"), (4 * (c + TREES + level * LEVEL_TOKENS) + 1).cast("int"), F.lit(4))
    child = lambda c: F.xxhash64("node", c, token(c))
    second = F.when(F.pmod(F.xxhash64("node", F.lit("second")), F.lit(2)) == 0, child(two))
    joined = rows.join(classes.select("id", "sketch"), "id")
    return joined.select("id", "n", "tree", F.explode(F.array_compact(F.array(child(one), second))).alias("node"))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", dealt_bucket(NODE_SALTS, "id"))


def _met(rows: DataFrame) -> DataFrame:
    """(node, _salt, k, size, centre): nodes where two or more meet, a row for each salt of their members; those of equal
    members count once if small. Combined by (node, salt), so no node is one task."""
    part = _salted(rows).groupBy("node", "_salt").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"), F.min("id").alias("centre"), F.max("id").alias("last"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    met = part.groupBy("node").agg(*[f(c).alias(c) for f, c in ((F.sum, "k"), (F.sum, "size"), (F.min, "centre"), (F.max, "last"), (F.sum, "sum"))], F.collect_list("_salt").alias("salts")).where("k > 1")
    few = met.where(_is_small()).groupBy("k", "centre", "last", "sum").agg(F.min_by(F.struct("node", "size", "salts"), "node").alias("one"))
    every = few.select("one.node", "k", "one.size", "centre", "one.salts").unionByName(met.where(~_is_small()).select("node", "k", "size", "centre", "salts"))
    return every.select("node", "k", "size", "centre", F.explode("salts").alias("_salt"))


def _is_small():
    return (F.col("k") <= SMALL) & (F.col("size") <= SET_ROWS)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Ids must be numbers that fit a long. The table of texts goes when the links are known, or on an error."""
    texts = "sightline_texts_" + uuid.uuid4().hex
    place = fresh_path(docs.sparkSession, "texts")
    try:
        member, comp = _found(docs, id_col, text_col, texts, place)
    finally:  # all that was read from it is written
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {texts}")
        dropped(docs.sparkSession, place)
    return _told(member, comp, id_col)


def _found(docs: DataFrame, id_col: str, text_col: str, name: str, place: str) -> tuple[DataFrame, DataFrame | None]:
    """Written: documents with their classes, and classes with their components."""
    every = _sketched(docs, id_col, text_col)
    salted = every.select("id", "n", "s1", "s2", dealt_bucket(64, "id").alias("salt"))
    # classes of equal sets: combined per (set, salt) first, so copies cost no task of their own
    part = salted.where("n > 0 and id is not null").groupBy("n", "s1", "s2", "salt").agg(F.min("id").alias("low"))
    groups = part.groupBy("n", "s1", "s2").agg(F.min("low").alias("class"), F.collect_set("salt").alias("salts"))
    groups = groups.select("n", "s1", "s2", "class", F.explode("salts").alias("salt"))
    own = salted.join(groups, ["n", "s1", "s2", "salt"], "left")
    member = written(own.select("id", "n", F.when(F.col("id").isNotNull(), F.col("class")).alias("class")), "classes")
    firsts = member.where("id = class").select("id").distinct()
    classes = written(every.join(firsts, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "sketch"), "class-sketches")

    token = lambda k: F.substring(F.col("sketch"), 4 * k + 1, 4)
    rows = classes.select("id", "n", F.posexplode(F.array(*[F.xxhash64(F.lit(k), token(k)) for k in range(TREES)])).alias("tree", "node"))
    texts = comp = None
    for level in range(MAX_LEVELS + 1):
        rows = written(_salted(rows).join(_met(rows), ["node", "_salt"]).drop("_salt"), f"nodes-{level}")
        if not rows.take(1):
            break
        if texts is None:
            active = classes.join(rows.select("id").distinct(), "id", "left_semi")
            classes = written(active, "met")
            texts = _texts_of(docs, classes, id_col, text_col, name, place)
            one = rows.where(F.col("tree") == 0)  # most copies are connected by one tree; the others then compare less
            comp = _linked_by(_star_pairs(_named(one, comp), classes), comp, texts)
        rows = _mixed(rows, comp)
        comp = _linked_by(_star_pairs(rows, classes), comp, texts)
        rows = _mixed(rows, comp)
        now = rows if level == MAX_LEVELS else rows.where(_is_small())
        comp = _grown(comp, written(_node_links(now, texts).distinct(), "links"))
        rows = rows.where(~_is_small())
        if level == MAX_LEVELS or not rows.take(1):
            break
        rows = written(_branch(rows.select("node", "id", "n", "tree"), classes, level), f"branch-{level}")
    return member, comp


def _told(member: DataFrame, comp: DataFrame | None, id_col: str) -> DataFrame:
    out = member.select("id", "n", "class")
    if comp is not None:
        named = comp.select(F.col("id").alias("class"), "component")
        out = written(member.select("class").distinct().join(named, "class"), "named")
        # the class of a large group of copies is dealt by salt again
        salted = member.withColumn("salt", dealt_bucket(SALTS, "id"))
        wanted = out.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        out = salted.join(wanted, ["class", "salt"], "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _texts_of(docs: DataFrame, met: DataFrame, id_col: str, text_col: str, name: str, place: str) -> str:
    """The texts of the classes that met any other, in a table (its name) bucketed by id: each later join
    by id reads its buckets and shuffles none of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    some = rows.join(met.select("id"), "id", "left_semi")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some.repartition(n, "id").dropDuplicates(["id"]).write.bucketBy(n, "id").option("path", place).saveAsTable(name)
    return name


def _grown(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component), with written links taken in: only components that
    links join are worked on again."""
    if comp is None:
        return written(components(links), "components")
    a, b = (comp.select(F.col("id").alias(c), F.col("component").alias("c" + c)) for c in "ab")
    both = links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    both = written(both.where("ca <> cb"), "joins")
    if not both.take(1):
        return comp
    merged = components(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    ends = both.select(F.col("a").alias("id"), F.col("ca").alias("component")).unionByName(both.select(F.col("b").alias("id"), F.col("cb").alias("component")))
    every = comp.unionByName(ends).distinct()
    return written(every.join(merged.toDF("component", "_to"), "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "components")


def _linked_by(pairs: DataFrame, comp: DataFrame | None, texts: str) -> DataFrame:
    """Components after confirming pairs (a, b)."""
    pairs = written(pairs.distinct(), "pairs")
    if not pairs.take(1):
        return comp if comp is not None else written(components(pairs), "components")
    return _grown(comp, _confirmed(pairs, texts))


def _star_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes' members (node, id, k, centre, comp) that sizes and sketches don't rule out: the
    node's smallest member with the first member of each other component. A large node is dealt in parts, and
    its centre goes to all of them."""
    parts = F.ceil(F.col("k") / STAR).cast("int")
    spread = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts).cast("int")))
    joined = rows.select("node", "id", "comp", F.explode(spread).alias("part")).join(classes, "id")
    dealt = joined.select("node", "part", "id", "comp", "n", "sketch").repartition("node", "part").sortWithinPartitions("node", "part", "id")

    def compare(held: list) -> pa.RecordBatch:
        ids, comp, n = (np.array([h[i] for h in held], np.int64) for i in range(3))
        x = np.frombuffer(b"".join(h[3] for h in held), np.uint32).reshape(-1, TOKENS)
        near = np.maximum(n[0], n) * PERCENT <= np.minimum(n[0], n) * 100
        near &= (comp != comp[0]) & ((x == x[:1]).mean(axis=1) >= LEAST_AGREEMENT)
        at = np.flatnonzero(near)
        b = ids[at[np.unique(comp[at], return_index=True)[1]]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), ids[0])), pa.array(b)], names=["a", "b"])

    def run(batches):
        group, held = None, []
        for batch in batches:
            for node, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, part) != group and held:
                    yield compare(held)
                    held = []
                group = (node, part)
                held.append(row)
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long")


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar enough, as a square of booleans: exact, from counts of shared elements."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # an element of one set alone adds to no intersection
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        at = slice(*np.searchsorted(number, [lo, lo + 4096]))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[at], number[at] - lo] = 1
        both += has @ has.T
    n = np.array([len(x) for x in sets], np.float64)
    return 100 * both.astype(np.float64) >= PERCENT * (n[:, None] + n[None, :] - both)


def _node_links(rows: DataFrame, table: str) -> DataFrame:
    """Links (a, b) between the members of nodes (node, id, k, size): all pairs are compared on their full sets, and of
    the links a spanning forest comes back, at most one per member. A node of more than a block of members (or half of
    SET_ROWS shingles) is dealt in blocks, and each pair of blocks is compared apart."""
    texts = rows.sparkSession.table(table)
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(2 * F.col("size") / SET_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    placed = rows.withColumn("blocks", blocks).select("node", "id", F.explode(pairs).alias("part"))
    dealt = placed.join(texts, "id").select("node", "part", "id", "text").repartition("node", "part").sortWithinPartitions("node", "part", "id")

    def forest(held: list) -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], np.int64)
        near = similar_pairs([h[1] for h in held])
        left, one, two = np.ones(len(ids), bool), [], []
        for start in range(len(ids)):
            if not left[start]:
                continue
            left[start] = False
            todo = [start]
            while todo:
                at = todo.pop()
                found = np.flatnonzero(near[at] & left)
                left[found] = False
                one += [ids[at]] * len(found)
                two += ids[found].tolist()
                todo += found.tolist()
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    def run(batches):
        node, held = None, []
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets(part.column("text").to_pylist())
                for *at, i, own in zip(part.column("node").to_pylist(), part.column("part").to_pylist(), part.column("id").to_pylist(), sets, strict=True):
                    if at != node and held:
                        yield forest(held)
                        held = []
                    node = at
                    held.append((i, own))
        if held:
            yield forest(held)

    return dealt.mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Rows with their members' components."""
    if comp is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of nodes whose members aren't all connected, with their component; found by (node, salt) as in _met()."""
    named = _salted(written(_named(rows, comp), "named-nodes"))
    part = named.groupBy("node", "_salt").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    apart = part.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("_salt").alias("salts")).where("lo <> hi").select("node", F.explode("salts").alias("_salt"))
    return named.join(apart, ["node", "_salt"], "left_semi").drop("_salt")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that stay, one of each group, with all their columns."""
    gone = linked(docs, id_col, text_col).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (
    SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""
