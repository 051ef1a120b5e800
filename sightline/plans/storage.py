"""Queries over the event store: views, lists, reviews, outbox, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, store
from ..functions import expressions as ex
from ..sources import files
from ..sources import testdata as td
from .registry import query


def _log(spark, sf_dir):
    return td.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), (F.col("o_orderkey") % 5).alias("revision"), F.col("o_orderkey").alias("ingest_seq"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))


VIEW = "view AS (SELECT o_custkey AS event_id, max(o_orderkey % 5) AS revision, arg_max(o_orderkey, (o_orderkey % 5) * 100000000 + o_orderkey) AS ingest_seq, arg_max(o_totalprice, (o_orderkey % 5) * 100000000 + o_orderkey) AS total, arg_max(o_orderstatus, (o_orderkey % 5) * 100000000 + o_orderkey) AS status, min(o_orderkey) AS first_arrival FROM orders GROUP BY 1)"


@query(f"WITH {VIEW} SELECT * FROM view", views=False)
def current_view(spark, sf_dir):
    """Highest revision per event, of equals the last; listed by first arrival."""
    return store.current_view(_log(spark, sf_dir), "event_id", "revision", "ingest_seq")


@query(f"WITH {VIEW} SELECT * FROM view WHERE status = 'O' ORDER BY first_arrival DESC LIMIT 500", views=False)
def recent_events(spark, sf_dir):
    """Newest events of one kind; the limit is the page size, clamped."""
    return store.newest_first(store.current_view(_log(spark, sf_dir), "event_id", "revision", "ingest_seq").where("status = 'O'"), "first_arrival", 9999)


REVIEWS = "log AS (SELECT event_id, event_id % 2 AS reviewed, 'note ' || (event_id % 3) AS note, event_id AS seq FROM misses WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 1, 'again', event_id + 1000000000 FROM misses WHERE event_id % 12 = 0), reviews AS (SELECT event_id, arg_max(reviewed, seq) AS reviewed, arg_max(note, seq) AS note FROM log GROUP BY 1)"


def _reviews(spark, sf_dir):
    m = td.misses(spark, sf_dir).select("event_id")
    e = F.col("event_id")
    first = m.where("event_id % 3 = 0").select("event_id", (e % 2).alias("reviewed"), F.concat(F.lit("note "), (e % 3).cast("string")).alias("note"), e.alias("seq"))
    again = m.where("event_id % 12 = 0").select("event_id", F.lit(1).cast("long").alias("reviewed"), F.lit("again").alias("note"), (e + 1_000_000_000).alias("seq"))
    return store.last_wins(first.unionByName(again), "event_id", "seq").drop("seq")


@query(f"--cte {REVIEWS} SELECT event_id, source_id, start, coalesce(reviewed, 0) AS reviewed, note FROM misses LEFT JOIN reviews USING (event_id)")
def misses_with_review(spark, sf_dir):
    """Misses with their last review."""
    return store.with_reviews(td.misses(spark, sf_dir).select("event_id", "source_id", "start"), _reviews(spark, sf_dir))


@query(f"--cte {REVIEWS} SELECT event_id, source_id, start, coalesce(reviewed, 0) AS reviewed, note FROM misses LEFT JOIN reviews USING (event_id) WHERE reviewed IS NULL OR reviewed = 0 ORDER BY event_id DESC LIMIT 50")
def open_misses(spark, sf_dir):
    """Newest misses that nobody has reviewed; a page of them."""
    return store.newest_first(store.with_reviews(td.misses(spark, sf_dir).select("event_id", "source_id", "start"), _reviews(spark, sf_dir), only_open=True), "event_id", 50)


@query("""--cte u AS (SELECT event_id, 'pass' AS kind, payload, printf('%s-%06d', source_id, event_id) AS candidate_id, source_id, first_seen_us / 1000000.0 AS a, ts_us / 1000000.0 AS b, decode_count, event_id % 4 AS revision FROM sightings
UNION ALL SELECT event_id, 'miss', NULL, 'miss-' || event_id, source_id, start / 1000000.0, stop / 1000000.0, 0, 0 FROM misses)
SELECT event_id, kind, payload, candidate_id, source_id, round(a, 6) AS first_seen_ts, round(b, 6) AS last_seen_ts, decode_count, revision FROM u""")
def event_rows(spark, sf_dir):
    """Both kinds of event in the store's columns."""
    s = td.sightings(spark, sf_dir).select(
        "event_id", F.lit("pass").alias("kind"), "payload", F.lit(None).cast("string").alias("candidate_id"), F.array(F.format_string("%s-%06d", "source_id", "event_id")).alias("candidate_ids"),
        F.create_map("source_id", "decode_count").alias("cameras"), F.lit(None).cast("string").alias("source_id"), (F.col("first_seen_us") / 1e6).alias("first_seen_ts"), (F.col("ts_us") / 1e6).alias("last_seen_ts"), "decode_count", (F.col("event_id") % 4).alias("revision"))
    m = td.misses(spark, sf_dir).select("event_id", F.lit("miss").alias("kind"), F.concat(F.lit("miss-"), F.col("event_id").cast("string")).alias("candidate_id"), "source_id", (F.col("start") / 1e6).alias("start_ts"), (F.col("end") / 1e6).alias("end_ts"))
    rows = store.event_rows(s.unionByName(m, allowMissingColumns=True))
    return rows.withColumn("first_seen_ts", F.round("first_seen_ts", 6)).withColumn("last_seen_ts", F.round("last_seen_ts", 6))


@query("""--cte b AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE payload END AS payload, decode_count, source_id FROM sightings)
SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE payload END AS payload, CASE WHEN seq % 9 = 0 THEN NULL ELSE decode_count::INT END AS decode_count, 1 AS counted FROM b""")
def corrupt_detail(spark, sf_dir):
    """Stored details as JSON, some cut short: those rows count, without a payload."""
    s = td.sightings(spark, sf_dir)
    body = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("payload")).alias("payload"), "decode_count", F.create_map("source_id", "decode_count").alias("cameras")))
    rows = s.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, F.substring(body, 1, 11)).otherwise(body).alias("detail_json"))
    return files.read_detail(rows).select("seq", F.col("detail.payload").alias("payload"), F.col("detail.decode_count").alias("decode_count"), F.lit(1).alias("counted"))


OUT = "outbox AS (SELECT event_id AS seq, props AS body, epoch_us(ts) / 1000000.0 AS enqueued_utc FROM events)"


def _outbox(spark, sf_dir):
    return td.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("body"), (td.micros("ts") / 1e6).alias("enqueued_utc"))


@query(f"""WITH {OUT}, y AS (SELECT *, seq IS NOT DISTINCT FROM 500 AS fly FROM outbox WHERE enqueued_utc >= 1706659200 - 25 * 86400.0 OR seq IS NOT DISTINCT FROM 500),
t AS (SELECT *, sum(length(body)) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + coalesce(sum(CASE WHEN fly THEN length(body) ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM y)
SELECT seq, length(body) AS bytes FROM t WHERE total <= 20000 OR fly""", views=False)
def outbox_prune(spark, sf_dir):
    """What stays in the outbox: by age, then by size from the newest; the row in flight stays."""
    kept = store.prune_outbox(_outbox(spark, sf_dir), 1_706_659_200.0, 25.0, 20_000, in_flight=500)
    return kept.select("seq", F.length("body").cast("long").alias("bytes"))


@query(f"WITH {OUT} SELECT count(*) AS depth, coalesce(sum(length(body)), 0)::BIGINT AS bytes, min(seq) AS oldest_seq, round(1706659200 - min(enqueued_utc), 6) AS oldest_age_s FROM outbox", views=False)
def outbox_stats(spark, sf_dir):
    return store.outbox_stats(_outbox(spark, sf_dir), 1_706_659_200.0).withColumn("oldest_age_s", F.round("oldest_age_s", 6))


@query("--cte s AS (SELECT DISTINCT CASE WHEN event_id % 10 = 3 THEN -event_id ELSE event_id END AS event_id FROM sightings), e AS (SELECT DISTINCT CASE WHEN event_id % 10 = 7 THEN -event_id ELSE event_id END AS event_id FROM sightings) SELECT (SELECT count(*) FROM s) AS n_sent, (SELECT count(*) FROM e) AS n_emitted, (SELECT count(*) FROM e ANTI JOIN s USING (event_id)) AS missing, (SELECT count(*) FROM s ANTI JOIN e USING (event_id)) AS unexpected")
def outbox_check(spark, sf_dir):
    """Whether exactly what was emitted has been delivered."""
    ids = td.sightings(spark, sf_dir).select("event_id")
    other = lambda digit: ids.select(F.when(F.col("event_id") % 10 == digit, -F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"))
    return store.delivered(other(3), other(7))


DIRS = "dirs AS (SELECT payload || '/' || (event_id % 50) AS dir, max(ts_us) / 1000000.0 AS mtime, sum(floor(value))::BIGINT AS size FROM timed GROUP BY 1)"


def _dirs(spark, sf_dir):
    t = td.timed(spark, sf_dir)
    return t.groupBy(F.concat_ws("/", "payload", (F.col("event_id") % 50).cast("string")).alias("dir")).agg((F.max("ts_us") / 1e6).alias("mtime"), F.sum(F.floor("value")).cast("long").alias("size"))


@query(f"--cte {DIRS}, y AS (SELECT * FROM dirs WHERE 1706659200 - mtime <= 20 * 86400.0), t AS (SELECT *, sum(size) OVER (ORDER BY mtime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total FROM y) SELECT dir, size FROM t WHERE total <= 30000")
def evidence_prune(spark, sf_dir):
    """Evidence directories that stay: by age, then by total size."""
    return store.prune_evidence(_dirs(spark, sf_dir), 1_706_659_200.0, 20.0, 30_000).select("dir", "size")


@query(f"--cte {DIRS} SELECT split_part(dir, '/', 1) AS payload, count(*) AS dirs, sum(size)::BIGINT AS bytes, round(min(mtime), 6) AS oldest FROM dirs GROUP BY 1")
def evidence_size(spark, sf_dir):
    """Evidence listing: directories, bytes and the oldest, per payload."""
    d = _dirs(spark, sf_dir)
    return d.groupBy(F.split_part("dir", F.lit("/"), F.lit(1)).alias("payload")).agg(F.count(F.lit(1)).alias("dirs"), F.sum("size").alias("bytes"), F.round(F.min("mtime"), 6).alias("oldest"))


@query("--cte SELECT payload, pos FROM manifest".replace("--cte", ""))
def manifest_parse(spark, sf_dir):
    """A manifest file's payloads in order."""
    return files.manifest_cells(td.manifest_lines(spark, sf_dir))


@query("SELECT count(*) AS n FROM manifest")
def manifest_count(spark, sf_dir):
    return files.manifest_cells(td.manifest_lines(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.payload, p.pos FROM (SELECT payload, pos FROM manifest WHERE pos < 0) p UNION ALL SELECT payload, pos FROM manifest WHERE NOT EXISTS (SELECT 1 FROM manifest WHERE pos < 0)")
def manifest_source(spark, sf_dir):
    """The stored manifest if there is one, else the configured one."""
    rows = files.manifest_cells(td.manifest_lines(spark, sf_dir))
    return files.first_given(rows.where("pos < 0"), rows)


@query("SELECT event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE event_id % 10 END IS DISTINCT FROM CASE WHEN event_id % 50 = 0 THEN NULL ELSE 3 END AS other FROM timed")
def null_safe_difference(spark, sf_dir):
    """Inequality that treats NULL as a value."""
    e = F.col("event_id")
    a, b = F.when(e % 100 != 0, e % 10), F.when(e % 50 != 0, F.lit(3))
    return td.timed(spark, sf_dir).select("event_id", (~a.eqNullSafe(b)).alias("other"))


@query("--cte d AS (SELECT payload, source_id, sum(decode_count) FILTER (event_id % 2 = 0) AS a, sum(decode_count) FILTER (event_id % 2 = 1) AS b FROM sightings GROUP BY 1, 2) SELECT payload, source_id, (coalesce(a, 0) + coalesce(b, 0))::BIGINT AS decode_count FROM d")
def camera_counts(spark, sf_dir):
    """Two maps of counts per payload, merged by adding."""
    s = td.sightings(spark, sf_dir)

    def counts(odd: int, name: str):
        per = s.where(F.col("event_id") % 2 == odd).groupBy("payload", "source_id").agg(F.sum("decode_count").alias("n"))
        return per.groupBy("payload").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "n"))).alias(name))  # one entry per camera

    empty = F.create_map().cast("map<string,bigint>")
    both = counts(0, "a").join(counts(1, "b"), "payload", "full_outer")
    merged = ex.merged_counts(F.coalesce("a", empty), F.coalesce("b", empty))
    return both.select("payload", F.explode(merged).alias("source_id", "decode_count"))


@query("SELECT event_id, epoch_us(make_timestamp(1704067200000000 + ts_us - 1704067200000000)) AS wall_us FROM timed")
def source_to_wall(spark, sf_dir):
    """Source-clock instants on the wall clock."""
    at = (F.col("ts_us") - td.START) / F.lit(1e6)
    return td.timed(spark, sf_dir).select("event_id", F.unix_micros(F.timestamp_micros(F.lit(td.START) + F.bround(at * 1_000_000).cast("long"))).alias("wall_us"))


@query("--cte c AS (SELECT id, started, expected, (SELECT count(*) FROM sightings WHERE ts_us BETWEEN started AND ended) AS live, CASE WHEN id % 2 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN id % 2 = 0 THEN '{\"decoded\":' || (id * 10) || '}' END AS summary FROM sessions) SELECT id, status, CASE WHEN status = 'closed' THEN id * 10 ELSE live END AS decoded FROM c ORDER BY id DESC LIMIT 20")
def session_rows(spark, sf_dir):
    """Newest sessions: closed ones with their stored summary, open ones counted now."""
    s = td.sessions(spark, sf_dir)
    events = td.sightings(spark, sf_dir).select(F.lit("pass").alias("kind"), F.col("ts_us").alias("at"))
    live = reports.session_counts(s, events, td.DAY).select("id", F.col("decoded").alias("live"))
    closed = F.col("id") % 2 == 0
    stored = s.select("id", F.when(closed, "closed").otherwise("open").alias("status"), F.when(closed, F.to_json(F.struct((F.col("id") * 10).alias("decoded")))).alias("summary"))
    done = F.from_json("summary", "decoded bigint").decoded
    return store.newest_first(stored.join(live, "id").select("id", "status", F.when(F.col("status") == "closed", done).otherwise(F.col("live")).alias("decoded")), "id", 20)


@query("SELECT id, status FROM (SELECT id, CASE WHEN id < 29 THEN 'closed' ELSE 'open' END AS status FROM sessions) WHERE status = 'open' LIMIT 1")
def current_session(spark, sf_dir):
    """The one open session."""
    return td.sessions(spark, sf_dir).select("id", F.when(F.col("id") < 29, "closed").otherwise("open").alias("status")).where("status = 'open'").limit(1)
