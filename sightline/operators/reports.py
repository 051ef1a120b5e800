"""Per-camera comparison, sessions, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import in_window
from ..functions.stats import nearest_rank, ratio


def camera_entries(passes: DataFrame) -> DataFrame:
    """One row per pass and camera: source_id, decode_count, ttfd. Rows without camera_detail fall back to
    the cameras map and have no time to first decode; an empty map counts as none."""
    whole = F.col("camera_detail").isNotNull() & (F.size("camera_detail") > 0)
    new = passes.where(whole).select(F.explode("camera_detail").alias("source_id", "e"))
    ttfd = F.when(F.col("e.first_seen_ts").isNotNull() & F.col("e.first_decode_ts").isNotNull(), F.greatest(F.lit(0.0), F.col("e.first_decode_ts") - F.col("e.first_seen_ts")))
    new = new.select("source_id", F.coalesce(F.col("e.decode_count"), F.lit(0)).cast("long").alias("decode_count"), ttfd.alias("ttfd"))
    old = passes.where(~whole).select(F.explode("cameras").alias("source_id", "n")).select("source_id", F.col("n").cast("long").alias("decode_count"), F.lit(None).cast("double").alias("ttfd"))
    return new.unionByName(old)


def ab_report(entries: DataFrame, misses: DataFrame) -> DataFrame:
    """Per camera: seen (its own misses included), decoded, rates, times to first decode by nearest rank.

    entries: (source_id, decode_count, ttfd); misses: (source_id), those without a camera left out."""
    seen = entries.select("source_id", "decode_count", F.lit(1).alias("decoded"), F.lit(0).alias("miss"))
    lost = misses.where(F.col("source_id").isNotNull()).select("source_id", F.lit(0).cast("long").alias("decode_count"), F.lit(0).alias("decoded"), F.lit(1).alias("miss"))
    sums = seen.unionByName(lost).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("passes_seen"), F.sum("decoded").alias("passes_decoded"), F.sum("decode_count").alias("decode_count"), F.sum("miss").alias("misses"))
    times = nearest_rank(entries, ["source_id"], "ttfd", {"ttfd_median_s": 0.5, "ttfd_p95_s": 0.95}).drop("n")
    return sums.join(times, "source_id", "left").select(
        "source_id", "passes_seen", "passes_decoded", "decode_count", "misses",
        ratio(F.col("passes_decoded"), F.col("passes_seen")).alias("read_rate"), ratio(F.col("decode_count"), F.col("passes_decoded")).alias("decodes_per_pass"), "ttfd_median_s", "ttfd_p95_s")


def windowed(rows: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    return rows.where(in_window(F.col(at), start, end))


def session_counts(sessions: DataFrame, events: DataFrame, cell_us: int) -> DataFrame:
    """Per session (id, started, ended, expected): decoded, missed, shortfall.

    Sessions are time boxes, both ends inclusive; events (kind, at) meet them by time cell. Events without a
    stamp are in every session: they are counted once and added."""
    spread = sessions.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("started") / cell_us), F.floor(F.col("ended") / cell_us))))
    timed = events.where(F.col("at").isNotNull()).withColumn("_cell", F.floor(F.col("at") / cell_us)).groupBy("_cell", "at", "kind").agg(F.count(F.lit(1)).alias("n"))
    hit = spread.join(timed, "_cell").where((F.col("at") >= F.col("started")) & (F.col("at") <= F.col("ended")))
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counts = hit.groupBy("id").agg(n("pass").alias("_p"), n("miss").alias("_m"))
    untimed = events.where(F.col("at").isNull()).agg(F.count_if(F.col("kind") == "pass").alias("_up"), F.count_if(F.col("kind") == "miss").alias("_um"))
    out = sessions.join(counts, "id", "left").join(F.broadcast(untimed))
    decoded, missed = (F.coalesce(a, F.lit(0)) + F.col(b) for a, b in (("_p", "_up"), ("_m", "_um")))
    return out.select("id", "expected", decoded.alias("decoded"), missed.alias("missed"), (F.col("expected") - decoded - missed).alias("shortfall"))


def may_close(counts: DataFrame, notes: DataFrame) -> DataFrame:
    """Whether each session may close: without a shortfall, or with a note that isn't blank."""
    return counts.join(notes, "id", "left").select("id", "shortfall", ((F.col("shortfall") == 0) | (F.length(F.trim(F.coalesce("note", F.lit("")))) > 0)).alias("may_close"))


def best_camera(report: DataFrame) -> DataFrame:
    """The camera with the highest read rate, NULL as 0, the first name of equals."""
    return report.agg(F.min_by("source_id", F.struct((-F.coalesce("read_rate", F.lit(0.0))).alias("r"), F.col("source_id"))).alias("source_id"), F.max(F.coalesce("read_rate", F.lit(0.0))).alias("read_rate"))


# Exports are tables of lines (section, place, line), made by column expressions, so an export may be as long as its
# input; whole() joins the lines of a short one.

# Fields of the comparison, their labels, and the digits that the CSV shows of them.
MEASURES = [("passes_seen", "passes seen", None), ("passes_decoded", "passes decoded", None), ("read_rate", "read rate", 6), ("ttfd_median_s", "ttfd median (s)", 6), ("ttfd_p95_s", "ttfd p95 (s)", 6), ("decodes_per_pass", "decodes per pass", 4), ("misses", "misses", None)]
# Buckets of a reconciliation in the order of its export, and a session's fields.
STATUSES = ["matched", "missing", "unexpected"]
SESSION = ["id", "status", "started_utc", "closed_utc", "expected_count", "ack_note", "decoded", "missed", "shortfall"]
CSV = {"emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def _digits(value: Column, digits: int | None, scale: int = 1, unit: str = "") -> Column:
    """A number as text, NULL if it is."""
    return F.concat(value.cast("string") if digits is None else F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double") * scale)), F.lit(unit))


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, i, line) for i, line in enumerate(lines)], "section int, place long, line string")


def _records(rows: DataFrame, section: int, order: list, **fields: Column) -> DataFrame:
    """CSV lines of rows in an order, under a line of the fields' names."""
    place = F.row_number().over(Window.orderBy(*order)).cast("long")  # an export has one order; its rows are short
    body = rows.select(F.lit(section).alias("section"), place.alias("place"), F.to_csv(F.struct(*[c.alias(n) for n, c in fields.items()]), CSV).alias("line"))
    return _fixed(rows.sparkSession, section, ",".join(fields)).unionByName(body)


def whole(lines: DataFrame, end: str = "\n") -> str:
    """The text of a short export."""
    row = lines.agg(F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("all")).select(F.array_join("all.line", end).alias("text")).first()
    return row.text + end


def ab_markdown(report: DataFrame, passes: int, misses: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines of a Markdown page: a table with a column a camera, and the camera that reads best."""
    spark, none = report.sparkSession, F.lit("—")
    head = _fixed(spark, 0, "# A/B trial report", "", f"Window: {start or 'start'} → {end or 'now'}", f"Business passes (deduped): {passes}  ·  misses: {misses}", "")
    named = F.array(F.struct(F.lit("metric").alias("label"), F.col("source_id").alias("cell")), F.struct(F.lit("---").alias("label"), F.lit("---").alias("cell")), *[
        F.struct(F.lit(label).alias("label"), F.coalesce(_digits(F.col(c), 1, 100, "%") if c == "read_rate" else _digits(F.col(c), digits and 3), none).alias("cell")) for c, label, digits in MEASURES])
    cells = report.select("source_id", F.posexplode(named).alias("place", "entry")).groupBy("place", "entry.label").agg(F.array_sort(F.collect_list(F.struct("source_id", "entry.cell"))).alias("row"))
    table = cells.select(F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), F.concat(F.lit("| "), F.array_join(F.concat(F.array("label"), F.col("row.cell")), " | "), F.lit(" |")).alias("line"))
    said = F.when(F.col("source_id").isNull(), "_No pass data in the window._").otherwise(
        F.format_string("\nBest reader: **%s** (%s).\n\nA first decode is timed on the clock of its own camera, so cameras whose clocks differ compare fairly.", F.col("source_id"), F.coalesce(_digits(F.col("read_rate"), 1, 100, "%"), none)))
    return head.unionByName(table).unionByName(best_camera(report).select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("place"), said.alias("line")))


def ab_csv(report: DataFrame) -> DataFrame:
    return _records(report, 0, ["source_id"], camera=F.col("source_id"), **{c: _digits(F.col(c), digits) for c, _, digits in MEASURES})


def reconciliation_csv(status: DataFrame, section: int = 0) -> DataFrame:
    """The manifest's payloads and others seen, by bucket, each in its own order."""
    return _records(status, section, [F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), "pos"], payload=F.col("payload"), status=F.col("status"))


def session_csv(session: DataFrame, cameras: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """A session's (one row's) fields, its cameras if any, and the manifest's buckets if there is one; blank lines between."""
    fields = F.posexplode(F.array(*[F.struct(F.lit(n).alias("field"), (F.col(n).cast("string") if n in session.columns else F.lit(None).cast("string")).alias("value")) for n in SESSION])).alias("at", "entry")
    lines = _records(session.select(fields).select("at", "entry.*"), 0, ["at"], field=F.col("field"), value=F.col("value"))
    parts = [(1, _records(cameras, 1, ["source_id"], camera=F.col("source_id"), **{c: F.col(c) for c in ("passes_seen", "passes_decoded", "misses")}))]
    if status is not None:
        parts.append((2, reconciliation_csv(status, 2)))
    for section, part in parts:  # only sections with rows
        some = part.where("place > 0").limit(1).select(F.lit(True).alias("some"))
        blank = _fixed(session.sparkSession, section, "").withColumn("place", F.lit(-1).cast("long"))
        lines = lines.unionByName(blank.unionByName(part).join(F.broadcast(some)).drop("some"))
    return lines


def tenths(part: Column, all_: Column) -> Column:
    """A percentage with one digit, half up, as text; a dash of nothing."""
    t = F.floor((part * 2000 + all_) / F.nullif(2 * all_, F.lit(0))).cast("long")
    return F.coalesce(F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%")), F.lit("—"))


def run_text(counts: DataFrame, outcome: DataFrame) -> DataFrame:
    """The end of a run as lines (section, place, line): its counters (one row: frames, dropped, passes, merged, misses), what became of
    the truth (pass_id, payload, outcome), and each pass that nothing accounts for, a line each, in their order."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    told = outcome.agg(F.count(F.lit(1)).alias("n"), n("decoded").alias("decoded"), n("missed").alias("missed"), n("unaccounted").alias("unaccounted"))
    rate = F.when(F.col("n") == 0, "100.0%").otherwise(tenths(F.col("decoded"), F.col("n")))
    lines = F.array(
        F.lit("run summary"), F.format_string("frames %d, dropped %d", "frames", "dropped"), F.format_string("passes %d, merged into others %d", "passes", "merged"), F.format_string("misses %d", "misses"),
        F.concat(F.format_string("truth %d: decoded %d (", "n", "decoded"), rate, F.format_string("), missed %d, unaccounted %d", "missed", "unaccounted")))
    head = counts.join(F.broadcast(told)).select(F.lit(0).alias("section"), F.posexplode(lines).alias("place", "line"))  # one row with one row
    left = outcome.where("outcome = 'unaccounted'").select(F.lit(1).alias("section"), F.col("pass_id").alias("place"), F.format_string("unaccounted: pass %d, %s", "pass_id", "payload").alias("line"))
    return head.withColumn("place", F.col("place").cast("long")).unionByName(left)


def variant_text(results: DataFrame) -> DataFrame:
    """A replay report as lines (variant, section, line), from results (variant, candidate_id, outcome, truth, decoded, decoder): a row of the table,
    which decoders read how much, misses that it reads, and passes that it loses."""
    read = F.col("decoded").isNotNull()
    lost = (F.col("outcome") == "pass") & ~F.coalesce(F.array_contains("truth", F.col("decoded")), F.lit(False))
    found = (F.col("outcome") == "miss") & read
    sums = results.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(read).alias("r"), F.count_if(found).alias("f"), F.count_if(lost).alias("l"))
    row = F.concat(F.format_string("| %s | %d/%d | ", "variant", "r", "n"), tenths(F.col("r"), F.col("n")), F.format_string(" | %d | %d |", "f", "l"))
    by = results.where(F.col("decoder").isNotNull()).groupBy("variant", "decoder").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "decoder"))).alias("all"))  # a variant has few decoders
    said = F.array_join(F.transform("all", lambda d: F.concat(d.decoder, F.lit("="), (-d.less).cast("string"))), ", ")
    line = lambda section, rows, text: rows.select("variant", F.lit(section).alias("section"), text.alias("line"))
    none = F.coalesce("decoded", F.lit("nothing"))
    return (
        line(0, sums, row).unionByName(line(1, by, F.concat(F.lit("read by "), said)))
        .unionByName(line(2, results.where(found), F.concat_ws(" ", F.lit("reads the miss"), F.col("candidate_id"), F.lit("as"), F.col("decoded"), F.lit("by"), F.col("decoder"))))
        .unionByName(line(3, results.where(lost), F.concat_ws(" ", F.lit("loses the pass"), F.col("candidate_id"), F.lit("of"), F.array_join("truth", "/"), F.lit("to"), none))))
