"""Rules of a running station: sessions, queues, scans, recordings, devices, injected passes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segment import in_spans


def union_of_cameras(streams: dict[str, DataFrame]) -> DataFrame:
    """Events of all cameras as one table, each row with its camera. Streams keep their own watermarks: where each has
    one, the union's is that of the slowest (spark.sql.streaming.multipleWatermarkPolicy=min, the default)."""
    named = [df.withColumn("source_id", F.lit(name)) for name, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def session_log(requests: DataFrame, station: str = "station", order: str = "seq") -> DataFrame:
    """Requests (station, seq, action open/close, session_id) with whether each is accepted, and the session open after it.

    At most one session of a station is open. A close names the one it means, or none for whichever is open; one
    that isn't open is refused, so of two closes of a session only the first counts. Requests stream by station."""
    dealt = requests.select(station, order, "action", "session_id").repartition(station).sortWithinPartitions(station, order)

    def run(batches):
        own, current = object(), None
        for batch in batches:
            accepted, opened = [], []
            for s, _, action, session in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != own:
                    own, current = s, None
                ok = current is None if action == "open" else current is not None and session in (None, current)
                if ok:
                    current = session if action == "open" else None
                accepted.append(ok)
                opened.append(current)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(opened, batch.schema.field("session_id").type)], names=[*batch.schema.names, "accepted", "open_id"])

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + f", accepted boolean, open_id {kinds['session_id']}")


def replaced(uploads: DataFrame, batch: str, key: str, pos: str) -> DataFrame:
    """Of uploads of a list the last, whole: each key at its first place."""
    last = uploads.agg(F.max(batch).alias("_last"))
    return uploads.join(F.broadcast(last), F.col(batch) == F.col("_last")).groupBy(key).agg(F.min(pos).alias(pos))


def first_kept(rows: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """Per key: how many rows a collector of that capacity keeps, how many it leaves out, and where it stops."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = rows.withColumn("_kept", place <= cap)
    return kept.groupBy(*keys).agg(F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("left_out"), F.max(F.when(F.col("_kept"), F.col(order[-1]))).alias("last_kept"))


def drop_oldest(frames: DataFrame, keys: list[str], at: str, tick: int, capacity: int) -> DataFrame:
    """What a live queue hands on that is emptied once a tick: of the frames of a tick the newest `capacity`, each with
    the number that were dropped before it. (A finite source waits instead; nothing is dropped.)"""
    w = Window.partitionBy(*keys, "tick")
    queued = frames.withColumn("tick", F.floor(F.col(at) / tick))
    placed = queued.withColumn("_from_end", F.row_number().over(w.orderBy(F.col(at).desc()))).withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - capacity))
    return placed.where(F.col("_from_end") <= capacity).drop("_from_end")


def idle_scans(frames: DataFrame, found: DataFrame, keys: list[str], at: str, every: int, cell: int) -> DataFrame:
    """Frames that a scan of the whole picture reads while no segment is open: the first outside all segments of each
    period of `every` units."""
    busy = in_spans(frames.select(*keys, at).distinct(), at, found.select(*keys, "first_frame", "last_frame"), keys, "first_frame", "last_frame", cell).select(*keys, at).distinct()
    idle = frames.join(busy, [*keys, at], "left_anti")
    return idle.groupBy(*keys, F.floor(F.col(at) / every).alias("period")).agg(F.min(at).alias(at))


def split_opens(events: DataFrame, key: str, order: str) -> DataFrame:
    """Segments of events (key, order, kind open/close): a second open of a candidate ends the one before it. One
    without a close ends at its last event; closes before any open are no segment."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = events.withColumn("part", F.count_if(F.col("kind") == "open").over(w)).where("part > 0")
    ends = F.min(F.when(F.col("kind") == "close", F.col(order)))
    return parts.groupBy(key, "part").agg(F.min(order).alias("opened"), ends.alias("closed"), F.max(order).alias("_last")).select(
        key, F.col("part").cast("long").alias("part"), "opened", F.coalesce("closed", "_last").alias("ended"), F.col("closed").isNull().alias("cut_short"))


def recordings(decodes: DataFrame, key: str, order: str, confirmations: int, place: str | None = None) -> DataFrame:
    """One record per segment from its decodes (key, order, payload, symbology, roi): outcome, the confirmed payloads and their
    symbologies, how many decodes, the last region. Counts combine by payload first. Of decodes at the last instant that of the
    least `place` gives the region; without it, any."""
    at = F.col(order) if place is None else F.when(F.col(order).isNotNull(), F.struct(order, (-F.col(place)).alias("_place")))
    said = decodes.groupBy(key, "payload").agg(F.count(F.lit(1)).alias("n"), F.min("symbology").alias("symbology"), F.max_by("roi", at).alias("roi"), F.max(at).alias("last"))
    sure = (F.col("n") >= confirmations) & F.col("payload").isNotNull()
    out = said.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(sure, F.col("payload")))).alias("payloads"), F.sort_array(F.collect_set(F.when(sure, F.col("symbology")))).alias("symbologies"),
        F.sum("n").alias("decodes"), F.max_by("roi", "last").alias("roi"))
    return out.withColumn("outcome", F.when(F.size("payloads") > 0, "pass").otherwise("miss"))


def decode_context(attempts: DataFrame, key: str, confirmations: int = 2) -> DataFrame:
    """Per segment of attempts (key, payload or NULL, variant): frames attempted, those that needed a variant, and the confirmed payloads' number."""
    by = attempts.groupBy(key, "payload").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("variant") != "plain").alias("fallback"))
    return by.groupBy(key).agg(
        F.sum("n").alias("frames_attempted"), F.sum("fallback").alias("fallback_runs"), F.count_if((F.col("n") >= confirmations) & F.col("payload").isNotNull()).alias("confirmed"))


def attempt_due(n_attempts: Column, confirmed: Column, symbology: Column) -> Column:
    """Whether a frame is tried for a symbology: Data Matrix, once its segment is confirmed, only on every fifth."""
    return ~((symbology == "datamatrix") & confirmed) | (n_attempts % 5 == 0)


def variants_due(n_attempts: Column, confirmed: Column) -> Column:
    """Whether preprocessing variants are tried: after four plain attempts without a confirmed payload."""
    return (n_attempts >= 4) & ~confirmed


def usb_ids(path: Column) -> Column:
    """Vendor and product number in a device path, NULL without both."""
    ids = [F.regexp_extract(F.lower(path), f"{k}_([0-9a-f]{{4}})", 1) for k in ("vid", "pid")]
    whole = (ids[0] != "") & (ids[1] != "")
    return F.when(whole, F.struct(*[F.conv(i, 16, 10).cast("int").alias(n) for i, n in zip(ids, ("vid", "pid"), strict=True)]))


def probe_lines(modes: DataFrame, chosen: Column) -> DataFrame:
    """A line per capture mode, the chosen one marked: (device, mode, line)."""
    mark = F.when(chosen, F.lit("*")).otherwise(F.lit(" "))
    return modes.select("device", "mode", F.format_string("%s %4dx%-4d %-4s asked %5.1f got %5.1f fps", mark, "width", "height", "fourcc", "requested_fps", "achieved_fps").alias("line"))


def in_frame(box: list[Column], origin: list[Column], scale: Column) -> list[Column]:
    """A box found in a scaled crop, in the whole frame."""
    return [F.floor(box[0] / scale) + origin[0], F.floor(box[1] / scale) + origin[1], F.ceil(box[2] / scale), F.ceil(box[3] / scale)]


def motion_box(box: Column, fraction: Column, noise: float, most: float) -> Column:
    """A frame's motion box, none where motion is noise or fills the frame (a change of light)."""
    return F.when((fraction >= noise) & (fraction <= most), box)


def workload(pitches: list[float], blurs: list[float], symbologies: list[str], spark) -> DataFrame:
    """The decoder bench's grid, a numbered row per case; constants only."""
    rows = [(i * len(blurs) * len(symbologies) + j * len(symbologies) + k, p, b, s) for i, p in enumerate(pitches) for j, b in enumerate(blurs) for k, s in enumerate(symbologies)]
    return spark.createDataFrame(rows, "case_id long, pitch double, blur double, symbology string")


def workloads(pitches: DataFrame, blurs: DataFrame, key: str, symbologies: list[str]) -> DataFrame:
    """workload() for each bench: its distinct pitches (key, pitch) by its blurs (key, blur) by symbologies, in this order."""
    cases = pitches.distinct().join(blurs.distinct(), key).select(key, "pitch", "blur", F.posexplode(F.array(*map(F.lit, symbologies))).alias("_at", "symbology"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pitch", "blur", "_at")).cast("long") - 1
    return cases.select(key, place.alias("case_id"), "pitch", "blur", "symbology")


def same_results(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two runs of a workload has, and how often."""
    columns = one.columns
    both = one.withColumn("_n", F.lit(1)).unionByName(other.select(*columns).withColumn("_n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def injected(plans: DataFrame, frames: DataFrame, keys: list[str], at: str, per_tick: int, cell: int) -> DataFrame:
    """Truth of passes (keys, pass_id, start, end) laid over a feed: frames they show in, first and last as ticks of the
    nominal clock (`per_tick` units each, half to even), and whether a gap of the feed cut one short."""
    shown = in_spans(frames, at, plans, keys, "start", "end", cell)
    tick = lambda c: F.bround(c / per_tick, 0).cast("long")
    seen = shown.groupBy(*keys, "pass_id").agg(F.count(F.lit(1)).alias("frames"), tick(F.min(at)).alias("first_tick"), tick(F.max(at)).alias("last_tick"), F.max("discontinuity").alias("truncated"))
    return seen


def overdue(found: DataFrame, decodes: DataFrame, keys: list[str], at: str, post: int, confirmations: int, cell: int) -> DataFrame:
    """Misses among closed segments (keys, seq, start, end): those without a payload confirmed by decodes (keys, at, payload) from
    the start to `post` after the end, with the instant at which that is settled, in which order they are reported."""
    spans = found.select(*keys, "seq", "start", "end", (F.col("end") + post).alias("_due"))
    said = in_spans(decodes.select(*keys, at, "payload"), at, spans, keys, "start", "_due", cell).groupBy(*keys, "seq", "payload").agg(F.count(F.lit(1)).alias("n"))
    sure = said.where((F.col("n") >= confirmations) & F.col("payload").isNotNull()).select(*keys, "seq").distinct()
    return spans.join(sure, [*keys, "seq"], "left_anti").select(*keys, "seq", F.col("_due").alias("settled"))
