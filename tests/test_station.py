"""Rules of a running station on small tables."""

from pyspark.sql import functions as F

from sightline.operators import station


def test_one_session_at_a_time(spark):
    rows = [("a", 1, "open", 10), ("a", 2, "open", 11), ("a", 3, "close", 11), ("a", 4, "close", 10), ("a", 5, "close", 10), ("a", 6, "open", 12), ("a", 7, "close", None), (None, 1, "close", None), (None, 2, "open", 1)]
    got = station.session_log(spark.createDataFrame(rows, "station string, seq long, action string, session_id long")).orderBy(F.col("station").desc_nulls_last(), "seq").collect()
    assert [r.accepted for r in got] == [True, False, False, True, False, True, True, False, True]
    assert [r.open_id for r in got] == [10, 10, 10, None, None, 12, None, None, 1]


def test_union_keeps_each_camera(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "m")], "x int, more string")
    assert sorted(map(tuple, station.union_of_cameras({"A": a, "B": b}).select("x", "source_id").collect())) == [(1, "A"), (2, "B")]


def test_live_queue_drops_the_oldest(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 10, 29)], "k string, t long")
    got = [(r.t, r.dropped) for r in station.drop_oldest(df, ["k"], "t", 10, 2).orderBy("t").collect()]
    assert got == [(2, 2), (3, 2), (10, 0), (29, 0)]


def test_split_opens(spark):
    rows = [("c", 1, "close"), ("c", 2, "open"), ("c", 5, "open"), ("c", 7, "close"), ("c", 9, "decode"), ("d", 1, "open")]
    got = station.split_opens(spark.createDataFrame(rows, "c string, t long, kind string"), "c", "t").orderBy("c", "part").collect()
    assert [tuple(r) for r in got] == [("c", 1, 2, 2, True), ("c", 2, 5, 7, False), ("d", 1, 1, 1, True)]


def test_usb_ids(spark):
    df = spark.createDataFrame([(r"\\?\usb#vid_2BDF&pid_0280&mi",), ("usb#vid_12",), (None,)], "p string")
    assert [None if r.i is None else tuple(r.i) for r in df.select(station.usb_ids(F.col("p")).alias("i")).collect()] == [(0x2BDF, 0x0280), None, None]


def test_recordings(spark):
    rows = [("s", 1, "P", "qr", 5), ("s", 2, "P", "qr", 6), ("s", 3, None, None, 7), ("s", 4, "Q", "qr", 8), ("t", 1, "Q", "qr", 1)]
    got = station.recordings(spark.createDataFrame(rows, "s string, t long, payload string, symbology string, roi int"), "s", "t", 2).orderBy("s").collect()
    assert [(r.s, r.payloads, r.symbologies, r.decodes, r.roi, r.outcome) for r in got] == [("s", ["P"], ["qr"], 4, 8, "pass"), ("t", [], [], 1, 1, "miss")]


def test_of_equal_last_prices_the_row_stored_first_counts(spark, tmp_path):
    """Ties within a payload and between payloads, over two files: as SQL reads them one after another."""
    import duckdb

    from sightline.plans.catalog import ORACLES, QUERIES

    rows = [(k, p, s, q, price) for k in range(40) for p, s, q, price in [(1, 7, 1.0, 5.0), (2, 3, 1.0, 9.0), (1, 1 + k, 1.0, 9.0), (2, 80 - k, 50.0, 9.0), (2, 5, 1.0, None)]]
    for i, part in enumerate((rows[:97], rows[97:] + [(k, 3, 89, 1.0, 9.0) for k in range(40)])):
        spark.createDataFrame(part, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"{i}").glob("part-*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{i}.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(c.sql(ORACLES["recording_records"] + " ORDER BY ALL").fetchall())
    got = QUERIES["recording_records"](spark, str(tmp_path)).select("l_orderkey", "payloads", "symbologies", "decodes", "last_x", "outcome").collect()
    assert sorted(map(tuple, got)) == want and {r.last_x for r in got} == {3}
