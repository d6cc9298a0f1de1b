"""Streams over several files, restarts in the middle of a batch, and odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from genemill.streaming import monitor as MO

SCHEMA = "event_id long, ts timestamp_ntz, host string, metric string, value double, idempotency_key string"
DAY = dt.datetime(2024, 1, 1)


def rows(n=60):
    kinds = ("cpu", "memory", "disk", "database")
    return [
        (i, DAY + dt.timedelta(hours=i), f"h{i % 7}", kinds[i % 4], float((i * 37) % 101), f"k{i % 11}")
        for i in range(n)
    ]


@pytest.fixture
def feed(spark, tmp_path):
    """Writes lists of rows as the files of a stream, in order."""
    folder = str(tmp_path / "in")

    def put(*files):
        for f in files:
            spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    return put


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_updates_over_many_batches_equal_the_static_result(spark, tmp_path, feed):
    data = rows()
    static = spark.createDataFrame(data, SCHEMA)
    stream = feed(*[data[i : i + 12] for i in range(0, 60, 12)])
    log = MO.drain(MO.health_updates(stream), "h", ["host", "span"], str(tmp_path / "h"), base_every=2)
    assert plain(MO.latest_health(log)) == plain(MO.latest_health(MO.health_updates(static)))
    assert len(MO._children(spark, str(tmp_path / "h/out/base"))) >= 2
    by_hand = {}
    for r in data:
        by_hand[r[2]] = (r[1], r[3], r[4])
    assert {r.host: (r.ts, r.metric, r.value) for r in MO.latest_health(log).collect()} == by_hand


def test_a_restart_in_the_middle_of_a_batch_gives_equal_rows(spark, tmp_path, feed, monkeypatch):
    data = rows()
    events = spark.createDataFrame(data, SCHEMA)
    as_runs = lambda d: d.select(
        "event_id", "ts", F.col("host").alias("run_id"), F.col("value").alias("progress"), F.col("metric").alias("status")
    )
    stream = as_runs(feed(data[:20], data[20:40], data[40:]))
    path = str(tmp_path / "r")
    keep = MO.keep_updates

    def breaks(out, keys, base_every):
        write = keep(out, keys, base_every)

        def once(batch, batch_id):
            write(batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost after the write, before the commit")

        return once

    monkeypatch.setattr(MO, "keep_updates", breaks)
    with pytest.raises(Exception, match="lost after the write"):
        MO.drain(MO.run_updates(stream), "r", ["run_id", "span"], path)
    monkeypatch.setattr(MO, "keep_updates", keep)
    log = MO.drain(MO.run_updates(stream), "r", ["run_id", "span"], path)
    assert plain(MO.run_progress(log)) == plain(MO.run_progress(MO.run_updates(as_runs(events))))
    # nothing new: the same table again
    again = MO.drain(MO.run_updates(stream), "r", ["run_id", "span"], path)
    assert sum(r.n_events for r in MO.run_progress(again).collect()) == len(data)


def test_an_unfinished_batch_is_not_read(spark, tmp_path, feed):
    data = rows(12)
    path = str(tmp_path / "u")
    log = MO.drain(MO.health_updates(feed(data)), "u", ["host", "span"], path)
    want = plain(MO.latest_health(log))
    half = tmp_path / "u/out/log/batch=9"
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"half")
    got = MO.current(spark, f"{path}/out", ["host", "span"], log.schema)
    assert plain(MO.latest_health(got)) == want


def test_spans_apart_are_merged_and_the_state_without_limit_agrees(spark, tmp_path, feed):
    far = [(i, DAY + dt.timedelta(days=40 * i), "h", "cpu", float(i), "k") for i in range(6)]
    runs = lambda d: d.select("event_id", "ts", F.col("host").alias("run_id"), F.col("value").alias("progress"), F.col("metric").alias("status"))
    stream = runs(feed(*[[r] for r in far]))
    a = MO.run_progress(MO.drain(MO.run_updates(stream), "a", ["run_id", "span"], str(tmp_path / "a")))
    b = MO.run_progress(MO.drain(MO.run_updates(stream, ttl=None), "b", ["run_id", "span"], str(tmp_path / "b")))
    assert plain(a) == plain(b) == [("h", 5.0, "cpu", far[-1][1], 6)]


def test_resolved_alerts_leave_the_list_in_whatever_order(spark, tmp_path, feed):
    data = [
        (1, DAY, "a", "cpu", 99.0, "k"), (2, DAY, "a", "memory", 99.0, "k"),
        (3, DAY + dt.timedelta(days=90), "b", "disk", 99.0, "k"), (4, None, "c", "cpu", 99.0, "k"),
        (5, DAY, "c", "cpu", None, "k"),
    ]
    stream = MO.alerts(feed(data[:2], data[2:]))
    done = spark.createDataFrame(
        [(1, "cpu_high", DAY + dt.timedelta(days=120)), (3, "disk_high", DAY), (7, "cpu_high", DAY)],
        "event_id long, alert string, ts timestamp_ntz",
    )
    done.coalesce(1).write.parquet(str(tmp_path / "done"))
    resolved = spark.readStream.schema(done.schema).parquet(str(tmp_path / "done"))
    keys = ["event_id", "alert", "span"]
    log = MO.drain(MO.alert_updates(stream, resolved, ttl=None), "x", keys, str(tmp_path / "x"))
    assert [(r.event_id, r.alert, r.severity) for r in MO.active_alerts(log).collect()] == [(2, "memory_high", "warning")]
    static = MO.alert_updates(MO.alerts(spark.createDataFrame(data, SCHEMA)), done)
    assert [r.event_id for r in MO.active_alerts(static).collect()] == [2]


def test_history_reads_the_days_of_its_window(spark, tmp_path, feed):
    data = rows()
    filed = MO.drain(MO.with_day(feed(data[:30], data[30:])), "d", path=str(tmp_path / "d"), partition="day")
    until = "2024-01-02 12:00:00"
    got = MO.history(filed, until, 24)
    assert [r.event_id for r in got.collect()] == list(range(12, 37))
    assert plain(got) == plain(MO.history(spark.createDataFrame(data, SCHEMA), until, 24))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_deliveries_far_apart_are_one(spark, tmp_path, feed):
    data = [(i, DAY + dt.timedelta(days=61 * i), "h", "cpu", 1.0, "same" if i % 2 else None) for i in range(6)]
    stream = feed(*[[r] for r in data])
    got = MO.drain(MO.deduplicate(stream), "x", path=str(tmp_path / "x"))
    assert plain(got.select("event_id")) == [(0,), (1,)]


def test_no_files_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert MO.latest_health(MO.drain(MO.health_updates(stream), "n", ["host", "span"], str(tmp_path / "n"))).count() == 0
    assert MO.drain(MO.alerts(stream), "m", path=str(tmp_path / "m")).count() == 0
