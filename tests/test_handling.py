"""Streams with state, timers and a ledger against tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuelake.plans import queries_scale
from cuelake.streaming import events as ev
from cuelake.streaming import handling

SF = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def arrivals(spark, rows, schema, path, parts, seed=1):
    """``rows`` in files that come in any order, and a late one of other keys that moves the watermark on."""
    random.Random(seed).shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_histories_in_event_order(rocks, tmp_path):
    spark = rocks
    table = queries_scale.item_events(spark, SF).where("item_id < 12")
    rows = [tuple(r) for r in table.collect()]
    end = max(r[-1] for r in rows) + dt.timedelta(days=80)
    pilot = [(-1, -1, int(end.timestamp() * 1e6) + k, "Grab", None, None, None, end + dt.timedelta(microseconds=k)) for k in range(2)]
    schema = table.schema
    path = f"{tmp_path}/in"
    stream = arrivals(spark, rows, schema, path, 4)
    for p in pilot:
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(path)
    out = handling.item_history_stream(stream, "40 days")
    q = out.writeStream.format("memory").queryName("histories").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    said = spark.table("histories").collect()
    last = {}
    for r in said:
        if r.item_id not in last or r.n_events > last[r.item_id].n_events:
            last[r.item_id] = r
    want = {r.item_id: r for r in handling.item_history(table).collect()}
    assert {k: tuple(v) for k, v in last.items() if k >= 0} == {k: tuple(v) for k, v in want.items()}
    assert any(r.cancelled for r in want.values()) and any(r.live_run for r in want.values()) and any(r.backups_orphaned for r in want.values())


def test_silent_runs_are_told_once(rocks, tmp_path):
    spark = rocks
    base = dt.datetime(1970, 1, 1)
    rng = random.Random(4)
    rows = []
    for run in range(6):
        at = rng.randrange(100)
        for _ in range(rng.randrange(1, 12)):
            rows.append((f"r{run}", at * 1_000_000, base + dt.timedelta(seconds=at)))
            at += rng.choice([5, 30, 90])
    rows.sort(key=lambda r: r[1])
    now = max(r[1] for r in rows) // 1_000_000 + 60
    rows += [("pilot", (now + k) * 1_000_000, base + dt.timedelta(seconds=now + k)) for k in range(2)]
    path, schema = f"{tmp_path}/in", "run_id string, at_us long, ts timestamp"
    for k, r in enumerate([rows[:20], rows[20:-2], rows[-2:-1], rows[-1:]]):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = handling.silent_runs(stream, 120, "0 seconds").writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.run_id, r.last_us) for r in spark.table("silent").collect()]
    want = {tuple(r) for r in ev.stale_heartbeats(spark.createDataFrame(rows, schema), (now + 1) * 1_000_000, 120).collect()}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_killed_streams_give_the_same_tables(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    kinds = ["Download", "Rename", "SeriesAdd", "Grab", "Odd", None]
    rows = [(i, rng.choice([1, 2, None]), rng.choice([1, 2]), rng.choice(kinds), rng.randrange(400) * 1_000_000) for i in range(160)]
    schema = "event_id long, item_id long, title_id long, event_type string, at_us long"
    titles = spark.createDataFrame([(1,)], "title_id long")
    path = f"{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    handling.handle_events(stream, titles, f"file://{tmp_path}/whole", f"{tmp_path}/cp1").awaitTermination()
    real, calls = handling.route_events, []

    def dies(*args):
        calls.append(1)
        if len(calls) in (2, 4):
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(handling, "route_events", dies)
    for _ in range(3):
        q = handling.handle_events(stream, titles, f"file://{tmp_path}/killed", f"{tmp_path}/cp2")
        try:
            q.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)
    rows_of = lambda name: sorted(map(tuple, handling.handled_events(spark, f"file://{tmp_path}/{name}").drop("batch").collect()), key=repr)
    assert len(calls) == 6 and rows_of("killed") == rows_of("whole") and len(rows_of("whole")) == 160
    whole = handling.handled_events(spark, f"file://{tmp_path}/whole")
    last, kept = {}, set()
    order = {r.event_id: r.batch for r in whole.collect()}
    for i, item, _, kind, at in sorted(rows, key=lambda r: (order[r[0]], r[4], r[0])):
        if (item, kind) not in last or at - last[item, kind] > 60_000_000:
            last[item, kind] = at
            kept.add(i)
    assert {r.event_id for r in whole.where("not repeat").collect()} == kept and whole.where("repeat and action != 'store_only'").count() == 0
    # A batch that comes again changes nothing.
    handling.handle_batch(spark.createDataFrame(rows[:3], schema), 1, titles, f"file://{tmp_path}/whole")
    assert whole.count() == 160
    assert handling.handled_events(spark, f"file://{tmp_path}/none") is None
    assert whole.where(F.col("handled")).count() == 160
