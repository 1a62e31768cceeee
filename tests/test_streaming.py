from loomnote.plans import registry
from loomnote.streaming import drain, windows
from loomnote.tables import table

from .conftest import SF


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_streams_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = lambda: windows.read_events(spark, str(tmp_path / "e"), events)
    for name, made in (("tumbling_counts", windows.tumbling), ("sliding_counts", windows.sliding)):
        got = drained(made(stream(), late=None), name, "complete")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*got.columns).collect()))
    got = drained(windows.sessions(stream(), late=None), "session_counts", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.QUERIES["session_counts"](spark, SF).select(*got.columns).collect()))
    assert drained(windows.first_seen(stream(), "event_id", "ts", "60 days"), "seen", "append").count() == events.select("event_id").distinct().count()


def batches(spark, path, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(path)


def test_byte_slices(spark, tmp_path):
    files = batches(spark, str(tmp_path), "path string, size long", [("a", 10), ("b", 5)], [("a", 30), ("b", 5)], [("a", 7)])
    got = sorted(map(tuple, drained(drain.byte_slices(files), "slices", "append").collect()))
    assert got == [("a", 0, 7, True), ("a", 0, 10, False), ("a", 10, 30, False), ("b", 0, 5, False)]


def test_daily_cap(spark, tmp_path):
    calls = batches(spark, str(tmp_path), "day string, seq long, cost double", [("d", 1, 4.0), ("d", 2, 5.0)], [("d", 3, 3.0), ("d", 4, 1.0)])
    got = {r["seq"]: r["admitted"] for r in drained(drain.daily_cap(calls, 10.0), "capped", "append").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_keep_index(spark):
    batch = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    state = drain.keep_index(batch, None)
    after = drain.keep_index(spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string"), state)
    assert {r["path"]: (r["hash"], r["generation"]) for r in after.collect()} == {"a": ("1", 1), "b": ("2", 2), "c": ("1", 1)}


def test_fair_slices(spark):
    pending = spark.createDataFrame([("a", 1, 100), ("b", 2, 5_000), ("c", 3, 50_000)], "path string, since int, pending long")
    got = {r["path"]: r["bytes"] for r in drain.fair_slices(pending, total=9_000, each=10_000).collect()}
    assert got["a"] == 100 and got["b"] == got["c"] and sum(got.values()) <= 9_000 and got["b"] >= 4_400
