"""Compaction reads a log once, and on from mark to mark."""

import random
import time

from pyspark.sql import functions as F

from loomnote.operators import compact

from .test_capture import plain_carried, plain_compact

HEAD = "\n## [10:00:00] ToolUse: Read\n\n**Input:**\n\n```json\n"


def observation(given, output):
    return HEAD + given + compact.MIDDLE + output + compact.END


def test_logs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(f"raw/{i}", "# log" + observation("x" * i, "y" * 200)) for i in range(30)]
    logs = spark.createDataFrame(rows, "path string, text string").mapInPandas(read, "path string, text string")
    texts, remap = compact.compacted(logs, 100, 120)
    moved = compact.carried(texts.select("path", F.col("bytes_before").alias("bytes")), remap)
    assert texts.join(moved, "path").where("bytes = bytes_after AND observations = 1").count() == len(rows) == remap.count()
    assert seen.value == len(rows)


def test_heads_that_nothing_closes_are_not_each_read_to_the_end(spark):
    # From each of the heads to the end there are 4e9 characters in all.
    rows = [("open", "# log" + (HEAD + "x" * 1000) * 2800), ("half", "# log" + (HEAD + "x" * 1000) * 2800 + compact.MIDDLE)]
    began = time.perf_counter()
    assert [d.count() for d in compact.compacted(spark.createDataFrame(rows, "path string, text string"), 10, 10)] == [0, 0]
    assert time.perf_counter() - began < 30


def test_marks_in_any_order(spark):
    rng = random.Random(3)
    parts = [HEAD, HEAD, HEAD[1:], compact.MIDDLE, compact.MIDDLE, compact.END, compact.END, "\n", "```", "é" * 70, "\U0001f600 " * 60, "x" * 130, "a\r\nb", "\n## [1:00:00] ToolUse: x\n"]
    logs = {f"raw/{i}": "".join(rng.choices(parts, k=rng.randint(1, 40))) for i in range(400)} | {"raw/empty": "", "raw/none": observation("", "")}
    texts, remap = compact.compacted(spark.createDataFrame([*logs.items(), ("raw/null", None)], "path string, text string"), 90, 150)
    maps = {}
    for r in sorted(remap.collect(), key=lambda r: r["old_start"]):
        maps.setdefault(r["path"], []).append(tuple(r)[1:])
    want = {p: (t, m) for p, (t, m) in ((p, plain_compact(t, 90, 150)) for p, t in logs.items()) if m}
    found = {r["path"]: r for r in texts.collect()}
    assert len(want) > 50 and maps == {p: m for p, (_, m) in want.items()} and {p: r["text"] for p, r in found.items()} == {p: t for p, (t, _) in want.items()}
    assert all((r["bytes_before"], r["bytes_after"], r["observations"]) == (len(logs[p].encode()), len(r["text"].encode()), len(maps[p])) for p, r in found.items())
    marks = [(p, b) for p in want for b in range(0, len(logs[p].encode()) + 2, 37)]
    got = compact.carried(spark.createDataFrame(marks, "path string, bytes long").withColumn("was", F.col("bytes")), remap).collect()
    assert {(r["path"], r["was"]): r["bytes"] for r in got} == {(p, b): plain_carried(b, maps[p]) for p, b in marks}
