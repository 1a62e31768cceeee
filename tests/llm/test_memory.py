"""Tasks give memory back once nothing holds it, and batches for Python are bounded in bytes."""

import weakref

from loomnote.llm import common


class Held:
    pass


def test_memory_is_given_back_after_the_task_has_let_go(monkeypatch):
    seen, held = [], []

    def run(batches):
        own = Held()
        held.append(weakref.ref(own))
        for b in batches:
            yield b, id(own)

    monkeypatch.setattr(common, "release", lambda: seen.append(held[0]() is None))
    assert [b for b, _ in common.tidy(run)(iter([1, 2]))] == [1, 2]
    assert seen == [True]


def test_batches_of_long_texts_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = common.small_batches(spark.range(0, 64, 1, 1).selectExpr("repeat('x', 1 << 18) AS text"))
        sizes = docs.mapInArrow(lambda batches: (b.select([]).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) == 64
        assert max(r["n"] for r in sizes) <= (common.BATCH_BYTES >> 18) + 1
    finally:
        spark.conf.set(key, before)
