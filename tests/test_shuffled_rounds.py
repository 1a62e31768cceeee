"""What runs in rounds sends none of its tables through the driver."""

from loomnote.operators import graph


def test_communities_broadcast_nothing(spark, monkeypatch):
    plans = []

    def seen(f):
        def wrapped(df, *a):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df, *a)

        return wrapped

    for name in ("written", "counted"):
        monkeypatch.setattr(graph, name, seen(getattr(graph, name)))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "from_path string, to_path string")
    found = graph.communities(edges)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_expansion_sorts_no_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "b"), ("e", "a")], "from_path string, to_path string")
    found = graph.expand(edges, spark.createDataFrame([("a",), ("a",)], "path string"), 2)
    assert {tuple(r) for r in found.collect()} == {("b", 1), ("e", 1), ("c", 2)}
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "ShuffledHashJoin" in plan


def test_activation_sorts_no_links(spark, monkeypatch):
    plans = []

    def seen(df, *a, f=graph.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, *a)

    monkeypatch.setattr(graph, "written", seen)
    edges = spark.createDataFrame([("a", "b", "uses", "relation"), ("a", "c", "uses", "relation"), ("c", "d", "uses", "relation")], "from_path string, to_path string, relation_type string, kind string")
    found = graph.activate(edges, spark.createDataFrame([("a",)], "path string"), rounds=2)
    assert {r["path"]: round(r["activation"], 6) for r in found.collect()} == {"a": 1.0, "b": 0.51, "c": 0.51, "d": 0.306}
    assert any("ShuffledHashJoin" in p for p in plans) and not any("SortMergeJoin" in p or "BroadcastHashJoin" in p for p in plans)
