"""Nearest vectors over several blocks, against plain column functions over all pairs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomnote.operators import vector
from loomnote.plans import registry

from .conftest import SF
from .oracle import differences


@pytest.fixture
def small_blocks(monkeypatch):
    for name, size in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 30), ("STEP", 8)):
        monkeypatch.setattr(vector, name, size)


@pytest.mark.parametrize("name", ["cosine_topk", "find_similar", "l2_knn", "auto_link_embedding"])
def test_many_blocks_equal_sql(spark, small_blocks, name):
    assert not differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_odd_vectors_over_blocks(spark, small_blocks):
    odd = [[], [0.0, 0.0, 0.0], None, [1.0], [1.0, None, 2.0], [3.0, 4.0, 0.5, -1.0]]
    rows = [(i, odd[i] if i < len(odd) else [float(i % 5), float(i % 3), 0.25 * (i % 7)]) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 9 < 4").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    for least, k in ((-1.0, 5), (0.3, 40)):
        score = F.round(F.coalesce(vector.cosine(F.col("v"), F.col("q")), F.lit(0.0)), 6)
        best = v.join(q, F.col("id") != F.col("query_id")).select("query_id", "id", score.alias("score")).where(F.col("score") >= least)
        want = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        got = vector.nearest(v, q, k, least)
        assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    near = {(r["query_id"], r["id"]): (r["distance"], r["rank"]) for r in vector.nearest_l2(v, q, 90).collect()}
    assert near[3, 1] == (1.0, near[3, 1][1]) and near[0, 3][0] is None and near[2, 2][0] is None and near[1, 0][1] > 80
    assert near[20, 20] == (0.0, 1)


def test_rounding_is_sparks(spark):
    x = [0.2500005, 0.1234565, 0.1234575, 1e-7, 5e-7, 0.9999995, -0.0000015, 12.3456785]
    want = [r["r"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()]
    assert vector._rounded(vector.np.array(x)).tolist() == want
