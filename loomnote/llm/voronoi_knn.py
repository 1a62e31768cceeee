"""Exact top-k inner-product search as a Voronoi kNN join.

Pivots are rows of the data, about the square root of their number. An inner product becomes a distance by one more
component: a row x of the data is (x, sqrt(M - |x|^2)) with M the largest squared norm, a query q is (q, 0); then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest pivot is the best one. Data and queries are dealt to the pivots' cells.

1. Every query meets one block of the data of its best cells. Its k-th score there, theta, is a bound from below.
2. By Cauchy-Schwarz q.x <= q.p + |q| |x - p|, so of the cell of pivot p a query needs only the rows with
   |x - p| >= (theta - q.p) / |q|, and nothing of a cell whose summary (its radius) lies below that.
3. Queries of neighbouring cells form groups as far as that saves work. A group needs of each cell the ring that any
   of its queries needs; a data row is sent to the groups that need it and to no other, each group is solved
   locally in blocks, and the blocks' answers are merged.

Blocks keep a group, a cell or copies of one vector with a third of all rows from meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Pivots at most (their distances and summaries are all that the driver holds), and rows that are sorted to choose them.
PIVOTS = 1024
#: Queries that a group holds at most about, and data rows in one of its blocks about.
GROUP_QUERIES, BLOCK_ROWS = 512, 16384
#: Inner products that cost as much as sending a row to one more group.
ROW_COST = 150
SCALE = 256.0


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array<long>): floor(256 x) of each component; rows whose vector is null, or holds a null or non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(np.float64) if len(v) else np.zeros((0, 1))


def _dealt(rows: DataFrame, pivots: np.ndarray, largest: float | None) -> DataFrame:
    """rows with cell and d, the distance |x - p| from its pivot. largest: M for data, None for queries (whose last component is zero)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["v"])
            norm = (x * x).sum(1)
            last = np.sqrt(np.maximum(largest - norm, 0)) if largest is not None else np.zeros(len(x))
            cell = (x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1][None] - (pivots * pivots).sum(1)[None] / 2).argmax(1)
            own = x - pivots[cell, :-1]
            yield f.assign(cell=cell.astype(np.int32), d=np.sqrt((own * own).sum(1)))

    return rows.mapInPandas(run, "id long, v array<long>, cell int, d double")


def _best(sent: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best within each grp, block and share. sent: those, id, v and asks (whether the row is a query)."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        ask, row = f[f["asks"]], f[~f["asks"]].sort_values("id", kind="stable")
        out = []
        if len(ask) and len(row):
            x, ids = _matrix(row["v"]), row["id"].to_numpy()
            take = min(k, len(ids))
            for a in range(0, len(ask), 256):
                q, q_ids = _matrix(ask["v"].iloc[a : a + 256]), ask["id"].to_numpy()[a : a + 256]
                score = q @ x.T
                score[q_ids[:, None] == ids[None]] = -np.inf
                least = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
                for s, low, own in zip(score, least, q_ids, strict=True):
                    at = np.nonzero(s >= low)[0]
                    at = at[np.lexsort((ids[at], -s[at]))][:take]
                    at = at[np.isfinite(s[at])]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at], "score": s[at].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    return sent.groupBy("grp", "block", "share").applyInPandas(solve, "query_id long, vec_id long, score long")


def _needs(asked: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """cell (of queries), other (of data), lo: the least distance from other's pivot that a query of cell needs. asked: cell, v and theta (null: none)."""
    p, slack = pivots[:, :-1], 1e-6 * (1 + float(np.abs(pivots).max()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            q, theta, cell = _matrix(f["v"]), f["theta"].to_numpy(np.float64, na_value=-np.inf), f["cell"].to_numpy()
            for c in np.unique(cell):
                own = cell == c
                size = np.sqrt((q[own] * q[own]).sum(1))[:, None]
                gap = theta[own][:, None] - q[own] @ p.T
                lo = np.where(size > 0, gap / np.maximum(size, 1e-9), np.where(gap > 0, np.inf, -np.inf)).min(0) - slack
                need = np.nonzero(lo <= radius)[0]
                yield pd.DataFrame({"cell": np.int32(c), "other": need.astype(np.int32), "lo": np.maximum(lo[need], -1.0)})

    return asked.select("cell", "v", "theta").mapInPandas(run, "cell int, other int, lo double").groupBy("cell", "other").agg(F.min("lo").alias("lo"))


def _groups(lo: np.ndarray, apart: np.ndarray, rows_of: np.ndarray, q_n: np.ndarray, most: int) -> np.ndarray:
    """Group of each query cell (-1: no queries): cells next to each other join while that saves more sending than it adds products. lo: (query cell, data cell), inf if not needed."""
    group, left, g, need = np.full(len(q_n), -1), set(np.nonzero(q_n)[0].tolist()), 0, np.isfinite(lo)
    while left:
        i = max(left, key=lambda c: (q_n[c], -c))
        held, wants = 0.0, np.zeros(len(rows_of), bool)
        for c in sorted(left, key=lambda c: (apart[i, c], c)):
            both = wants | need[c]
            n_own, n_c, n_both = (rows_of[x].sum() for x in (wants, need[c], both))
            if held and (held + q_n[c] > most or ROW_COST * (n_own + n_c - n_both) < (held + q_n[c]) * n_both - held * n_own - q_n[c] * n_c):
                continue
            group[c], held, wants = g, held + q_n[c], both
            left.discard(c)
        g += 1
    return group


def plan(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Which row meets which: grp, block, share, id, v, asks; None if there is no data or no query. Arguments as of top_k."""
    size = F.size("v")
    dim = data.agg(F.mode(size)).first()[0] or 0
    data = written(data.where(F.col("id").isNotNull() & (size == dim)), "knn-data")
    queries = written(queries.where(F.col("id").isNotNull() & (size == dim)).groupBy("id").agg(F.min("v").alias("v")), "knn-queries")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    largest, n = data.agg(F.max(norm), F.count("*")).first()
    spark = data.sparkSession
    if not n or not queries.limit(1).count():
        return None
    some = data.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(max(1, min(pivots, int(n**0.5)))).collect()
    p = np.unique(np.array([r["v"] for r in some], np.float64).reshape(-1, dim), axis=0)
    p = np.concatenate([p, np.sqrt(np.maximum(largest - (p * p).sum(1), 0))[:, None]], 1)

    # Cells and their summaries, a few numbers for each pivot.
    placed = written(_dealt(data, p, float(largest)), "knn-cells")
    asked = written(_dealt(queries, p, None), "knn-asked")
    rows_of, radius, q_n = np.zeros(len(p)), np.full(len(p), -np.inf), np.zeros(len(p))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
        rows_of[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect():
        q_n[r["cell"]] = r["n"]
    apart = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * p @ p.T, 0))
    asking, full = np.nonzero(q_n)[0], rows_of > 0

    # First answers: each query cell meets a block of its best cells, as many of them as hold more than k rows.
    meets, cuts = [], np.maximum(1, -(-rows_of // block_rows))
    for i in asking:
        near = [j for j in np.argsort(apart[i], kind="stable") if full[j]]
        upto = int(np.searchsorted(np.cumsum([rows_of[j] / cuts[j] for j in near]), 2 * k + 2)) + 1
        meets += [(int(i), int(j), int(cuts[j]), int(-(-q_n[i] // (4 * group_queries)))) for j in near[:upto]]
    first = F.broadcast(spark.createDataFrame(meets, "grp int, cell int, cuts int, shares int"))
    tried = placed.join(first, "cell").where(F.pmod(F.xxhash64("id", F.lit(5)), F.col("cuts")) == 0).select("grp", F.lit(0).alias("block"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "id", "v", F.lit(False).alias("asks"))
    ones = F.broadcast(spark.createDataFrame(sorted({(m[0], m[3]) for m in meets}), "cell int, shares int"))
    trying = asked.join(ones, "cell").select(F.col("cell").alias("grp"), F.lit(0).alias("block"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "v", F.lit(True).alias("asks"))
    found = _best(tried.unionByName(trying), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("theta")).where(F.col("n") >= k)
    bound = written(asked.join(found, asked["id"] == found["query_id"], "left").select("id", "v", "cell", F.col("theta").cast("double").alias("theta")), "knn-bounds")

    lo = np.full((len(p), len(p)), np.inf)
    for r in _needs(bound, p, radius).collect():
        lo[r["cell"], r["other"]] = r["lo"]
    group = _groups(lo, apart, rows_of, q_n, group_queries)
    rings, total = [], {}
    for g in range(group.max() + 1):
        own = lo[group == g].min(0)
        at = np.nonzero(np.isfinite(own) & full)[0]
        rings += [(g, int(j), float(own[j])) for j in at]
        total[g] = rows_of[at].sum()
    blocks = {g: max(1, int(-(-t // block_rows))) for g, t in total.items()}
    shares = {g: max(1, int(-(-q_n[group == g].sum() // (4 * group_queries)))) for g in total}

    ring = F.broadcast(spark.createDataFrame([(g, j, low, blocks[g], shares[g]) for g, j, low in rings], "grp int, cell int, lo double, blocks int, shares int"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    sent = placed.join(ring, "cell").where("d >= lo").select("grp", part, F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "id", "v", F.lit(False).alias("asks"))
    to = F.broadcast(spark.createDataFrame([(int(c), int(group[c]), blocks[group[c]], shares[group[c]]) for c in asking], "cell int, grp int, blocks int, shares int"))
    asks = asked.join(to, "cell").select("grp", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "v", F.lit(True).alias("asks"))
    return sent.unionByName(asks)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows of highest integer inner product, ties to smaller ids.

    data, queries: id (long), v (array<long>); other columns are not read. A row with the query's own id is no
    candidate. Fewer than k candidates give fewer rows. Repeated data rows count each; queries of one id are one
    query (of several vectors under one id the least, component by component, asks). Null ids and vectors of another
    length than most are left out; without data or queries the result is empty. Vectors of all sizes are exact as
    long as the products stay below 2**53.
    """
    sent = plan(data.select("id", "v"), queries.select("id", "v"), k, pivots, group_queries, block_rows)
    if sent is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _best(sent, k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_voronoi_knn": op2_voronoi_knn}
ORACLES = {"op2_voronoi_knn": ORACLE}
