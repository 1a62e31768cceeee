"""Nearest vectors, and the health and life of an embedding table."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..storage import counted


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Queries and rows of a block, and rows of it that are scored at a time.
QUERY_BLOCK, ROW_BLOCK, STEP = 4096, 16384, 1024


def _matrix(lists: pd.Series, holes: pd.Series) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors side by side in double, filled up with zeros, and which components are there; None if all are."""
    sizes = np.array([0 if v is None else len(v) for v in lists])
    width = int(sizes.max(initial=0))
    if (sizes == width).all() and holes.isna().all():
        return np.array(lists.tolist(), "f8").reshape(len(lists), width), None
    out, there = np.zeros((len(lists), width)), np.arange(width) < sizes[:, None]
    for i, (v, h) in enumerate(zip(lists, holes, strict=True)):
        if v is not None:
            out[i, : len(v)] = v
        if h is not None:
            there[i, : len(h)] &= ~np.asarray(h, bool)
    return np.where(there, out, 0.0), there


def _summed(a: np.ndarray, b: np.ndarray, far: bool) -> np.ndarray:
    """Sums of products, or of squared gaps, one component after the other, as the column functions take them."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        x, y = a[..., j], b[..., j]
        total += (x - y) * (x - y) if far else x * y
    return total


def _rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """To so many digits as Spark rounds: halves of the decimal form away from zero."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    close = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    out[close] = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in x[close]]
    return out + 0.0


def _best(rows: pd.DataFrame, asked: pd.DataFrame, k: int, least: float | None, same_dim: bool, far: bool) -> pd.DataFrame:
    """query_id, id, score: the k best rows of a block for each query of a block, by cosine or (far) by distance.

    A matrix product leaves out what is below the k-th best by more than its error and the rounding; the others are
    scored component by component. Blocks with non-finite components, or by distance with missing ones, are scored so as a whole.
    """
    rows, asked = rows.sort_values("id", ignore_index=True), asked.reset_index(drop=True)
    (v, has_v), (q, has_q) = _matrix(rows["v"], rows["h"]), _matrix(asked["q"], asked["g"])
    width, ragged = max(v.shape[1], q.shape[1]), has_v is not None or has_q is not None or v.shape[1] != q.shape[1]
    pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    there = lambda x, has: pad(np.ones(x.shape, bool) if has is None else has)
    if ragged:
        has_v, has_q = there(v, has_v), there(q, has_q)
    v, q, ids, own = pad(v), pad(q), rows["id"].to_numpy(), asked["query_id"].to_numpy()
    with np.errstate(all="ignore"):
        vv, qq = _summed(v, v, False), _summed(q, q, False)
        # A component that is not there adds nothing to a product, as the zero in its place; to a distance it would.
        slow = ragged and far or not (np.isfinite(vv).all() and np.isfinite(qq).all())
        n, m = np.sqrt(vv), np.sqrt(qq)
        sizes = [np.array([-1 if x is None else len(x) for x in c]) for c in (rows["v"], asked["q"])]

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Rounded scores of queries i with rows j; distances negative, so that the highest is best; NaN (no value) where there is no distance."""
            out = np.empty(len(i))
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                x, y = v[b], q[a]
                if slow and ragged:
                    both = has_v[b] & has_q[a]
                    x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
                total = _summed(x, y, far)
                if far:
                    got = np.sqrt(total)
                    got = -_rounded(got)
                    if slow and ragged:
                        got[~both.any(axis=1)] = np.nan
                else:
                    norm = n[b] * m[a]
                    got = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), np.where(np.isnan(norm), np.nan, 0.0))
                    fine = np.isfinite(got)
                    got[fine] = _rounded(got[fine])
                out[s : s + (1 << 16)] = got
            return out

        kept = (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
        bar = np.full(len(q), -np.inf if least is None else least)
        full = np.zeros(len(q), bool)
        for s in range(0, len(v), STEP):
            part = v[s : s + STEP]
            if slow:
                i, j = (x.ravel() for x in np.indices((len(q), len(part))))
            else:
                near = q @ part.T
                if far:
                    near = -np.sqrt(np.maximum(qq[:, None] + vv[None, s : s + STEP] - 2 * near, 0.0))
                else:
                    norm = m[:, None] * n[None, s : s + STEP]
                    near = np.where(norm > 0, near / np.where(norm > 0, norm, 1.0), 0.0)
                # The error of a distance is the root of that of its square, where it is small.
                slack = 2e-6 + (np.sqrt(1e-13 * (vv.max(initial=0) + qq.max(initial=0))) if far else 0.0)
                if not full.all() and len(part) > k + 1:
                    # One more than k: a query's own row does not count.
                    kth = np.partition(near, len(part) - k - 1, axis=1)[:, len(part) - k - 1]
                    i, j = np.nonzero(near >= np.maximum(bar, kth - slack)[:, None] - slack)
                else:
                    i, j = np.nonzero(near >= bar[:, None] - slack)
            j = j + s
            if not far:
                apart = ids[j] != own[i]
                if same_dim:
                    apart &= (sizes[0][j] == sizes[1][i]) & (sizes[0][j] >= 0)
                i, j = i[apart], j[apart]
            score = exact(i, j)
            if least is not None:
                on = (score >= least) | np.isnan(score)
                i, j, score = i[on], j[on], score[on]
            i, j, score = (np.concatenate(x) for x in zip(kept, (i, j, score), strict=True))
            # NaN comes first among cosines, as the largest number; pairs without a distance come last.
            by = np.where(np.isnan(score), np.inf if far else -np.inf, -score)
            order = np.lexsort((j, by, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == k - 1
            full[i[last]] = True
            bar[i[last]] = np.where(np.isnan(score[last]), -np.inf if far else np.inf, score[last])
            kept = tuple(x[place < k] for x in (i, j, score))
    i, j, score = kept
    score = -score if far else score
    return pd.DataFrame({"query_id": own[i], "id": ids[j], "score": pd.Series(score + 0.0).astype(object).where(~np.isnan(score), None) if far else score})


def _meet(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, same_dim: bool = False, far: bool = False) -> DataFrame:
    """query_id, id, score: of every block of rows the k best for each query. Each block of queries meets each block of rows in a task of its own, which holds no more than these two; blocks are counted."""
    holes = lambda c: F.when(F.exists(c, lambda x: x.isNull()), F.transform(c, lambda x: x.isNull()))
    rows, n = counted(vectors.select("id", F.col("v").cast("array<double>").alias("v"), holes("v").alias("h")), "vector-rows", F.count(F.lit(1)))
    asked, m = counted(queries.select("query_id", F.col("q").cast("array<double>").alias("q"), holes("q").alias("g")), "vector-queries", F.count(F.lit(1)))
    of_rows, of_queries = (max(1, -(-x // size)) for x, size in ((n, ROW_BLOCK), (m, QUERY_BLOCK)))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("*", block("id", of_rows).alias("__v"), every(of_queries).alias("__q"))
    right = asked.select("*", every(of_rows).alias("__v"), block("query_id", of_queries).alias("__q"))
    kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"

    def solve(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return _best(r, a, k, least, same_dim, far)

    return left.groupBy("__q", "__v").cogroup(right.groupBy("__q", "__v")).applyInPandas(solve, kinds)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = params.SIGNAL_CAP, least: float = params.MIN_VECTOR_SCORE, same_dim: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k rows of highest cosine, at least ``least``, without the query itself.

    vectors: id, v; queries: query_id, q, a stated set that is compared with all rows, in blocks.
    """
    scored = _meet(vectors.where("id IS NOT NULL"), queries.where("query_id IS NOT NULL"), k, least, same_dim)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_l2(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, distance, rank: the k rows (id, v) nearest to each query (query_id, q) by Euclidean distance over the components that both have, the query's own row too; pairs without any come last."""
    measured = _meet(vectors.where("id IS NOT NULL"), queries.where("query_id IS NOT NULL"), k, far=True).withColumnRenamed("score", "distance")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return measured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def stub(v: Column) -> Column:
    """A unit vector on the first axis: what a stand-in embedder gives."""
    return (F.get(v, 0) == 1) & ~F.exists(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda x: x != 0)


def guard(records: DataFrame, dim: int, vector: str = "v") -> DataFrame:
    """records with reason: why a vector may not be written, null if it may."""
    v = F.col(vector)
    return records.withColumn("reason", F.when(v.isNull() | (F.size(v) != dim), "dimension").when(zero(v), "zero").when(stub(v), "stub"))


def health(records: DataFrame, vector: str = "v", floor: int = 16) -> DataFrame:
    v = F.col(vector)
    return records.agg(
        F.count("*").alias("records"), F.countDistinct(F.size(v)).alias("dims"), F.min(F.size(v)).cast("long").alias("least_dim"), F.countDistinct(F.sha2(F.to_json(v), 256)).alias("distinct_vectors"),
        F.count_if(zero(v)).alias("zero"), F.count_if(stub(v)).alias("stub"), F.count_if(F.size(v) < floor).alias("below_floor"),
    )


def latest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key by the given columns; null order columns come first."""
    whole = F.struct(*records.columns)
    return records.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def refresh_plan(docs: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """key, action: unchanged, pending (no record, or of another hash, model or dim), or remove (no document). Both have hash, model, dim."""
    d, r = docs.alias("d"), records.alias("r")
    same = F.col("d.hash").eqNullSafe(F.col("r.hash")) & F.col("d.model").eqNullSafe(F.col("r.model")) & F.col("d.dim").eqNullSafe(F.col("r.dim"))
    joined = d.join(r, F.col(f"d.{key}") == F.col(f"r.{key}"), "full")
    action = F.when(F.col(f"d.{key}").isNull(), "remove").when(F.col(f"r.{key}").isNull() | ~same, "pending").otherwise("unchanged")
    return joined.select(F.coalesce(f"d.{key}", f"r.{key}").alias(key), action.alias("action"))
