"""Running sums, ranks and packing in an order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running(rows: DataFrame, by: list[str], order: list[Column | str], **sums: Column | str) -> DataFrame:
    """rows with a column for each of ``sums``: the sum of that expression over the rows of the same ``by`` up to this one in ``order``.

    Rows are dealt to ranges of (by, order), each sorted by itself; only the totals of ranges are summed up in one
    place, a row for each group and range. The ranges are a table in the shared folder, for they are drawn by a
    sample. ``order`` should tell rows of a group apart.
    """
    valued = rows.withColumns({f"__{n}": F.expr(e) if isinstance(e, str) else e for n, e in sums.items()})
    dealt = valued.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    placed = written(dealt, "order")
    totals = placed.groupBy(*by, "__range").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    same = F.col("__range") == F.col("__r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"__o_{n}": F.sum(f"__{n}").over(within) for n in sums})
    kept = [c for c in rows.columns if c not in sums]
    return own.join(base, same).select(*kept, *[(F.col(f"__o_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def rank(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within ``by`` in ``order``."""
    return running(rows, by, order, **{name: F.lit(1).cast("long")})
