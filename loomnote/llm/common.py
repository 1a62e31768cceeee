"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components
from ..storage import written

#: White space as every contract here counts it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch of whole texts at most.
BATCH_ROWS = 512

#: Bytes of such a batch, about; and the size of arrays from which on the system's allocator takes pages of their own, which it gives back when they go.
BATCH_BYTES, OWN_PAGES = 4 << 20, 1 << 20

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "SPACE", "WORD", "components", "lean", "release", "small_batches", "table", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; from here on its session sends no more than BATCH_ROWS rows and about BATCH_BYTES at once to Python, as a batch of texts stands in memory several times on its way."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def lean() -> None:
    """For the beginning of a task with large arrays: from here on the Python worker takes their memory from the system, whose allocator keeps less of what is free."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # of the GNU library, where a fixed threshold also stops it from growing with what is given back
        ctypes.CDLL("libc.so.6").mallopt(-3, OWN_PAGES)


def release() -> None:
    """For the end of a task: gives the memory that its arrays took back to the system, as the Python worker stays for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a generator over a task's batches, as one that begins lean and at its end gives back the memory: only then, as until it has ended run itself holds what it has made."""

    def task(batches: Iterator) -> Iterator:
        lean()
        yield from run(batches)
        release()

    return task
