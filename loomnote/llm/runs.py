"""Periodic runs of words, found by recompression.

The words of a text, as numbers, are compressed in turn by blocks (a stretch of one symbol becomes one symbol) and by
pairs (symbols are dealt to two sides, each left symbol before a right one joins it), until few symbols are left: the
levels of a run-length grammar. Equal stretches are parsed alike but for their ends, so the longest common extension of
two places needs a step or two on each level: upwards until a symbol differs, then down again to the word that does.

A run of period q and length 3 q at least covers a multiple i of q whose q + 1 next words each equal the one q words
on. So the candidates are the points i of the grid of every period (n / q of them: n log n in all) whose words agree
at nine such places; extensions of (i, i + q) to both sides, by the grammar, then give the run exactly. Candidates
inside a run under a multiple of its period would only give it again and are passed over. No suffix array is needed,
and no text is cut.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, release, small_batches, table

#: Runs have this many words and this many periods at least.
LEAST, POWER = 24, 3
#: Symbols down to which a text is compressed; words up to which the grids of all periods are kept as one table; candidates in one block; places compared at each.
TOP, GRID, STEP, TESTS = 8, 1 << 14, 1 << 16, 9


class Grammar:
    """Levels of a text's recompression. starts[l]: where each symbol of level l begins (in words), and the end; names[l]: the symbols; blocks[l]: whether the step to level l + 1 joins blocks; rank: the highest level on which a symbol begins at a word."""

    def __init__(self, words: np.ndarray):
        names = np.append(words.astype(np.int64), words.max(initial=-1) + 1)  # an end that nothing equals
        starts = np.arange(len(names) + 1)
        rank = np.zeros(len(starts), np.int64)
        self.starts, self.names, self.blocks = [starts.tolist()], [names.tolist()], []
        block, turn = False, 0
        while len(names) > TOP:
            block, turn = not block, turn + 1
            if block:
                head = np.append(True, names[1:] != names[:-1])
            else:
                # Sides by a hash of the symbol; of both directions that with more pairs.
                side = (names * 0x9E3779B1 + turn * 0x85EBCA6B >> 13) & 1
                first, second = side[:-1] > side[1:], side[:-1] < side[1:]
                head = np.append(True, ~(first if first.sum() >= second.sum() else second))
            at = np.flatnonzero(head)
            if len(at) < len(names):
                size = np.diff(np.append(at, len(names)))
                rest = size if block else np.where(size > 1, names[np.minimum(at + 1, len(names) - 1)] + 1, 0)
                key = names[at] * (int(rest.max()) + 1) + rest
                names = np.unique(key, return_inverse=True)[1].astype(np.int64)
                starts = np.append(starts[at], starts[-1])
                self.starts.append(starts.tolist())
                self.names.append(names.tolist())
                self.blocks.append(block)
                rank[starts] = len(self.blocks)
        self.rank = rank.tolist()

    def _next(self, level: int, x: int, y: int, back: bool) -> int:
        """How many words the symbols next to x and y, two boundaries of a level, have in common as far as the next level is concerned: 0 if the symbols differ."""
        starts, names = self.starts[level], self.names[level]
        a, b = bisect_left(starts, x) - back, bisect_left(starts, y) - back
        if min(a, b) < 0 or max(a, b) >= len(names) or names[a] != names[b]:
            return 0
        if level == len(self.blocks) or not self.blocks[level]:
            return starts[a + 1] - starts[a]
        # Of two blocks of one symbol the shorter rest.
        upper = self.starts[level + 1]
        if back:
            return min(p - upper[bisect_left(upper, p) - 1] for p in (x, y))
        return min(upper[bisect_right(upper, p)] - p for p in (x, y))

    def extension(self, x: int, y: int, back: bool = False) -> int:
        """How many words from x and y on are equal (back: up to x and y, both left out)."""
        sign, begin, rank = -1 if back else 1, x, self.rank
        while size := self._next(level := min(rank[x], rank[y]), x, y, back):
            x, y = x + sign * size, y + sign * size
        for lower in range(level - 1, -1, -1):
            while size := self._next(lower, x, y, back):
                x, y = x + sign * size, y + sign * size
        return abs(x - begin)


@functools.cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multiples i of each period q with i + 2 q < GRID, both in order of i + 2 q, and that sum."""
    q = np.arange(1, GRID // 2)
    count = np.maximum((GRID - 1 - 2 * q) // q + 1, 0)
    q = np.repeat(q, count)
    i = (np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)) * q
    order = np.argsort(i + 2 * q, kind="stable")
    return i[order].astype(np.int32), q[order].astype(np.int32), (i + 2 * q)[order]


def _candidates(w: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods, in order of periods, whose words agree at some of the places where a run's must, in blocks."""
    n = len(w)
    if n <= GRID:
        i, q, last = _grid()
        end = np.searchsorted(last, n)
        same = np.flatnonzero((w[i[:end]] == w[i[:end] + q[:end]]) & (w[i[:end] + q[:end]] == w[last[:end]]))
        same = same[np.argsort(q[same], kind="stable")]
        blocks = iter([(i[same], q[same])])
    else:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, int]] = []
            size = 0
            for q in range(1, n // POWER + 1):
                grid = w[::q]
                same = grid[1:] == grid[:-1]
                at = np.flatnonzero(same[1:] & same[:-1]) * q
                held.append((at, q))
                size += len(at)
                if size >= STEP or q == n // POWER:
                    yield np.concatenate([a for a, _ in held]), np.repeat([q for _, q in held], [len(a) for a, _ in held])
                    held, size = [], 0

        blocks = each()
    for i, q in blocks:
        # The run may begin q - 1 words before i and has max(3 q, least) words at least.
        sure = np.maximum(q, least - 2 * q)
        inside = i + sure + q < n
        i, q, sure = i[inside], q[inside], sure[inside]
        for part in range(TESTS):
            t = sure * part // (TESTS - 1)
            use = w[i + t] == w[i + t + q]
            i, q, sure = i[use], q[use], sure[use]
        yield i.astype(np.int64), q.astype(np.int64)


def periodic_runs(w: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of an array of numbers, by start and period."""
    n, found, grammar = len(w), {}, None
    if n < least:
        return np.zeros((0, 3), np.int64)
    for i, q in _candidates(w, least):
        for (start, length), period in found.items():
            fresh = (i < start) | (i + 2 * q > start + length) | (q % period != 0)
            i, q = i[fresh], q[fresh]
        while len(i):
            grammar = grammar or Grammar(w)
            at, period = int(i[0]), int(q[0])
            before = grammar.extension(at, at + period, back=True)
            start, length = at - before, before + grammar.extension(at, at + period) + period
            if length >= max(least, POWER * period):
                found.setdefault((start, length), period)  # periods come in order, and a multiple gives the same run again
                fresh = (i < start) | (i + 2 * q > start + length) | (q % period != 0)
            else:
                fresh = (i < start) | (i + q > start + length) | (q != period)
            fresh[0] = False
            i, q = i[fresh], q[fresh]
    return np.array(sorted((*place, period) for place, period in found.items()), np.int64).reshape(-1, 3)


def looped(words: list[bytes], doc_id: int) -> list[bytes]:
    """words; in one document of ten, by a hash of its id, from some word on a stretch of them over and over."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that any run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, loops: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, runs (array of start, length, period, by start and period), collapsed (the text without repeats).

    Null texts count as empty; texts without words, or with fewer than ``least``, have no runs; repeated rows each give
    a row; an empty table gives an empty result. Whole texts of any length, a text in one task; other columns are not
    read. loops: texts of a tenth of the ids are first made to repeat a stretch of their words (never under a null id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            counts, offsets, runs, texts = [], [0], [], []
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = x.as_buffer().to_pybytes().split() if x.is_valid else []
                if loops and d is not None:
                    words = looped(words, d)
                number: dict[bytes, int] = {}
                found = periodic_runs(np.array([number.setdefault(v, len(number)) for v in words], np.int64), least)
                counts.append(len(words))
                offsets.append(offsets[-1] + len(found))
                runs.append(found)
                texts.append(collapsed(words, found))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
        release()

    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.withColumnRenamed("id", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(table(spark, sf_dir, "documents"), loops=True)
    # Of the runs, in order of start and period, the first of those with the greatest length / period.
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (a, r) -> CASE WHEN a IS NULL OR r.length * a.period > a.length * r.period THEN r ELSE a END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
