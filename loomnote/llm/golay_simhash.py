"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code
[23, 12, 7]. Two fingerprints with at most 4 differing bits either agree in a whole segment, or differ in every
segment and then in exactly one bit of two segments at least (pigeonhole). So the keys of a fingerprint are

* its three segments as they are, and
* for each pair of segments the indices of nearby codewords. A word at distance 3 from its codeword (the most
  that there is) has five more codewords at distance 4; two words one bit apart have the same codeword or each
  has the other's among those five. A word gives its own codeword's index and those of the five that are
  smaller, so the two meet at the smaller index.

Equal fingerprints are merged first. All members of a segment's bucket are compared with a few representatives, the
links found are contracted to components, and only buckets that hold several components are compared further. What
is large among them is split by finer keys. If one segment agrees, the other two share at most four errors, so one
of them has at most two: two words at most two bits apart share one of the (up to six) indices of either, as the
word between them has one codeword that both know. If no segment agrees, the segment beside a pair of keys has at
most two errors too. So every bucket splits by the indices of another segment and loses no pair. A finer bucket that
is still large holds texts that are much alike; there members outside its largest component are compared with all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, small_batches, table, tidy, written

SHINGLE, SEED, BITS = 4, 42, 4
#: Members of a bucket from which on it is split by finer keys, and from which on the largest component of a finer bucket is not compared with itself.
LARGE = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = 1 << 16

#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of at most 3 bits, its weight, and the indices (upper 12 bits) of the five codewords of weight 7 that cover an error of 3 bits."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        s = words.copy()
        for bit in range(22, 10, -1):
            s ^= np.where(s >> bit & 1, GENERATOR << (bit - 11), 0)
        return s

    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), bits]
    errors.append(np.array([a | b for i, a in enumerate(bits) for b in bits[:i]]))
    errors.append(np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]))
    error, weight, near = np.zeros(2048, np.int64), np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    for w, e in enumerate(errors):
        s = syndrome(e)
        error[s], weight[s] = e, w
    data = np.arange(4096, dtype=np.int64) << 11
    code = data | syndrome(data)
    seven = code[np.array([bin(c).count("1") == 7 for c in code])]
    for e, s in zip(errors[3], syndrome(errors[3]), strict=True):
        near[s] = seven[(seven & e) == e] >> 11
    return error, weight, near


def codeword_indices(words: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: indices (n, 6) of codewords, the own one first, and which of them are keys."""
    error, weight, near = tables
    s = words.copy()
    for bit in range(22, 10, -1):
        s ^= np.where(s >> bit & 1, GENERATOR << (bit - 11), 0)
    own = (words ^ error[s]) >> 11
    all_ = np.concatenate([own[:, None], own[:, None] ^ near[s]], axis=1)
    use = (all_ < own[:, None]) & (weight[s] == 3)[:, None]
    use[:, 0] = True
    return all_, use


def fuzzy_keys(prints: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in prints, and the keys of the print there: kind (0-2 whole segment, 3-5 pair of segments) << 58 | value."""
    parts = _segments(prints)
    at, keys = [np.arange(len(prints))] * 3, [np.int64(k) << 58 | x for k, x in enumerate(parts)]
    coded = [codeword_indices(x, tables) for x in parts]
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        (x, ux), (y, uy) = coded[a], coded[b]
        use = ux[:, :, None] & uy[:, None, :]
        # Two such prints differ in one bit of either segment, so the parity of both segments together agrees.
        parity = (np.bitwise_count(parts[a]) ^ np.bitwise_count(parts[b])).astype(np.int64) & 1
        value = parity[:, None, None] << 24 | x[:, :, None] << 12 | y[:, None, :]
        at.append(np.nonzero(use)[0])
        keys.append(np.int64(kind) << 58 | value[use])
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text in UTF-8, as a signed 64-bit number; zero without any word."""
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return int(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)[0])
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - shingle + 1], ends[shingle - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _STEP):
        h = np.array([digest(joined[a:z], SEED) for a, z in zip(starts[i : i + _STEP].tolist(), ends[i : i + _STEP].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, print (long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(None if not x.is_valid else x.as_buffer().to_pybytes(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "print"])

    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, print long")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    p = prints.view(np.uint64)
    return [(p & np.uint64(0x3FFFFF)).astype(np.int64), (p >> np.uint64(22) & np.uint64(0x1FFFFF)).astype(np.int64), (p >> np.uint64(43)).astype(np.int64)]


def finer_keys(keys: np.ndarray, prints: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and what keys of fuzzy_keys become there with the codeword index of a segment that they don't have: kind << 58 | value << 16 | segment << 12 | index."""
    kind, value, at, out = keys >> 58, keys & ((1 << 58) - 1), [], []
    for j, words in enumerate(_segments(prints)):
        # Kinds 0-2 have segment 0, 1, 2; kinds 3-5 have all but segment 2, 1, 0.
        rows = np.nonzero((kind < 3) & (kind != j) | (kind == 5 - j))[0]
        index, _ = codeword_indices(words[rows], tables)
        use = np.ones(index.shape, bool)
        use[:, 1:] = (index[:, 1:] != index[:, :1]).any(axis=1)[:, None]
        at.append(np.repeat(rows, use.sum(axis=1)))
        out.append(((keys >> 58 << 58 | value << 16 | j << 12)[rows][:, None] | index)[use])
    return np.concatenate(at), np.concatenate(out)


def _keyed(prints: DataFrame) -> DataFrame:
    tables = golay()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                part = values[i : i + 4096]
                at, keys = fuzzy_keys(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(keys)], ["print", "key"])

    return prints.select("print").mapInArrow(tidy(run), "print long, key long")


def _finer(members: DataFrame) -> DataFrame:
    tables = golay()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(keys), 16384):
                at, fine = finer_keys(keys[i : i + 16384], prints[i : i + 16384], tables)
                yield pa.RecordBatch.from_arrays([pa.array(fine), pa.array(prints[i : i + 16384][at]), pa.array(parts[i : i + 16384][at])], ["key", "print", "part"])

    return members.select("key", "print", "part").mapInArrow(tidy(run), "key long, print long, part long")


def link_components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """print, root for the distinct fingerprints that link to another: root is the least print of the component.

    prints: column print, without repeats. Exact for up to 4 differing bits.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the keys find pairs of at most 4 differing bits")
    keyed = written(_keyed(prints), "simhash-keys")
    # Links to four representatives of each whole-segment bucket.
    whole = keyed.where(f"key < {3 << 58}")
    chosen = whole.groupBy("key").agg(
        F.min("print").alias("r0"), F.max("print").alias("r1"), F.min_by("print", F.xxhash64("print")).alias("r2"), F.max_by("print", F.xxhash64("print")).alias("r3")
    ).where("r0 <> r1")
    near = " OR ".join(f"(r{i} <> print AND bit_count(r{i} ^ print) <= {bits})" for i in range(4))
    first = (
        whole.alias("w").join(chosen.alias("c"), (F.col("w.key") == F.col("c.key")) & F.expr(near))
        .select("print", F.explode(F.expr(f"filter(array_distinct(array(r0, r1, r2, r3)), r -> r <> print AND bit_count(r ^ print) <= {bits})")).alias("v"))
        .select(F.col("print").alias("u"), "v")
    )
    labels = components(first, "simhash-first")
    # Members of different components that share a bucket: small buckets whole, large ones by finer keys.
    member = written(keyed.join(labels.withColumnRenamed("node", "print"), "print", "left").select("key", "print", F.coalesce("root", "print").alias("part")), "simhash-members")
    mixed = member.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", "n")
    mixed = written(member.join(mixed, "key", "left"), "simhash-mixed").where("n IS NOT NULL")
    fine = written(_finer(mixed.where(F.col("n") > LARGE)), "simhash-finer")
    sizes = (
        fine.groupBy("key", "part").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.sum("n").alias("n"), F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"))
        .where("parts > 1")
    )
    known = written(fine.join(sizes, "key", "left").select("key", "print", "part", "n", "largest"), "simhash-known").where("n IS NOT NULL")
    near = F.expr(f"a.part <> b.part AND bit_count(a.print ^ b.print) <= {bits}")
    small = mixed.where(F.col("n") <= LARGE).drop("n").unionByName(known.where(F.col("n") <= LARGE).drop("n", "largest"))
    within = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.part") < F.col("b.part")) & near)
    dense = known.where(F.col("n") > LARGE)
    across = dense.where("part <> largest").alias("a").join(dense.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    ends = [F.col("a.part").alias("u"), F.col("b.part").alias("v")]
    crossing = within.select(*ends).unionByName(across.select(*ends))
    joined = components(crossing, "simhash-crossing")
    least = labels.select(F.col("node").alias("print"), "root").unionByName(joined.select(F.col("node").alias("print"), F.col("node").alias("root"))).groupBy("print").agg(F.min("root").alias("part"))
    return least.join(joined.withColumnRenamed("node", "part"), "part", "left").select("print", F.coalesce("root", "part").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, group_size.

    component_id is the smallest id that can be reached over links (null only if all ids there are null). Null
    and empty texts have fingerprint zero and link like any other; repeated rows each give a row; an empty table
    gives an empty result. Other columns are not read.
    """
    own = written(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = written(own.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    linked = link_components(distinct.select("print"), bits)
    placed = written(distinct.join(linked, "print", "left").select("print", "least", "n", F.coalesce("root", "print").alias("root")), "simhash-placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    by_print = placed.select("print", "root").join(named, "root").drop("root")
    return own.join(by_print, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with all its columns, one row of each near-duplicate group: that with the smallest id.

    Rows go by (id, text digest), so that unrelated texts without an id, or under one id, each stay; null ids come
    after all others, and of texts under one id in one group that with the smallest digest stays. Of repeated rows one
    stays; an empty table stays empty; all columns stay, whatever their names.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), digest.alias("sha"))
    groups = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **options)
    stay = groups.where(F.col("key").eqNullSafe(F.col("component_id"))).select("key.id", "key.sha").distinct().alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest.alias("sha")).alias("d")
    same = rows.join(stay, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.sha") == F.col("k.sha"))).select("d.*")
    order = Window.partitionBy("id", "sha").orderBy(F.xxhash64(F.col("row").cast("string")))
    return same.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_golay_simhash": op9_golay_simhash}
ORACLES: dict[str, str] = {}
