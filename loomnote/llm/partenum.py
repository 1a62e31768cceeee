"""N-gram Jaccard join by PartEnum signatures.

A document's set are the hashes of its distinct word shingles. Sets go by bands of like size; two linked sets of a band
whose largest size is r differ in at most k = 2 r (100 - p) / (100 + p) elements. The domain (all hashes) is cut into
half as many parts as k + 1, so in one part two such sets differ in one element at most; the part is cut into three
cells, of which two then agree. So a set's signatures in a band are, for each part, the three pairs of its cells, and
linked sets share one. A set belongs to its own band, and to the next if partners of it may be there.

Documents of equal sets are one class first. Signatures are shuffled once; what only one class has goes. Then

1. every class is compared exactly with the one of the hubs (a member of a signature's bucket) that it shares most
   signatures with, and the links found are contracted to components,
2. the members of buckets that still hold several components are compared in blocks of bounded size by parity bitmaps
   of their sets, whose differing bits are at most the sets' differing elements; every class is then compared exactly
   with the likeliest partner that it has in another component, and links are contracted again,
3. last all pairs of different components that the bitmaps leave are compared exactly. Of two components the likeliest
   pairs of a bucket come first, with more in further rounds until none was left out.

So no link between components is lost, and the copies of a large group are not expanded into all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, lean, release, small_batches, table, written

SHINGLE, PERCENT = 3, 90
#: Cells of a part, of which one may differ; rows of a broadcast at most; members of a bucket in one block; pairs of two components that a block offers first; rounds of likeliest partners; words whose hashes a task keeps.
CELLS, SMALL, BLOCK, FIRST, ROUNDS, CACHE = 3, 1 << 20, 1024, 256, 1, 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingles:
    """Sets of shingle hashes of texts; keeps the hashes of frequent words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The 64-bit hashes of the distinct shingles of a text in UTF-8, sorted: A-Z lower-cased, with fewer words the whole sequence, none without words."""
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.size:  # the hash of no word stands for those that lack
            h = np.append(h, np.full(self.size - len(h), xxhash.xxh3_64_intdigest(b""), np.uint64))
        x = np.zeros(len(h) - self.size + 1, np.uint64)
        for t in range(self.size):
            x = (x + h[t : len(h) - self.size + 1 + t]) * _ODD[t % 3]
            x ^= x >> np.uint64(29)
        return np.unique(_mix(x))


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, most elements in which two linked sets differ) of each band, as far as that of ``largest`` and one more."""
    out, low, high = [], 1, 0
    while not out or out[-1][0] <= largest:
        high = max(low, low * 5 // 4, high * 100 // percent)
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def signatures(found: np.ndarray, layout: list[tuple[int, int, int]], percent: int) -> np.ndarray:
    """The signatures of a set in its own band and, where partners may be larger, in the next."""
    n, out = len(found), []
    own = next(i for i, (_, high, _) in enumerate(layout) if n <= high)
    for i in [own] + [own + 1] * (n * 100 // percent > layout[own][1]):
        differ = layout[i][2]
        if not differ:
            continue  # only equal sets link
        parts = (differ + 2) // 2
        cells = np.zeros(parts * CELLS, np.uint64)
        np.add.at(cells, ((found >> np.uint64(32)) * np.uint64(parts * CELLS) >> np.uint64(32)).astype(np.int64), _mix(found))
        cells = cells.reshape(parts, CELLS)
        pairs = cells.sum(axis=1, dtype=np.uint64)[:, None] - cells
        tag = (np.uint64(i << 32) + np.arange(parts * CELLS, dtype=np.uint64)).reshape(parts, CELLS)
        out.append(_mix(pairs + tag * _ODD[0]).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(found: np.ndarray, percent: int) -> bytes:
    """A bitmap of a set, in which elements meet by exclusive or; its size is a power of two that grows with the set's."""
    bits = 1 << max(6, (64 * len(found) * (100 - percent) // (100 + percent)).bit_length())
    count = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """row, id, text_hash, n, d1, d2, signatures of every row; signatures are null where an equal set came before in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        shingles, layout, seen = Shingles(size), bands(percent, 1 << 12), set()
        for batch in batches:
            n, d1, d2, sigs = [], [], [], []
            for x in batch.column(2):
                found = shingles(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64)
                if len(found) > layout[-1][0]:
                    layout = bands(percent, 2 * len(found))
                a, b = int(found.sum(dtype=np.uint64)), int(_mix(found ^ _ODD[1]).sum(dtype=np.uint64))
                key = (a, b, len(found))
                n.append(len(found))
                d1.append(a)
                d2.append(b)
                sigs.append(None if key in seen or not len(found) else signatures(found, layout, percent))
                seen.add(key)
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            flat = np.concatenate([np.zeros(0, np.uint64), *[s for s in sigs if s is not None]])
            ends = np.cumsum([0, *[0 if s is None else len(s) for s in sigs]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(flat), mask=pa.array([s is None for s in sigs]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), signed(d1), signed(d2), lists], ["id", "text_hash", "n", "d1", "d2", "signatures"])
        release()

    kind = docs.schema["id"].dataType.simpleString()
    made = small_batches(docs).select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"id {kind}, text_hash long, n long, d1 long, d2 long, signatures array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """cls, elements, bits of documents (cls, text); of rows that repeat a class one in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        shingles, seen = Shingles(size), set()
        for batch in batches:
            texts = {c: x for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if c not in seen}
            seen |= texts.keys()
            found = [shingles(x.as_buffer().to_pybytes()) for x in texts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([parity(s, percent) for s in found], pa.binary())], ["cls", "elements", "bits"])
        release()

    return docs.select("cls", "text").mapInArrow(run, "cls long, elements binary, bits binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: those of the distinct pairs (a, b) whose sets are similar enough, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            use = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(e.as_buffer(), np.uint64) for e in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                use.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(use, pa.bool_()))
        release()

    one = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    other = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def _folded(bits: list[bytes], group: np.ndarray) -> np.ndarray:
    """Bitmaps as rows of words, each group's at the size of its smallest, the rest zero."""
    size = np.array([len(b) for b in bits])
    least = size.copy()
    np.minimum.at(smallest := np.full(int(group.max()) + 1, size.max()), group, size)
    least = smallest[group]
    out = np.zeros((len(bits), int(least.max()) // 8), np.uint64)
    for have, want in {*zip(size.tolist(), least.tolist(), strict=True)}:
        at = np.flatnonzero((size == have) & (least == want))
        rows = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)
        out[at, : want // 8] = np.bitwise_xor.reduce(rows.reshape(len(at), have // want, want // 8), axis=1)
    return out


def _close(members: DataFrame, percent: int, most: int | None) -> DataFrame:
    """a, b, differ, more: pairs of different components in a bucket's blocks (sig, i, j, block, cls, part, n, bits) whose bitmaps leave a link possible, and by how many bits they differ. Of two components the ``most`` likeliest, more: whether there were others; without ``most`` the likeliest of each class a."""

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        cols = {k: np.array(v) for k, v in rows.items() if k != "bits"}
        new = np.append(True, (cols["sig"][1:] != cols["sig"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1]))
        group = np.cumsum(new) - 1
        bits, shift, found = _folded(rows["bits"], group), 1, []
        while True:
            at = np.flatnonzero(group[shift:] == group[:-shift])
            if not len(at):
                break
            at = at[(cols["part"][at] != cols["part"][at + shift]) & ((cols["i"][at] == cols["j"][at]) | (cols["block"][at] != cols["block"][at + shift]))]
            differ = np.bitwise_count(bits[at] ^ bits[at + shift]).sum(axis=1, dtype=np.int64)
            use = differ * (100 + percent) <= (cols["n"][at] + cols["n"][at + shift]) * (100 - percent)
            found.append(np.stack([at[use], at[use] + shift, differ[use]]))
            shift += 1
        one, other, differ = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        if most is None:
            one, other, differ = np.append(one, other), np.append(other, one), np.append(differ, differ)
            keys = (cols["cls"][other], differ, one)
        else:
            swap = cols["part"][one] > cols["part"][other]
            one, other = np.where(swap, other, one), np.where(swap, one, other)
            keys = (differ, cols["part"][other], cols["part"][one], group[one])
        order = np.lexsort(keys)
        one, other, differ = one[order], other[order], differ[order]
        key = np.stack([k[order] for k in (keys[2:] if most is None else keys[1:])], axis=1)
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        use = np.arange(len(key)) - np.repeat(head, size) < (most or 1)
        values = [cols["cls"][one], cols["cls"][other], differ, np.repeat(size > (most or 1), size)]
        return pa.RecordBatch.from_arrays([pa.array(v[use]) for v in values], ["a", "b", "differ", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            # The last bucket may go on in the next batch.
            last = (held[-1]["sig"], held[-1]["i"], held[-1]["j"])
            cut = len(held)
            while cut and (held[cut - 1]["sig"], held[cut - 1]["i"], held[cut - 1]["j"]) == last:
                cut -= 1
            if cut:
                yield solve({k: [r[k] for r in held[:cut]] for k in held[0]})
                held = held[cut:]
        if held:
            yield solve({k: [r[k] for r in held] for k in held[0]})
        release()

    sorted_ = members.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "cls")
    return sorted_.select("sig", "i", "j", "block", "cls", "part", "n", "bits").mapInArrow(run, "a long, b long, differ long, more boolean")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: sig, cls, n, part, size."""
    named = members.join(parts.select(F.col("node").alias("cls"), "root"), "cls", "left").select("sig", "cls", "n", F.coalesce("root", "cls").alias("part"))
    named = written(named, "partenum-named")
    sizes = named.groupBy("sig").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("sig", "size")
    return named.join(sizes, "sig")


def link_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of all classes that link to another; members: sig, cls, n, the classes that share signatures."""
    hub = members.groupBy("sig").agg(F.min_by("cls", F.xxhash64("cls")).alias("hub"))
    shared = members.join(hub, "sig").where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("n"))
    best = shared.groupBy("cls").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    links = written(_linked(best.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), sets, percent), "partenum-links")
    parts, turn, most = components(links, "partenum-parts"), 0, FIRST
    while True:
        whole = turn >= ROUNDS
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        mixed = _mixed(members, parts).withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(cls), blocks)"))
        dealt = mixed.withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
        near = written(_close(dealt.join(sets.select("cls", "bits"), "cls"), percent, most if whole else None), "partenum-near")
        pairs = near if whole else near.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
        found = _linked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent)
        links = written(links.unionByName(found), "partenum-links")
        parts = components(links, "partenum-parts")
        if whole and near.where("more").isEmpty():
            return parts
        turn, most = turn + 1, most * 16 if whole else most


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, group_size.

    Documents link when 100 * common shingles >= percent * all their shingles (percent: 80 to 99). component_id is the
    smallest id that can be reached over links, itself included. Null and empty texts, and those without words, have an
    empty set, link with nothing and are their own group; null ids are part of a group and never its smallest id, unless
    all are null; repeated rows each give a row and link, as equal sets do; an empty table gives an empty result. Whole
    texts of any length; other columns are not read. Shingles count as equal if their 64-bit hashes are.
    """
    if not 80 <= percent <= 99:
        raise ValueError("bands are made for 80 to 99 percent")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(_signed(docs, size, percent), "partenum-rows")
    classes = written(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("cls"), F.min("id").alias("least"), F.count("*").alias("copies")), "partenum-classes")
    # Signatures that two sets share: told apart by d1, which their own ids replace then.
    each = Window.partitionBy("sig")
    shared = rows.where("signatures IS NOT NULL").select(F.explode("signatures").alias("sig"), "d1").withColumns({"low": F.min("d1").over(each), "high": F.max("d1").over(each)}).where("low <> high")
    members = written(shared.select("sig", "d1").distinct().join(classes.select("d1", "cls", "n"), "d1").select("sig", "cls", "n"), "partenum-members")
    chosen = members.select("cls").distinct().join(rows.select(F.col("row").alias("cls"), F.col("id").alias("own"), "text_hash"), "cls")
    chosen = written(chosen, "partenum-chosen")
    if chosen.count() <= SMALL:
        chosen = F.broadcast(chosen)
    texts = docs.withColumn("hash", F.xxhash64("text")).join(chosen, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("own"))).select("cls", "text")
    sets = written(_sets(texts, size, percent), "partenum-sets")
    parts = link_components(members, sets, percent)
    placed = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("d1", "d2", "n", "least", "copies", F.coalesce("root", "cls").alias("part"))
    placed = written(placed, "partenum-placed")
    groups = placed.groupBy("part").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size"))
    named = placed.select("d1", "d2", "n", "part").join(groups, "part").drop("part")
    filled = rows.where("n > 0").select("id", "d1", "d2", "n").join(named, ["d1", "d2", "n"]).select("id", "n", "component_id", "group_size")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("group_size"))
    return filled.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "group_size")


def op11_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.r),
part AS (SELECT doc_id, min(r) AS component_id, count(*) AS group_size FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, group_size FROM documents d LEFT JOIN size USING (doc_id) JOIN part USING (doc_id)
"""

QUERIES = {"op11_partenum_join": op11_partenum_join}
ORACLES = {"op11_partenum_join": ORACLE}
