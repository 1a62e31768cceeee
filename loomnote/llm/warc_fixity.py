"""Merkle fixity audit of two replicas of a WARC collection.

Every record is hashed where it is read. The digests of the records that start in a range of offsets make a leaf,
sixteen leaves a wider range and so on up to the file; sixteen files or so, by the hash of their name, a bucket,
sixteen buckets a wider one and so on up to the root: as many levels as the longest file and the number of files
ask for, so that no node has many children. Both replicas' digests of a node stand side by side in one row. The
audit compares the roots and goes down only into nodes that differ, to the records that are damaged, missing or
extra. Only digests are shuffled, never records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, small_batches, table, written

RANGE_BYTES, FAN_OUT = 64 << 10, 16
#: Pages in a WARC file that page_records makes.
FILE_PAGES = 1000
_END, _START = b"\r\n\r\n", "WARC/1."


def content_end(record: bytes) -> int | None:
    """Where a record ends that begins so, None if its header gives no length (or isn't whole yet)."""
    head = record.find(_END)
    for line in record[: max(head, 0)].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return head + 4 + int(value) + 4
    return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, record (binary) of every record of the WARC files under path; offsets of gzip files are those of the plain bytes.

    Spark's text reader cuts files where "WARC/1." stands, plain ones split by split, gzip ones as a stream. The
    pieces of a file are put in order and joined to records by the lengths that their headers give, one record in
    memory at a time. A record without a length, or cut short, ends where the next piece begins. file is the path below
    ``path``, so files of one name in several folders stay apart; no file gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, held, size, end = None, 0, [], 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["file", "offset", "record"])

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = piece.as_py()
                if name != file:
                    if size:
                        yield done()
                    file, at, held, size, end = name, 0, [], 0, None
                    if piece:  # what stands before the first record
                        held, size = [piece], len(piece)
                    continue
                piece = _START.encode() + piece
                if end is not None and size < end:  # the sign stands within the record
                    held.append(piece)
                    size += len(piece)
                else:
                    if size:
                        yield done()
                    at, held, size = at + size, [piece], len(piece)
                    end = content_end(piece)
        if size:
            yield done()
        release()

    pieces = small_batches(spark.read.option("recursiveFileLookup", True).option("lineSep", _START).text(path))
    whole = F.col("_metadata.file_path")
    below = F.when(F.contains(whole, F.lit(f"{path.rstrip('/')}/")), F.substring_index(whole, f"{path.rstrip('/')}/", -1)).otherwise(F.col("_metadata.file_name"))
    pieces = pieces.select(below.alias("file"), F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    return pieces.repartition("file").sortWithinPartitions("file", "split", "n").select("file", "piece").mapInArrow(run, "file string, offset long, record binary")


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 response record as a string; null url and body count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digests(records: DataFrame) -> DataFrame:
    """file, offset, length, digest of records with file, offset, record; a null record counts as empty."""
    record = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    return records.select("file", "offset", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """What differs between replicas a and b (file, offset, length, digest), and the trees' roots.

    First: file, offset, status (damaged, missing in b, extra in b), length_a, length_b, digest_a, digest_b, one
    row for each file and offset that differs. Second: one row with root_a, root_b. Rows that repeat file and
    offset in a replica are counted and hashed together. Rows with a null file or offset form a file and a range of
    their own. Empty replicas have null roots and equal each other. Other columns are not read.
    """
    both = a.select("file", "offset", "length", "digest", F.lit(False).alias("b")).unionByName(b.select("file", "offset", "length", "digest", F.lit(True).alias("b")))
    # Rows that repeat whole are counted first, so that what is gathered for a place are distinct digests only.
    rows = both.groupBy("file", "offset", "b", "length", "digest").agg(F.count("*").alias("n"))
    one = F.struct(F.col("digest"), F.when(F.col("n") > 1, F.col("n")).alias("n"))
    rows = rows.groupBy("file", "offset", "b").agg(F.sum(F.col("length") * F.col("n")).alias("length"), F.when((F.count("*") == 1) & (F.max("n") == 1), F.max("digest")).otherwise(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256)).alias("digest"))
    leaf = rows.groupBy("file", "offset").agg(*[F.max(F.when(F.col("b") == side, F.col(c))).alias(f"{c}_{s}") for s, side in (("a", False), ("b", True)) for c in ("length", "digest")])
    leaf = written(leaf.withColumn("name", F.sha2(F.coalesce(F.col("file"), F.lit("")), 256)), "fixity-records")
    files, longest = leaf.agg(F.count_distinct("name"), F.coalesce(F.max("offset"), F.lit(0))).first()
    ranges = [range_bytes]
    while longest // ranges[-1] >= fan_out:
        ranges.append(ranges[-1] * fan_out)
    digits = 0
    while files > fan_out * 16**digits:
        digits += 1
    # The keys of the levels from the records up; a level's order is that of its children.
    keys = [["name", "file", F.expr(f"offset DIV {r}").alias("place")] for r in ranges] + [["name", "file"]] + [[F.substring("name", 1, d).alias("name")] for d in range(digits, 0, -1)] + [[]]
    places = ["offset", *["place"] * len(ranges), "file", *["name"] * digits]
    levels = [leaf]
    for i, key in enumerate(keys):
        child = levels[-1]
        if 0 < i < len(ranges):
            key = ["name", "file", F.expr(f"place DIV {fan_out}").alias("place")]
        sums = [
            F.when(F.count(f"digest_{s}") > 0, F.sha2(F.to_json(F.array_sort(F.collect_list(F.when(F.col(f"digest_{s}").isNotNull(), F.struct(F.col(places[i]).alias("at"), F.col(f"digest_{s}").alias("digest")))))), 256)).alias(f"digest_{s}")
            for s in "ab"
        ]
        levels.append(written((child.groupBy(*key) if key else child).agg(*sums), "fixity-nodes"))
    root = levels.pop()
    differ = ~F.col("digest_a").eqNullSafe(F.col("digest_b"))
    down = root.where(differ)
    if down.isEmpty():
        levels = [x.limit(0) for x in levels]
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        if keys[i]:  # the level's parents by the keys that they are grouped by
            up = [F.col("x.name").eqNullSafe(F.col("y.name"))] if i > len(ranges) else [F.col("x.name") == F.col("y.name"), F.col("x.file").eqNullSafe(F.col("y.file"))]
            if i > len(ranges):
                up = [F.substring("x.name", 1, digits - (i - len(ranges) - 1)) == F.col("y.name")]
            elif i < len(ranges):
                up.append((F.expr(f"x.offset DIV {range_bytes}") if i == 0 else F.expr(f"x.place DIV {fan_out}")).eqNullSafe(F.col("y.place")))
            test = up[0]
            for t in up[1:]:
                test = test & t
            level = level.alias("x").join(down.alias("y"), test, "left_semi")
        down = level.where(differ)
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("damaged")
    return down.select("file", "offset", status.alias("status"), "length_a", "length_b", "digest_a", "digest_b"), root.select(F.col("digest_a").alias("root_a"), F.col("digest_b").alias("root_b"))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, url, record, length, digest: pages as WARC records. Null ids, urls and bodies count as empty; repeated rows each give one; other columns are not read."""
    made = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), warc_record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("record"))
    return made.select("*", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def placed(records: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """page_id, digest, length, n, file, start: where records (page_id, length, digest) stand in WARC files that hold file_pages consecutive ids each, in order of id and digest.

    Records that repeat are one row with their number n, the first of them at start. Null ids have files of their
    own, by the digest. Running sums go by (file, id, first digits of the digest) and then over these parts of a
    file, so that neither one id nor one record with a third of all rows is sorted in one task.
    """
    once = records.groupBy("page_id", "length", "digest").agg(F.count("*").alias("n")).withColumn("part", F.substring("digest", 1, 2))
    number = F.coalesce(F.expr(f"lpad(CAST(page_id DIV {file_pages} AS STRING), 8, '0')"), F.concat(F.lit("none-"), F.substring("digest", 1, 4)))
    once = written(once.withColumn("file", F.concat(F.lit("pages-"), number, F.lit(".warc"))), "fixity-placed")
    parts = once.groupBy("file", "page_id", "part").agg(F.sum(F.col("length") * F.col("n")).alias("bytes"))
    before = Window.partitionBy("file").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", F.col("page_id").alias("p"), F.col("part").alias("q"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "page_id", "part").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    own = once.withColumn("own", F.coalesce(F.sum(F.col("length") * F.col("n")).over(within), F.lit(0)))
    joined = own.alias("o").join(parts.alias("t"), (F.col("o.file") == F.col("t.file")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("part") == F.col("q")))
    return joined.select("page_id", "digest", "length", "n", "o.file", (F.col("own") + F.col("base")).alias("start"))


def op10_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages' records, written as a table of its own with planted damage and read again: by the MD5 of the url one record in 16 has a byte too many and one in 256 is missing."""
    records = page_records(table(spark, sf_dir, "pages"))
    code = F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary"))
    copy = records.where(F.substring(code, 1, 2) != "ff").select("page_id", F.col("digest").alias("was"), F.when(F.substring(code, 1, 1) == "0", F.concat("record", F.lit("~"))).otherwise(F.col("record")).alias("record"))
    replica = written(copy, "fixity-replica").groupBy("page_id", "was", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")).agg(F.count("*").alias("n"))
    index = written(placed(records), "fixity-index")
    each = lambda rows: rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    original = each(index).select("file", (F.col("start") + F.col("i") * F.col("length")).alias("offset"), "length", "digest")
    x, y = index.alias("x"), replica.alias("y")
    there = x.join(y, F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.digest") == F.col("y.was"))).select("file", "start", F.col("x.length").alias("step"), "y.length", "y.digest", "y.n")
    other = each(there).select("file", (F.col("start") + F.col("i") * F.col("step")).alias("offset"), "length", "digest")
    found, _ = audit(original, other)
    ids = each(index).select("page_id", "file", (F.col("start") + F.col("i") * F.col("length")).alias("offset"))
    return found.join(ids, ["file", "offset"]).select("page_id", "file", "offset", "status", "length_a", "length_b", "digest_a", "digest_b")


ORACLE = r"""
WITH r AS (
  SELECT page_id, url, 'pages-' || lpad(CAST(page_id // 1000 AS VARCHAR), 8, '0') || '.warc' AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(coalesce(url, '')) AS code FROM r)
SELECT page_id, file, "offset", CASE WHEN code[1:2] = 'ff' THEN 'missing' ELSE 'damaged' END AS status,
  strlen(record) AS length_a, CASE WHEN code[1:2] = 'ff' THEN NULL ELSE strlen(record) + 1 END AS length_b,
  sha256(record) AS digest_a, CASE WHEN code[1:2] = 'ff' THEN NULL ELSE sha256(record || '~') END AS digest_b
FROM o WHERE code[1:2] = 'ff' OR code[1:1] = '0'
"""

QUERIES = {"op10_warc_merkle_audit": op10_warc_merkle_audit}
ORACLES = {"op10_warc_merkle_audit": ORACLE}
