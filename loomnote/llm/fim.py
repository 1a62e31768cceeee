"""Fill-in-middle by in-place block rotation.

A text is cut after two of its lines, the three sentinels are inserted in a bytearray as ``<P>prefix<M>middle<S>suffix``,
and one rotation by three reversals gives either form: the part from ``<M>`` on rotated at ``<S>`` is psm
(``<P>prefix<S>suffix<M>middle``), the whole rotated at ``<S>`` is spm (``<S>suffix<P>prefix<M>middle``). The inverse
finds the sentinels, rotates back and takes them out again. Texts that hold a sentinel stay plain, so the first of each
kind in an output is the one inserted: none can arise across a seam, as each begins with the only ``<`` that it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import lean, release, small_batches, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Documents of a hundred that are transformed, those of a hundred of them that become spm, and what the hash of an id begins with.
RATE, SPM, SEED = 100, 50, 7


def rotate(buf: bytearray, start: int, mid: int, end: int) -> None:
    """Exchanges buf[start:mid] and buf[mid:end] in place: each reversed, then both together."""
    for a, z in ((start, mid), (mid, end), (start, end)):
        buf[a:z] = buf[a:z][::-1]


def transformed(text: bytes, doc_id: int | None, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle (null if plain) and output of one text in UTF-8."""
    codes = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(codes == 10) + 1
    if len(text) and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    if not n or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    i, j = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    buf = bytearray(text)
    for at, sentinel in ((j, SUFFIX), (i, MIDDLE), (0, PREFIX)):
        buf[at:at] = sentinel
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(buf, 0 if form == "spm" else i + len(PREFIX), j + len(PREFIX) + len(MIDDLE), len(buf))
    points = lambda part: int(np.count_nonzero(part & 0xC0 != 0x80))
    return n, form, points(codes[:i]), points(codes[i:j]), bytes(buf)


def inverse(output: bytes, form: str) -> bytes:
    """The text that gave an output of that form."""
    if form == "plain":
        return output
    buf = bytearray(output)
    start, mid = (0, buf.find(PREFIX)) if form == "spm" else ((s := buf.find(SUFFIX)), buf.find(MIDDLE, s))
    rotate(buf, start, mid, len(buf))
    for sentinel in (PREFIX, MIDDLE, SUFFIX):
        at = buf.find(sentinel)
        del buf[at : at + len(sentinel)]
    return bytes(buf)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Null texts count as empty, and empty ones are plain; a null id hashes like an empty one; repeated rows each give a
    row; an empty table gives an empty result. Whole texts of any length; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            made = [transformed(x.as_buffer().to_pybytes() if x.is_valid else b"", d, rate, spm, seed) for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else [()] * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


@F.arrow_udf(StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The exact texts that outputs were made of, as a column."""
    return pa.array([inverse(x.as_buffer().to_pybytes(), f) for x, f in zip(output, form.to_pylist(), strict=True)], pa.binary()).cast(pa.string())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
lines AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, len(regexp_extract_all(t, '[^\n]*\n|[^\n]+')) AS n,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": ORACLE}
