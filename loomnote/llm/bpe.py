"""BPE encoding and decoding through a distinct-word table.

Texts are split at ASCII white space, over which no token of the given tokenizers reaches, and, if the tokenizer
proves to treat both alike, lower-cased and split where letters meet common signs. The documents of a
scan partition form blocks of bounded size; a block's words become codes into the block's own word list. The
word lists of all blocks are shuffled by word (and by range of scan partitions, so that a word that every block has
does not go to one task), so that equal words stand together and each distinct word is encoded once. Its ids are
joined with the table of the vocabulary's pieces, which gives its decoded form; both go back to the blocks by (block,
position in the list), and there every document's codes become ids and pieces. Texts and occurrences of words are
never shuffled: a frequent word costs a row for each block, and a document's codes travel compressed.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 1 << 20
#: Words that an encoding task holds before it packs them by block, and that a block's documents are made of at once.
PACK_WORDS, CHUNK_WORDS = 150_000, 1 << 17
#: Scan partitions (a power of two of them) whose blocks share one encoding of a word.
SHARE_BITS = 8
_LETTER = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"  # without U+0130, whose lower case ends in a mark
_SIGNS = ',.!?;:%&*#$()"'


def words(texts: pa.Array, cut: bool) -> pa.Array:
    """The list of words of each text. cut: also in lower case (A-Z) and apart from signs, but for texts with combining marks or strings of special tokens, where that could change the ids."""
    if cut:
        odd = pc.match_substring_regex(texts, r"\pM|<\|")
        low = pc.replace_substring_regex(pc.ascii_lower(texts), f"({_LETTER})([{_SIGNS}])", r"\1 \2")
        texts = pc.if_else(odd, texts, pc.replace_substring_regex(low, f"([{_SIGNS}])({_LETTER})", r"\1 \2"))
    return pc.ascii_split_whitespace(texts)


def may_cut(model) -> bool:
    """Whether a tokenizer gives the same ids for lower-cased words apart from signs."""
    ids = lambda t: model.encode(t, add_special_tokens=False).ids
    return all(ids(f"Ab{s}cD{s}{s}é9{s}") == ids(f"ab {s} cd {s}{s} é9 {s}") for s in _SIGNS)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, if there are many of them as four planes of bytes, compressed."""
    raw = numbers.astype("<u4")
    return raw.tobytes() if len(raw) < 64 else pa.Codec("zstd", 3).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if n < 64:
        return np.frombuffer(packed, "<u4")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _squeezed(data: bytes) -> bytes:
    """The number of bytes, and the bytes compressed."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _spread(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True) if n else b""


def _blocks(docs: DataFrame, block_bytes: int, cut: bool, listed: bool) -> DataFrame:
    """block and its word list (listed), or its ids, number of words per document and compressed codes."""
    id_type = docs.schema["id"].dataType.simpleString()

    def emit(block: int, ids: list[pa.Array], counts: list[pa.Array], parts: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.chunked_array(parts).unify_dictionaries()
        each = coded.chunk(0).dictionary
        if listed:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(each)], each)], ["block", "words"])
        own = pa.concat_arrays(ids)
        codes = _packed(np.concatenate([c.indices.to_numpy() for c in coded.chunks]))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.ListArray.from_arrays([0, len(own)], pa.concat_arrays(counts)), pa.array([codes], pa.binary()), pa.array([len(coded)], pa.int64()), pa.array([len(each)], pa.int64())],
            ["block", "ids", "counts", "codes", "n", "n_words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, 0
        ids, counts, parts = [], [], []
        for batch in batches:
            if block is None and len(batch):
                block = batch.column(2)[0].as_py() << 32
            sizes, start, since = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), 0, 0
            for i, size in enumerate(sizes.tolist(), 1):
                held, since = held + size, since + size
                if held >= block_bytes or since >= SPLIT_BYTES or i == len(sizes):
                    split = words(pc.fill_null(batch.column(1).slice(start, i - start), ""), cut)
                    parts.append(split.flatten().dictionary_encode())
                    counts.append(pc.list_value_length(split))
                    ids.append(batch.column(0).slice(start, i - start))
                    start, since = i, 0
                if held >= block_bytes:
                    yield emit(block, ids, counts, parts)
                    block, held = block + 1, 0
                    ids, counts, parts = [], [], []
        if ids:
            yield emit(block, ids, counts, parts)

    # The scan's own partition number, which stays the same whatever the scan is part of.
    docs = docs.select("id", "text", F.spark_partition_id().alias("part"))
    return docs.mapInArrow(tidy(run), "block long, words array<string>" if listed else f"block long, ids array<{id_type}>, counts array<int>, codes binary, n long, n_words long")


def _encoded(words: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct words, a row for each id in order (one without id if there is none): first, id, and in a word's first row the blocks and the positions in their lists that have it.

    words: block, pos, word, equal words next to each other, so that each is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model, known = None, {}
        for batch in batches:
            if not len(batch):
                continue
            model = model or _plain(Tokenizer.from_str(tokenizer))
            coded = batch.column(2).dictionary_encode()
            each, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()  # in order, as equal words are next to each other
            new = [w for w in each if w not in known]
            known.update(zip(new, (e.ids for e in model.encode_batch(new, add_special_tokens=False)), strict=True))
            ids = [known[w] or [None] for w in each]
            known = {each[-1]: known[each[-1]]}  # goes on in the next batch
            size = np.array([len(x) for x in ids])
            start = np.cumsum(size) - size
            first = np.zeros(int(size.sum()), bool)
            first[start] = True
            lists = np.zeros(len(first) + 1, np.int32)
            lists[start + 1] = np.bincount(at, minlength=len(each))
            lists = pa.array(np.cumsum(lists, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array([i for x in ids for i in x], pa.int32()), pa.ListArray.from_arrays(lists, batch.column(0)), pa.ListArray.from_arrays(lists, batch.column(1))], ["first", "id", "blocks", "places"])

    return words.mapInArrow(tidy(run), "first boolean, id int, blocks array<long>, places array<int>")


def _packed_by_block(coded: DataFrame, width: str) -> DataFrame:
    """block, m, at, sizes, code, lengths, decoded: of m words of a block their places in its list, numbers of ids, ids one after the other, and their decoded forms.

    coded: first, id, blocks, places as of _encoded, with the ids' pieces.
    """

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t.column(name).chunk(0)
        starts = np.nonzero(column("first").to_numpy(zero_copy_only=False))[0]
        ends = np.append(starts[1:], len(t))
        there = column("id").is_valid().to_numpy(zero_copy_only=False)
        size = np.where(there[starts], ends - starts, 0)
        ids = column("id").fill_null(0).to_numpy().astype(width)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(t)), pa.int32()), pc.fill_null(column("piece"), "")), " ")
        blocks, places = column("blocks").flatten().to_numpy(), column("places").flatten().to_numpy()
        word = np.repeat(np.arange(len(starts)), pc.list_value_length(column("blocks")).to_numpy()[starts])
        order = np.argsort(blocks, kind="stable")
        blocks, places, word = blocks[order], places[order], word[order]
        own, text = size[word], text.take(pa.array(word))
        ids = ids[np.repeat(starts[word] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        upto, chars, data = np.append(0, np.cumsum(own)), np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1], text.buffers()[2]
        cuts = np.append(0, np.append(np.nonzero(np.diff(blocks))[0] + 1, len(blocks))).tolist()
        rows = [
            (int(blocks[a]), z - a, _packed(places[a:z]), _packed(own[a:z]), ids[upto[a] : upto[z]].tobytes(), _packed(np.diff(chars[a : z + 1])), _squeezed(data[int(chars[a]) : int(chars[z])].to_pybytes() if data else b""))
            for a, z in zip(cuts, cuts[1:], strict=False)
        ]
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "m", "at", "sizes", "code", "lengths", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.nonzero(batch.column(0).to_numpy(zero_copy_only=False))[0]
            if n >= PACK_WORDS and len(starts):  # a pack ends before a word
                held.append(batch.slice(0, int(starts[0])))
                yield pack(held)
                batch, held, n = batch.slice(int(starts[0])), [], 0
            held.append(batch)
            n += len(batch.column(2).flatten())
        if held and sum(map(len, held)):
            yield pack(held)

    return coded.select("first", "id", "blocks", "places", "piece").mapInArrow(tidy(run), "block long, m long, at binary, sizes binary, code binary, lengths binary, decoded binary")


def _plain(model):
    model.no_truncation()
    model.no_padding()
    return model


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """One row per row of docs: id, ids (array<int>) and decoded, equal to what the tokenizers library gives for the whole text.

    then: a function of the batches of id, ids and decoded that runs in the same task, and the types of what it
    gives besides id; so that what is derived from ids need not move them.

    tokenizer_path: a JSON file of the tokenizers library whose pre-tokenizer splits at white space and which has
    no decoder, so that decoding joins the pieces with one space. Null texts count as empty and give no ids;
    strings of special tokens in a text become those tokens, as in the library. Repeated rows each give a row; an
    empty table gives an empty result; other columns are not read. docs must give the same rows whenever it is read
    (a table, not a random sample).
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    model = _plain(Tokenizer.from_str(tokenizer))
    vocabulary, cut = model.get_vocab(with_added_tokens=True), may_cut(model)
    width = "<u2" if max(vocabulary.values(), default=0) < 65536 else "<u4"

    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType
    listed = _blocks(docs, block_bytes, cut, True).select("block", F.posexplode("words").alias("pos", "word"))
    listed = listed.repartition("word", F.shiftright("block", 32 + SHARE_BITS)).sortWithinPartitions("word")
    # The table of pieces has the vocabulary's size, whatever the data; a broadcast join keeps the order of the words' ids.
    pieces = docs.sparkSession.createDataFrame(sorted((i, piece) for piece, i in vocabulary.items()), "id int, piece string")
    sent = _packed_by_block(_encoded(listed, tokenizer).join(F.broadcast(pieces), "id", "left"), width)
    coded = _blocks(docs, block_bytes, cut, False)
    both = sent.unionByName(coded, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("n").asc_nulls_first())

    def finish(held: list[tuple], batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        get = lambda name: batch.column(name)[i]
        if sum(h[0] for h in held) != get("n_words").as_py():
            raise ValueError("the documents changed while they were being encoded")
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        at, sizes, lengths = (join([_unpacked(h[k], h[0]) for h in held], "<u4").astype(np.int64) for k in (1, 2, 4))
        every, order = join([np.frombuffer(h[3], width) for h in held], width).astype(np.int32), np.argsort(at)
        begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(b"".join([_spread(h[5]) for h in held]))).take(pa.array(order))
        held.clear()
        codes = _unpacked(get("codes").as_py(), get("n").as_py())
        own, counts = batch.column("ids")[i].values, get("counts").values.to_numpy()
        ends = np.cumsum(counts, dtype=np.int64)
        a = 0
        while a < len(counts):
            base = int(ends[a] - counts[a])
            z = max(a + 1, int(np.searchsorted(ends, base + CHUNK_WORDS, "right")))
            c = codes[base : int(ends[z - 1])].astype(np.int64)
            s = sizes[c]
            upto = np.append(0, np.cumsum(s > 0))[np.append(0, ends[a:z] - base)]
            c, s = c[s > 0], s[s > 0]
            ids = every[np.repeat(begin[c] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
            offsets = np.append(0, np.cumsum(s))[upto]
            shown = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto), text.take(pa.array(c))), pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays([own.slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), shown.cast(pa.string())], ["id", "ids", "decoded"])
            a = z

    derive, given = then or ((lambda batch: batch), "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                if batch.column("n")[i].is_valid:  # a block, after its words
                    yield from map(derive, finish(held, batch, i))
                    held = []
                else:
                    held.append(tuple(batch.column(c)[i].as_py() for c in ("m", "at", "sizes", "code", "lengths", "decoded")))

    return both.mapInArrow(tidy(run), f"id {id_type.simpleString()}, {given}").withColumnRenamed("id", id_col)


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("ids")
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string())), " ")
    sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column])
    return pa.RecordBatch.from_arrays([batch.column("id"), pc.cast(pc.list_value_length(ids), pa.int64()), sha(joined), sha(batch.column("decoded"))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


#: Number of tokens, and digests of the decimal ids joined by one space and of the decoded text.
DIGESTS = (_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = _digests(batch)
    return pa.RecordBatch.from_arrays([*made.columns, batch.column("ids")], [*made.schema.names, "ids"])


#: As DIGESTS, and the ids themselves.
ENCODED = (_with_ids, DIGESTS[1] + ", ids array<int>")


def op5_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), then=DIGESTS)


QUERIES = {"op5_bpe_word_table": op5_bpe_word_table}
ORACLES: dict[str, str] = {}
