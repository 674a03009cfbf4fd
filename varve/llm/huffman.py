"""Token ids in canonical length-limited Huffman code: independent blocks, bit-offset checkpoints, table decoding.

A written corpus is a folder with the code (the length of each id's code and the length limit, one
row) and ``chunks``, Parquet files ``part=N`` in ascending doc_id order. A row is a chunk of whole
documents: its number in the part, doc_ids, tokens per document, the code bits as big-endian 32-bit
words, and the bit offset of every block of ``BLOCK`` ids, from which blocks decode alone.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.llm.memory import Ragged, WordMemory
from varve.session import checkpoint_dir, checkpointed, ship

BLOCK = 512
CHUNK = 1 << 18
MAX_BITS = 16
_TEXT_STEP, _TOGETHER = 1 << 20, 500
# words of these letters only, without the marks that special tokens begin with, and the parts that end a word in them
_LATIN = re.compile(r"[!-;=-\u024f]+").fullmatch
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

_CHUNK_ROW = "part int, seq int, doc_ids binary, sizes binary, ids binary"
_CODE = "lengths binary, limit_bits int"
_CODE_ROW = "part int, seq int, doc_ids binary, sizes binary, bits binary, offsets binary"


# --- tokenizing ---------------------------------------------------------------------------------


_RUN_OF_MARKS = re.compile(r"[^A-Za-z0-9\sÀ-ÖØ-öø-ÿ][.,] ")


def _words(text: str) -> list[str]:
    """Blank-separated words that together have the text's ids: the tokenizer drops blanks and lower-cases letters, too."""
    text = text.replace("\n", " ")
    if "<|" in text:  # special tokens are found in the text as it is
        return text.split(" ")
    try:
        text.encode("latin-1")  # no marks that combine with letters, and lower case by single letters
        text = text.lower()
    except UnicodeEncodeError:
        pass
    if not _RUN_OF_MARKS.search(text):  # each mark before a blank is a part of its own
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


class WordIds(WordMemory):
    """Ids of blank-separated words, remembered by use; a blank, which no word holds, stands for the end mark.

    The tokenizer drops white space, and none of its steps looks across a blank, so the ids of a text
    are those of its words.
    """

    def __init__(self, path: str, end_id: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.ids = Tokenizer.from_file(path), end_id, Ragged(np.uint32)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with its end mark, and the number of ids of each."""
        words, firsts = [], []
        for text in texts:
            firsts.append(len(words))
            words += _words(text or "")
            words.append(" ")
        stay = self.forget()
        if stay is not None:
            self.ids.kept(stay)
        at = self.numbers(words)
        if self.fresh:
            self.ids.append(*self._worked_out(self.fresh))
            self.fresh = []
        ids, size = self.ids.rows(at)
        return ids, np.add.reduceat(size, firsts)

    def _worked_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and their numbers: Latin ones many in one text, told apart by their ends of word; others one by one."""
        n = len(words)
        ends = np.fromiter((len(_PARTS(w.lower())) if _LATIN(w) else 0 for w in words), np.int64, n)
        size, parts = np.zeros(n, np.int64), []
        together, apart = np.flatnonzero(ends), []
        for at in np.array_split(together, -(-len(together) // _TOGETHER)) if len(together) else []:
            ids = np.array(self._ids([" ".join(map(words.__getitem__, at.tolist()))])[0], np.uint32)
            closing = np.flatnonzero(self.closes[ids]) + 1
            if len(closing) != ends[at].sum():  # some word has other parts than foreseen
                apart += at.tolist()
                continue
            cut = closing[np.cumsum(ends[at]) - 1]
            size[at] = np.diff(cut, prepend=0)
            parts.append((at, ids))
        apart = np.sort(np.r_[np.array(apart, np.int64), np.flatnonzero(ends == 0)])
        if len(apart):
            found = [[self.end_id] if words[i] == " " else ids for i, ids in zip(apart.tolist(), self._ids(list(map(words.__getitem__, apart.tolist()))))]
            size[apart] = list(map(len, found))
            parts.append((apart, np.fromiter((i for ids in found for i in ids), np.uint32, int(size[apart].sum()))))
        begin, flat = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint32)
        for at, ids in parts:
            own = size[at]
            flat[np.repeat(begin[at] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return flat, size

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[tuple[str, int], WordIds] = {}


def _encoder(path: str, end_id: int) -> WordIds:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordIds(path, end_id)
    return _encoders[path, end_id]


def _text_steps(batches):
    """(doc_ids, texts) of about _TEXT_STEP characters, whatever the batches hold."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)))
        begin = 0
        while begin < len(texts):
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + _TEXT_STEP, "right")))
            yield keys.slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist()
            begin = end


def token_chunks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Documents in doc_id order as chunks of ids; rows of equal doc_id follow the crc32 of their text."""
    spark = ship(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.crc32(F.coalesce("text", F.lit("")))
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path, end_id)
        keys, sizes, ids, held = [], [], [], 0

        def row():
            raw = pa.concat_arrays(keys)
            named = np.asarray(pa.compute.fill_null(raw, -(1 << 63))).astype("<i8")
            cells = [[part], [seq], [named.tobytes()], [np.concatenate(sizes).astype("<u4").tobytes()], [np.concatenate(ids).astype("<u4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "seq", "doc_ids", "sizes", "ids"])

        for key, texts in _text_steps(batches):
            found, size = encoder.encode(texts)
            keys.append(key), sizes.append(size), ids.append(found)
            held += len(found)
            if held >= CHUNK:
                yield row()
                seq, keys, sizes, ids, held = seq + 1, [], [], [], 0
        if keys:
            yield row()

    return ordered.mapInArrow(run, _CHUNK_ROW)


# --- the code -----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        is_leaf.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for mask in reversed(is_leaf):
        mine = int(mask[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each one more than the last, shifted where lengths grow."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        left = np.cumsum(1 << (top - size)) - (1 << (top - size))  # codes as top-bit numbers
        codes[order] = (left >> (top - size)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next ``bits`` bits."""
    codes, symbols = canonical_codes(lengths), np.flatnonzero(lengths)
    symbol, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    order = symbols[np.argsort(codes[symbols] << (bits - lengths[symbols].astype(np.uint64)), kind="stable")]
    spread = 1 << (bits - lengths[order].astype(np.int64))
    symbol[: int(spread.sum())] = np.repeat(order, spread)
    size[: int(spread.sum())] = np.repeat(lengths[order], spread)
    return symbol, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of the ids as big-endian 32-bit words, and the bit at which each block starts."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    word = begin >> 5
    placed = codes[ids] << (64 - (begin & 31) - size).astype(np.uint64)
    words = np.zeros((int(ends[-1]) >> 5) + 3, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])  # codes are under 32 bits: one starts in every word
    at = word[first]
    words[at] += np.add.reduceat(placed >> np.uint64(32), first)
    words[at + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), begin[::BLOCK]


def unpack_bits(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Decode all blocks side by side, one id of each per step."""
    symbol, size = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at, out = offsets.astype(np.int64), np.empty((BLOCK, len(offsets)), np.uint32)
    mask, last = np.uint64((1 << width) - 1), len(pairs) - 1
    for step in range(min(BLOCK, n)):
        window = (pairs[np.minimum(at >> 5, last)] >> (64 - width - (at & 31)).astype(np.uint64)) & mask
        window = window.astype(np.int64)
        out[step] = symbol[window]
        at += size[window]
    return out.T.reshape(-1)[:n]


def token_counts(chunks: DataFrame, vocabulary: int) -> np.ndarray:
    """Global counts by id: a sum within each task, then over tasks; at most one row per id reaches the driver."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), "<u4"), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in chunks.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, limit: int = MAX_BITS) -> None:
    """Encode whole texts and write them to ``path``, with all that a reader needs.

    Null and empty texts are the end id alone; rows with equal doc_id are kept, each a document; a
    null doc_id sorts first and is read back as null; no rows write no chunks; other columns are ignored.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    chunks = checkpointed(token_chunks(docs, tokenizer_path, end_id))
    counts = token_counts(chunks, vocabulary)
    limit = max(limit, int(np.count_nonzero(counts)).bit_length())
    if limit > 31:
        raise ValueError("codes must stay under 32 bits")
    lengths = code_lengths(counts, limit)
    packed_lengths = zlib.compress(lengths.tobytes())

    def run(batches):
        size = np.frombuffer(zlib.decompress(packed_lengths), np.uint8)
        codes = canonical_codes(size)
        for batch in batches:
            for part, seq, keys, sizes, ids in zip(*[c.to_pylist() for c in batch.columns]):
                bits, offsets = pack_bits(np.frombuffer(ids, "<u4"), codes, size)
                cells = [[part], [seq], [keys], [sizes], [bits], [offsets.astype("<u8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "seq", "doc_ids", "sizes", "bits", "offsets"])

    coded = chunks.mapInArrow(run, _CODE_ROW).sortWithinPartitions("part", "seq")
    coded.write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/chunks")
    docs.sparkSession.createDataFrame([(bytearray(packed_lengths), limit)], _CODE).coalesce(1).write.parquet(f"{path}/code")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' decoded ids."""
    ship(spark)
    stored = spark.read.schema("seq int, doc_ids binary, sizes binary, bits binary, offsets binary, part int").parquet(f"{path}/chunks")
    code = spark.read.schema(_CODE).parquet(f"{path}/code").first()  # one row, a byte for each id of the vocabulary before compression
    packed_lengths, limit = bytes(code.lengths), code.limit_bits

    def run(batches):
        table = decode_table(np.frombuffer(zlib.decompress(packed_lengths), np.uint8), limit)
        for batch in batches:
            for part, seq, keys, sizes, bits, offsets in zip(*[c.to_pylist() for c in batch.columns]):
                keys, sizes = np.frombuffer(keys, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                ids = memoryview(unpack_bits(bits, np.frombuffer(offsets, "<u8"), int(ends[-1]), table, limit).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(keys)
                named = pa.array(keys, mask=keys == -(1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), named, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                )

    rows = stored.select("part", "seq", "doc_ids", "sizes", "bits", "offsets").mapInArrow(run, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    rows = checkpointed(rows)
    chunks = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("_n"))
    parts = chunks.groupBy("part").agg(F.sum("_n").alias("_n"))  # a row per written part
    before = Window.partitionBy(F.lit(0)).orderBy("part")
    parts = parts.select("part", (F.sum("_n").over(before) - F.col("_n")).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = chunks.withColumn("_start", F.sum("_n").over(inside) - F.col("_n")).drop("_n").join(parts, "part")
    placed = rows.join(starts, ["part", "seq"])
    return placed.select("doc_id", (F.col("_part_start") + F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def scratch_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
