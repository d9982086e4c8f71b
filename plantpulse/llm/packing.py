"""Packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.session import staged

CAPACITY = 2048
OPEN_BINS = 4096
# tokens that one packing task places; a task holds the ids' lengths only, never the ids
TOKENS_PER_TASK = 1 << 25
# words kept in each of two generations
CACHE_WORDS = 200_000

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
LETTERS = re.compile(r"[^\W\d_]+")


class Memo:
    """Results of a function; two generations bound the memory and keep what is in use."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class WordTokens:
    """Token ids of a text, word by word, as little-endian unsigned 32-bit bytes.

    The vocabulary's rules never look across white space, so the ids of a text are the ids of its
    words, and each word is encoded once per worker while it is in use. Most words are letters
    followed by marks; such a word is lower-cased and cut as the vocabulary's rules would, and its two
    parts go to the library's model. Every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the letters that stand for bytes, as the library writes them
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {b: letters.pre_tokenize_str(chr(b))[0][0] for b in range(33, 128)}
        for b in range(0x80, 0x800, 0x40):
            pair = chr(b).encode()
            self.bytes[pair[0]] = letters.pre_tokenize_str(chr(b))[0][0][0]
        for b in range(0x80, 0xC0):
            self.bytes[b] = letters.pre_tokenize_str(chr(b))[0][0][1]
        for b in (0x800, *range(0x1000, 0x10000, 0x1000)):
            if b != 0xD000:
                self.bytes[chr(b).encode()[0]] = letters.pre_tokenize_str(chr(b))[0][0][0]
        self.word, self.part = Memo(self._word, limit), Memo(self._part, 2 * limit)

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _part(self, text: str) -> bytes:
        spelled = text.encode().decode("latin-1").translate(self.bytes)
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        letters = LETTERS.match(text)
        end = letters.end() if letters else 0
        head, tail = text[:end].lower(), text[end:]
        # without digits, apostrophes, special tokens and control characters the marks are one part; the letters must be
        # in normal form, within the first plane and free of the sigma, whose lower case depends on its place
        simple = head.isalpha() and (not tail or tail.isascii() and tail.isprintable() and not any(
            c.isalnum() or c in "'<" for c in tail))
        if simple and not head.isascii():
            simple = max(head) < "\ud000" and "σ" not in head and "ς" not in head and unicodedata.is_normalized(
                "NFC", text[:end])
        if not simple:
            return self.encoded(text)
        return self.part(head) + (self.part(tail) if tail else b"")

    def ids(self, text: str) -> bytes:
        word, encode = self.word, self._word
        return b"".join([word(w) if len(w) <= 64 else encode(w) for w in text.encode("utf-8", "replace").split()])


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by id 0; a missing text counts as empty. Only documents longer than
    `capacity` are cut, into pieces of `capacity` ids and a last shorter one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema, step = PIECES.format(id=id_type), 4 * capacity
    # a worker process keeps the broadcast dictionary, and so its memory of words, from task to task; it is sent
    # empty, since what is broadcast must hold no class that an executor cannot import
    shared = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in shared.value:
            shared.value[tokenizer] = WordTokens(tokenizer)
        tokens = shared.value[tokenizer]
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenBins:
    """A fixed number of open bins. Bit f of `free` is set while some open bin has f free places."""

    def __init__(self, capacity: int, most: int):
        self.most, self.open, self.made, self.free = most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item: the open bin with least room that fits, else a new one."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.capacity, self.made
            self.made += 1
        rest = room - length
        if rest:
            if self.open == self.most:  # the fullest open bin closes
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.open += 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.open -= 1
        return number


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces (any table with doc_id, piece and length).

    Pieces are dealt by a hash of their id to as many tasks as their tokens need, ordered by another
    hash, and placed one after the other by bounded-space best-fit: the piece goes to the open bin
    with least room that holds it; without one it opens a bin, and beyond `open_bins` open bins the
    fullest closes. A task's memory is its open bins; its pieces stream through. Task and order
    follow from the rows alone, so a repeated task numbers its sequences alike.
    """
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // tokens_per_task))
    schema = pieces.schema.simpleString()[len("struct<"):-1] + ",sequence_id:bigint,offset:bigint"
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), None
        for batch in batches:
            if base is None and batch.num_rows:
                base = batch.column(batch.num_columns - 1)[0].as_py() << 40
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            numbers = pa.array([base + number for number, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, numbers, offsets], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    task = F.pmod(F.xxhash64(F.lit("task"), "doc_id", "piece"), F.lit(tasks))
    order = F.xxhash64(F.lit("order"), "doc_id", "piece")
    dealt = pieces.withColumn("__task", task).repartition(tasks, "__task")
    dealt = dealt.sortWithinPartitions(order, *names).withColumn("__part", F.spark_partition_id())
    return dealt.drop("__task").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Best-fit packing of whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of length 1 (id 0). Repeated rows are packed each on its own;
    a missing doc_id is kept. Other columns are not read. An empty table gives no rows. The pieces are
    staged, so that every text is tokenised once, however often a packing task is repeated.
    """
    return pack(staged(tokenize(docs, tokenizer, capacity), "pieces"), capacity, open_bins)
