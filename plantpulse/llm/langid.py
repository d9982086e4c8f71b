"""Language identification: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import hash_unit, key_text

# labelled rows that are learned from, for each language (more are thinned by a hash of the id)
SAMPLE_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 250
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# cost of a change of language between two words, in nats
SWITCH = 8.0
# a language is a candidate for a script in which at least this share of its letters is written
SCRIPT_SHARE = 0.001
EXCLUDED = 1e4
SLICE_CHARS = 1 << 20
UNDETERMINED = "und"

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x34000)],
}
OTHER = len(SCRIPTS)


@dataclass(frozen=True)
class Alphabet:
    """Of every code point up to the last letter: part of a word, a letter, its lower case, its script."""

    word: np.ndarray
    letter: np.ndarray
    lower: np.ndarray
    script: np.ndarray


def alphabet() -> Alphabet:
    """The planes of letters; the last entry stands for all code points beyond and is none."""
    size = 0x34001
    word, letter, lower = np.zeros(size, bool), np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for c in range(size - 1):
        kind = unicodedata.category(chr(c))
        word[c], letter[c] = kind[0] in "LM", kind[0] == "L"
        small = chr(c).lower() if kind == "Lu" else ""
        if len(small) == 1:
            lower[c] = ord(small)
    script = np.full(size, OTHER, np.uint8)
    for i, blocks in enumerate(SCRIPTS.values()):
        for first, last in blocks:
            script[first:last + 1] = i
    return Alphabet(word, letter, lower, script)


@dataclass(frozen=True)
class Words:
    """Lower-cased code points of several rows, and the borders, row, script and letters of their words."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    offset: np.ndarray  # first code point of each row


def words_of(texts: list[str], letters: Alphabet) -> Words:
    """Words are runs of letters and marks; everything else becomes a space."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")
    low = np.minimum(points, len(letters.word) - 1)
    word = letters.word[low]
    clean = np.where(word, letters.lower[low], 32).astype(np.uint32)
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.cumsum(sizes + 1) - sizes
    sums = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letters.letter[low], out=sums[1:])
    row = np.searchsorted(offset, starts, "right") - 1
    return Words(clean, starts, ends, row, letters.script[low[starts]], sums[ends] - sums[starts], offset)


def buckets(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n code points from each place on."""
    size = max(0, len(points) - n + 1)
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total = (total ^ points[k:k + size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return (total & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place of the n-grams of each word, with the space before and after it."""
    first = words.starts - 1
    return first, np.maximum(first, words.ends + 2 - n)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # (sizes, buckets, languages): log-probabilities
    allowed: np.ndarray  # (scripts + 1, languages)
    letters: Alphabet


def _count(texts: list[str], letters: Alphabet) -> np.ndarray:
    """Counts of all buckets of all sizes, then letters of each script."""
    words = words_of(texts, letters)
    out = np.zeros(len(SIZES) * BUCKETS + OTHER + 1, np.int64)
    for i, n in enumerate(SIZES):
        bucket = buckets(words.points, n)
        first, last = _grams(words, n)
        inside = np.zeros(len(words.points) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.subtract.at(inside, last, 1)
        at = np.flatnonzero(np.cumsum(inside)[:len(bucket)] > 0)
        out[i * BUCKETS:(i + 1) * BUCKETS] = np.bincount(bucket[at], minlength=BUCKETS)
    out[-OTHER - 1:] = np.bincount(words.script, weights=words.letters, minlength=OTHER + 1)
    return out


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from text and lang of the rows given (doc_id only thins them).

    At most about `sample` rows of each language are read, drawn by a hash of the id; the counts of
    the n-grams are summed within each task before the shuffle. What reaches the driver is one number
    for each language, size and bucket, whatever the size of the table. Rows without text or lang teach
    nothing. The model holds the MAX_LANGUAGES languages with most rows, the first in order on a tie; the
    rows of rarer ones are not learned from.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = dict(sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:MAX_LANGUAGES])
    letters, languages = alphabet(), tuple(sorted(totals))
    width = len(SIZES) * BUCKETS + OTHER + 1
    if not languages:
        return Model((), np.zeros((len(SIZES), BUCKETS, 0), np.float32), np.ones((OTHER + 1, 0), bool), letters)
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    drawn = rows.filter(hash_unit("langid", F.col("doc_id")) < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                texts = [t.as_py() for t, name in zip(batch.column(1), langs) if name == lang]
                for part in _parts(texts):
                    sums[lang] = sums.get(lang, 0) + _count(texts[part], letters)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=["lang", "cell", "n"])

    counted = drawn.mapInArrow(run, "lang string, cell long, n long")
    cells = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), width), np.float64)
    langs = np.array([number[x] for x in cells.column("lang").to_pylist()], np.int64)
    counts[langs, cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    grams = counts[:, :len(SIZES) * BUCKETS].reshape(len(languages), len(SIZES), BUCKETS) + SMOOTHING
    scores = np.log(grams / grams.sum(axis=2, keepdims=True)).transpose(1, 2, 0) / len(SIZES)
    scripts = counts[:, len(SIZES) * BUCKETS:].T
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script nobody has seen excludes nobody
    return Model(languages, np.ascontiguousarray(scores, np.float32), allowed, letters)


def _parts(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about SLICE_CHARS characters; a longer text stands alone."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield slice(first, i)
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield slice(first, len(texts))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language; languages not written in its script are out."""
    out = np.zeros((len(words.starts), len(model.languages)), np.float32)
    for i, n in enumerate(SIZES):
        bucket = buckets(words.points, n)
        first, last = _grams(words, n)
        for k in range(len(model.languages)):
            sums = np.zeros(len(bucket) + 1)
            np.cumsum(model.scores[i, :, k][bucket], out=sums[1:])
            out[:, k] += (sums[last] - sums[first]).astype(np.float32)
    out -= EXCLUDED * ~model.allowed[words.script]
    return out


def viterbi(scores: np.ndarray, borders: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word, where a change between neighbours of one row costs `switch`.

    All rows of a slice step from word to word together, the longest first, so a step costs one numpy
    call for all rows that still have words.
    """
    count, langs = scores.shape
    labels = np.zeros(count, np.int16)
    sizes = np.diff(borders)
    order = np.argsort(-sizes, kind="stable")
    sizes, start = sizes[order], borders[:-1][order]
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    if not len(live) or langs == 1:
        return labels
    came = np.zeros((count, langs), np.int16)
    value, own = scores[start[:live[0]]], np.arange(langs, dtype=np.int16)
    last = np.zeros(len(sizes), np.int16)
    for t in range(1, len(live)):
        n, before = live[t], live[t - 1]
        if n < before:
            last[n:before] = value[n:before].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        jump = value[np.arange(n), best][:, None] - switch
        at = start[:n] + t
        came[at] = np.where(value >= jump, own, best[:, None])
        value = scores[at] + np.maximum(value, jump)
    last[:live[-1]] = value.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        labels[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return labels


def _spans(words: Words, labels: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """Runs of words of one language within a row: row, first and last + 1 code point, language."""
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (words.row[1:] != words.row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels))[:len(first)] - 1
    row = words.row[first]
    return row, words.starts[first] - words.offset[row], words.ends[last] - words.offset[row], labels[first]


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end, lang; code points, end exclusive).

    lang_pred is the language of most letters, the first in order on a tie; score is its share of the
    letters (marks belong to words but are no letters). Null and empty texts and texts without a letter give `und`, score 0 and no spans, as does a
    model that has learned nothing. Whole texts are labelled. Repeated rows give one row each, a missing
    doc_id is kept, other columns are not read, an empty table gives no rows. One narrow pass.
    """
    # plain arrays: what is broadcast must hold no class that an executor cannot import
    alphabet_of = tuple(getattr(model.letters, f.name) for f in fields(Alphabet))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.allowed, alphabet_of))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def label(texts: list[str], found: Model) -> tuple[list, list, pa.Array, np.ndarray]:
        words = words_of(texts, found.letters)
        if not len(words.starts) or not found.languages:
            none = pa.array([], spans_type)
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), none, np.zeros(len(texts), np.int64)
        borders = np.searchsorted(words.row, np.arange(len(texts) + 1))
        labels = viterbi(word_scores(words, found), borders, switch)
        width = len(found.languages)
        letters = np.bincount(words.row * width + labels, weights=words.letters, minlength=len(texts) * width).reshape(len(texts), width)
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        names = np.array(found.languages, dtype=object)
        langs = np.where(total > 0, names[best], UNDETERMINED)
        score = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
        row, start, end, lang = _spans(words, labels, len(texts))
        spans = pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(list(names[lang]), pa.string())],
            fields=list(spans_type))
        return list(langs), list(score), spans, np.bincount(row, minlength=len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, scores, allowed, arrays = shared.value
        found = Model(languages, scores, allowed, Alphabet(*arrays))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done = [label(texts[part], found) for part in _parts(texts)]
            if not done:
                continue
            ends = np.cumsum(np.concatenate([d[3] for d in done]))
            spans = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()), pa.concat_arrays([d[2] for d in done]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for d in done for x in d[0]], pa.string()),
                 pa.array([x for d in done for x in d[1]], pa.float64()), spans],
                names=["doc_id", "lang_pred", "score", "spans"])

    schema = (f"doc_id {id_type}, lang_pred string, score double, "
              "spans array<struct<start: bigint, end: bigint, lang: string>>")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text is divisible by 5."""
    return F.crc32(key_text(doc_id).cast("binary")) % 5 == 0
