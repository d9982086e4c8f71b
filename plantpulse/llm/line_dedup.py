"""Substring dedup by hashes of lines, cut at sentence ends, of paragraphs, or of runs of sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import ids_are_keys, per_batch, with_uid
from plantpulse.llm.words import Texts, mix, slices, word_hashes
from plantpulse.session import staged

MIN_WORDS = 8
MODES = ("sentence", "line", "paragraph")
# overlapping units: sentences, the short ones joined to their neighbours
PASSAGE = "passage"
SECOND = np.uint64(0xD6E8FEB86659FD93)


def _cuts(texts: Texts, mode: str) -> np.ndarray:
    """For each word: does a unit begin with it?"""
    data, starts, ends = texts.data, texts.starts, texts.ends
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x0A, out=lines[1:])
        feeds = lines[starts[1:]] - lines[ends[:-1]]
        new[1:] = feeds >= (2 if mode == "paragraph" else 1)
        if mode in ("sentence", PASSAGE):
            new[1:] |= np.isin(data[ends[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    first = texts.words[:-1]
    new[first[first < texts.words[1:]]] = True
    return new


def _joined(first: np.ndarray, last: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the shortest run of `least` words from each sentence on, and up to each one.

    Whatever stands around it, a repeated run of sentences of `least` words in all is covered by such runs.
    """
    n = len(first)
    to, since = np.searchsorted(last + 1, first + least), np.searchsorted(first, last + 1 - least, "right") - 1
    on = np.flatnonzero((to < n) & (row[np.minimum(to, n - 1)] == row))
    upto = np.flatnonzero((since >= 0) & (row[np.maximum(since, 0)] == row))
    runs = np.unique(np.concatenate([on * n + to[on], since[upto] * n + upto]))
    return first[runs // n], last[runs % n]


def _units(texts: Texts, mode: str, least: int) -> tuple[np.ndarray, ...]:
    """Row, first and last + 1 code point, words and 128-bit digest of the units of a slice."""
    n = len(texts.starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = np.flatnonzero(_cuts(texts, mode))
    last = np.append(first[1:], n) - 1
    if mode == PASSAGE:
        first, last = _joined(first, last, texts.row_of_word()[first], least)
    else:
        keep = last - first + 1 >= least
        first, last = first[keep], last[keep]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    size = last - first + 1
    opens = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(opens, size)
    hashes = word_hashes(texts, lower=True)[np.repeat(first, size) + place]
    place = place.astype(np.uint64)
    # sums of words mixed with their place in the unit: equal sequences of words give equal sums
    digests = [mix(np.add.reduceat(mix(hashes * salt + place), opens) + size.astype(np.uint64))
               for salt in (np.uint64(1), SECOND)]
    points = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
    row = texts.row_of_word()[first]
    base = points[texts.borders[:-1]][row]
    start, end = points[texts.starts[first]] - base, points[texts.ends[last]] - base
    return row + texts.first, start, end, size, digests[0].view(np.int64), digests[1].view(np.int64)


def units(docs: DataFrame, mode: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, words, and a 128-bit digest (h1, h2) of every unit of at least `min_words` words.

    In mode "passage" the units are runs of sentences of a document, line ends or not: from each sentence on,
    and up to each sentence, the shortest run of `min_words` words. So the minimum holds for the passage and not
    for its sentences. Runs may overlap; a sentence of `min_words` words is a run by itself.

    Normalised: A-Z count as a-z and any white space between words counts alike. Offsets are those of
    the original text, in code points.
    """
    if mode not in (*MODES, PASSAGE):
        raise ValueError(f"mode is one of {(*MODES, PASSAGE)}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "end", "words", "h1", "h2"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [_units(t, mode, min_words) for t in slices(batch.column(1))]
        if not parts:
            return None
        row, *rest = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=names)

    schema = f"doc_id {id_type}, " + ", ".join(f"`{n}` long" for n in names[1:])
    return per_batch(docs.select("doc_id", "text"), run, schema)


def rank() -> Column:
    """Earlier is smaller doc_id, then smaller start; a missing doc_id comes last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("start").alias("start"))


def removed_units(docs: DataFrame, mode: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit that repeats an earlier one: doc_id, start, end, words, first_doc_id, first_start.

    Equal units anywhere in the corpus form a group; its earliest by (doc_id, start) stays, the others
    are returned with their original offsets. Where units overlap, each sentence of a returned one
    still has an earlier copy that stays. Rows that share doc_id and text count as one document; rows that share a
    doc_id, or have none, but differ in text are different ones, in order of a digest of the text.
    Null and empty texts have no units, other columns are not read, an empty table gives no rows.

    Units are staged as numbers, so the text is read once. Groups are formed by partial aggregation,
    which leaves one row per digest and task however common a line is; only digests that occur more
    than once meet the units again, in a join whose large partitions can be split.
    """
    if ids_are_keys(docs):
        return _repeats(docs, mode, min_words)
    known = with_uid(docs.select("doc_id", "text"))
    found = _repeats(known.select(F.col("__uid").alias("doc_id"), "text"), mode, min_words)
    ids = staged(known.select("__uid", F.col("doc_id").alias("__id")).distinct(), "ids")
    for name in ("doc_id", "first_doc_id"):
        own = ids.select(F.col("__uid").alias(name), F.col("__id").alias(f"__{name}"))
        found = found.join(own, name).drop(name).withColumnRenamed(f"__{name}", name)
    return found.select("doc_id", "start", "end", "words", "first_doc_id", "first_start")


def _repeats(docs: DataFrame, mode: str, min_words: int) -> DataFrame:
    """`removed_units` of documents whose doc_id tells them apart."""
    found = staged(units(docs, mode, min_words), "units")
    groups = found.groupBy("h1", "h2").agg(F.min(rank()).alias("__first"), F.count(F.lit(1)).alias("__n"))
    groups = groups.filter("__n > 1").select("h1", "h2", "__first")
    joined = found.join(groups, ["h1", "h2"]).filter(rank() != F.col("__first"))
    return joined.select("doc_id", "start", "end", "words", F.col("__first.doc_id").alias("first_doc_id"),
                         F.col("__first.start").alias("first_start"))


def dedup(docs: DataFrame, mode: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the repeats cut out of text, and `removed`: their original (start, end) spans.

    Spans of one document, told by doc_id and text, are gathered in that document's rows only. Rows without a repeat stay
    as they are.
    """
    names, numbered = docs.columns, not ids_are_keys(docs)
    docs = docs.withColumn("__uid", F.col("doc_id")) if not numbered else with_uid(docs)
    gone = _repeats(docs.select(F.col("__uid").alias("doc_id"), "text"), mode, min_words).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    joined = docs.join(gone.withColumnRenamed("doc_id", "__gone_id"), F.col("__uid") == F.col("__gone_id"), "left")
    text = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = [_cut(t, spans) for t, spans in zip(columns[text].to_pylist(), columns[-1].to_pylist())]
        columns[text] = pa.array(texts, columns[text].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = joined.select(*names, "removed")
    return out.mapInArrow(lambda batches: (run(b) for b in batches), out.schema)


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    if text is None or not spans:
        return text
    at, kept = 0, []
    for span in spans:
        kept.append(text[at:span["start"]])
        at = max(at, span["end"])
    return "".join([*kept, text[at:]])
