"""Quality rules from repetition: characters inside duplicated n-grams and duplicated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import per_batch
from plantpulse.llm.words import Texts, characters, mix, per_row, slices, whole_windows, windows, word_hashes

# largest accepted share of a text's word characters inside n-grams that stood before
DUP_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# largest accepted share of a text's word characters inside lines that stood before
DUP_LINE_CHAR_SHARE = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_WINDOW = 3
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and did it occur before?"""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _cover(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words that begins at one of the places."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + n, 1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of each row of a slice.

    A window of n + 1 words can only repeat where both of its windows of n words do, so each length
    sorts only the places that the length before has left.
    """
    chars, size, row = characters(texts), len(texts.starts), texts.row_of_word()
    hashes = word_hashes(texts)
    out = {"n_words": texts.counts(), "word_chars": per_row(texts, chars)}
    marks = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(SYMBOLS[texts.data], out=marks[1:])
    out["n_symbols"] = marks[texts.borders[1:]] - marks[texts.borders[:-1]]
    lines = np.zeros((texts.rows, 3), np.int64)
    for r in range(texts.rows):
        lines[r] = _lines(texts.text(r))
    out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = lines.T

    at = np.flatnonzero(whole_windows(texts, BASE_WINDOW)) if size >= BASE_WINDOW else np.zeros(0, np.int64)
    for n in range(BASE_WINDOW, max(DUP_NGRAM_SHARE) + 1):
        if n > BASE_WINDOW and len(at):
            follows = np.zeros(size + 1, bool)
            follows[at] = True
            at = at[follows[at + 1]]
            at = at[(at + n <= size)]
            at = at[row[at] == row[at + n - 1]]
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key += hashes[at + k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        twice, later = _repeated(mix(key + (row[at].astype(np.uint64) << np.uint64(32))))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_row(texts, _cover(size, at[twice], n))
        if n in DUP_NGRAM_SHARE:
            out[f"dup_{n}_chars"] = per_row(texts, _cover(size, at[later], n) * chars)
        at = at[twice]
    return out


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word; of these, how many equal an earlier line, and their characters."""
    n = dup = chars = 0
    seen = set()
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            n += 1
            if line in seen:
                dup += 1
                chars += len(line.decode("utf-8", "replace"))
            else:
                seen.add(line)
    return n, dup, chars


def repetition_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of `measure` for every whole text; one narrow pass, no shuffle."""
    names = [*COUNTS, *[f"dup_{n}_chars" for n in DUP_NGRAM_SHARE]]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(t) for t in slices(batch.column(1))]
        values = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", *names])

    schema = ", ".join([f"doc_id {id_type}", *[f"{n} long" for n in names]])
    return per_batch(docs.select("doc_id", "text"), run, schema)


def judge(counts: DataFrame) -> DataFrame:
    """Add base_failed, the shares and kept to the counts."""
    words = F.col("n_words")
    failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words)

    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    shares = {"dup_line_char_share": F.least(share("dup_line_chars", "word_chars"), F.lit(1.0))}
    shares |= {f"dup_{n}_share": share(f"dup_{n}_chars", "word_chars") for n in DUP_NGRAM_SHARE}
    good = F.col("dup_line_char_share") <= DUP_LINE_CHAR_SHARE
    for n, most in DUP_NGRAM_SHARE.items():
        good = good & (F.col(f"dup_{n}_share") <= most)
    return counts.withColumns(shares).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & good)


def quality(docs: DataFrame) -> DataFrame:
    """Repetition coverage and verdict of every document.

    Returns doc_id, the counts, the shares, base_failed (fewer than 50 words, or over half of the words
    in 3-word windows that occur twice or more) and kept (base passed and no share above its limit).
    Null and empty texts have no words and fail the base. Whole texts count, whatever their length.
    Repeated rows are judged each on its own, a missing doc_id is kept, other columns are not read, and
    an empty table gives no rows.
    """
    return judge(repetition_counts(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `quality` keeps, with all their columns.

    The verdict is computed next to the row, so nothing is joined and repeated or missing ids do not matter.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(names.index("text"))
        parts = [_good(measure(t)) for t in slices(text)]
        keep = np.concatenate(parts) if parts else np.zeros(0, bool)
        return batch.filter(pa.array(keep))

    names = docs.columns
    return docs.mapInArrow(lambda batches: (run(b) for b in batches), docs.schema)


def _good(m: dict[str, np.ndarray]) -> np.ndarray:
    """The verdict of `judge` in numpy."""
    words, chars = m["n_words"], np.maximum(m["word_chars"], 1)
    good = (words >= MIN_WORDS) & (100 * m["n_repeat_words"] <= MAX_REPEAT_PERCENT * words)
    good &= m["dup_line_chars"] / chars <= DUP_LINE_CHAR_SHARE
    for n, most in DUP_NGRAM_SHARE.items():
        good &= m[f"dup_{n}_chars"] / chars <= most
    return good
