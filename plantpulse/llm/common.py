"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.order import SeriesSpec, joined_on, with_position
from plantpulse.session import staged

# a word: a run without space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Map Arrow batches one by one; a task never holds more than one batch and its result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def key_text(column: Column) -> Column:
    """Text of an id for hashing; a missing id counts as the text 'null'."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def hash_unit(seed: str, column: Column) -> Column:
    """Uniform number in [0, 1) from 52 bits of an md5, the same in any engine and any run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key_text(column))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def text_key(text: Column) -> Column:
    """128-bit digest of a text; a missing one counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def with_occurrence(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number equal rows 0, 1, 2, ...: rows that share `keys`, missing values included.

    Only keys that repeat are laid out, in an order that is cut into blocks where one key has very many rows; equal
    rows are interchangeable, so it does not matter which of them gets which number.
    """
    repeated = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    none = F.lit(0).cast("long")
    if not repeated.limit(1).count():
        return rows.withColumn(name, none)
    single = joined_on(rows, repeated, keys, "left_anti").withColumn(name, none)
    again = joined_on(rows, repeated, keys, "left_semi").withColumn("__row", F.monotonically_increasing_id())
    # the row's own number lets a range sort cut a run of equal rows
    placed = with_position(staged(again, "repeats"), SeriesSpec(keys=tuple(keys), order="__row", tiebreak=()), name)
    return single.unionByName(placed.drop("__row").withColumn(name, F.col(name).cast("long")))


def ids_are_keys(docs: DataFrame) -> bool:
    """Is every doc_id present, and used once?"""
    wrong = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    return not wrong.limit(1).count()


def with_uid(docs: DataFrame) -> DataFrame:
    """`docs` with __uid: a number for each pair of doc_id and text, by doc_id (missing last), then digest of the text."""
    key = text_key(F.col("text"))
    pairs = docs.select("doc_id", key.alias("__key"), F.col("doc_id").isNull().alias("__none")).distinct()
    spec = SeriesSpec(keys=(), order="__none", tiebreak=("doc_id", "__key"))
    numbers = with_position(pairs, spec, "__uid").select("doc_id", "__key", F.col("__uid").cast("long").alias("__uid"))
    return joined_on(docs.withColumn("__key", key), staged(numbers, "uids"), ["doc_id", "__key"], "inner").drop("__key")
