"""Resampling of documents by hashed n-gram importance towards a target distribution.

Bytes translate and split: one table lower-cases A-Z and blanks what separates words, split() yields the words,
and a crc32 that goes on from the crc of the words before extends n-grams without joining them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import key_text
from plantpulse.session import staged

BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT = 5
MIN_WORDS = 20
CHUNK_BYTES = 1 << 20
# scores that one sorted partition of the draw holds, about
ROWS_PER_TASK = 1_000_000

SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
TABLE = bytearray(range(256))
for _byte in SEPARATORS:
    TABLE[_byte] = 0x20
for _byte in range(0x41, 0x5B):
    TABLE[_byte] = _byte + 0x20
TABLE = bytes(TABLE)


def features(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, crc32 of the n-grams that end in them), piece by piece, each piece about a megabyte of the text."""
    at, carried = 0, []
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            # up to the end of the word; separators are ASCII, so no character is cut
            while end < len(text) and TABLE[text[end]] != 0x20:
                end += 1
        fresh = text[at:end].translate(TABLE).split()
        at = end
        if not fresh:
            continue
        words, old = carried + fresh, len(carried)
        crcs = list(map(zlib.crc32, words))
        found = [np.array(crcs[old:], np.uint32)]
        spaced = [b" " + w for w in words]
        for n in range(2, longest + 1):
            # the crc of n - 1 words goes on over " " and the next one
            crcs = list(map(zlib.crc32, spaced[n - 1:], crcs))
            found.append(np.array(crcs[max(0, old - n + 1):], np.uint32))
        yield len(fresh), np.concatenate(found)
        carried = words[-(longest - 1):] if longest > 1 else []


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one counter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            seen = np.zeros(buckets, np.int64)
            for text in batch.column(0).cast(pa.large_binary()):
                for _, crcs in features(text.as_py() or b"", longest):
                    seen += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
            hit = np.flatnonzero(seen)
            counter.update(dict(zip(hit.tolist(), seen[hit].tolist())))
        if counter:
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.int32()),
                                              pa.array(list(counter.values()), pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket 1000 times the log of target share to source share, both with one added, floored."""
    s_all, t_all = float(sum(source.values())), float(sum(target.values()))
    return np.array([math.floor(1000 * math.log((float(target.get(b, 0) + 1) * (s_all + buckets))
                                                / (float(source.get(b, 0) + 1) * (t_all + buckets))))
                     for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.uint32(len(gain))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                for words, crcs in features(text.as_py() or b"", longest):
                    out[:, k] += words, len(crcs), gain[crcs % buckets].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a sha256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key_text(doc_id)), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scores: DataFrame, count: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`scores` with rank 1, 2, ... for the `count` highest of its eligible rows, null for the others.

    A quantile sketch first leaves out what cannot be drawn; the rest is range-sorted over many
    tasks, and a row's rank is its place in its partition plus the rows of the partitions before.
    """
    able = scores.filter("eligible")
    number = able.count()
    low = able.agg(F.percentile_approx("score", F.lit(max(0.0, 1 - 1.1 * count / number - 0.01)), F.lit(10_000))).first()[0] \
        if count else None
    top = able.filter(F.col("score") >= low) if count else able.limit(0)
    if count and top.count() < count:
        top = able
    tasks = max(1, -(-int(1.1 * count + 1) // rows_per_task))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")]
    dealt = staged(top.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "dealt")
    before, ahead = {}, 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        before[part], ahead = ahead, ahead + n
    spark = scores.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = 0, None
        for batch in batches:
            parts, starts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = np.empty(len(parts), np.int64)
            for k, own in enumerate(parts):
                place = place + 1 if own == part else 1
                part, out[k] = own, starts[k] + place
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out)], names=[*batch.schema.names[2:], "rank"])

    kept = ["uid", "doc_id", "n_features", "weight", "score"]
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in kept)
    placed = dealt.join(F.broadcast(offsets), "part").repartition(tasks, "part").sortWithinPartitions("part", *order)
    drawn = staged(placed.select("part", "before", *kept).mapInArrow(run, f"{kinds}, rank long")
                   .filter(F.col("rank") <= count), "drawn")
    rest = scores.join(drawn.select("uid"), "uid", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*kept, "rank").unionByName(rest.select(*kept, "rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank numbers those drawn.

    Words are runs of digits, letters and all that is not ASCII, A-Z lower-cased; features are all runs of 1 to
    `longest` words, hashed to `buckets`. Weight is the sum of the features' gains, score adds Gumbel noise of the
    doc_id, so the highest scores are a draw without replacement in proportion to the weights. Of the N
    documents with at least `min_words` words floor(percent * N / 100) are drawn, ties to the smaller doc_id.

    A null or empty text has no features and weight 0. A missing doc_id hashes as 'null' and is last among ties;
    repeated rows are documents of their own with equal scores. A very long text is hashed in pieces. Only
    counts of buckets (at most `buckets`) and of sorted partitions reach the driver. Other columns are not read; an
    empty table gives no rows, an empty target counts as none of each feature.
    """
    count = lambda texts: {r.bucket: r.n for r in bucket_counts(texts, buckets, longest).collect()}
    gain = gains(count(docs), count(target), buckets)
    weighed = weigh(docs, gain, longest).withColumn("uid", F.monotonically_increasing_id())
    scores = staged(weighed.select(
        "uid", "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible")), "scores")
    number = scores.filter("eligible").count()
    return ranked(scores, percent * number // 100).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
with recursive poly(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from poly where k < 8),
crc as materialized (select list(c order by i) as t from poly where k = 8),
texts as (select 0 as side, row_number() over () as uid, text from documents
          union all select 1, row_number() over (), text from benchmark),
words as materialized (
  select side, uid, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
grams as (
  select side, uid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f
  from words where len(w) > 0),
counted as materialized (select side, uid, f, count(*) as n from grams group by all),
hashed as materialized (
  select f, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
      range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 as bucket
  from (select distinct f from counted), crc),
sides as (select bucket, sum(case when side = 0 then n else 0 end) as s, sum(case when side = 1 then n else 0 end) as t
          from counted join hashed using (f) group by bucket),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * ((sum(s) over ())::double + 10000))
                                       / ((s + 1)::double * ((sum(t) over ())::double + 10000))))::bigint as g from sides),
weights as (select uid, sum(n)::bigint as n_features, sum(n * g)::bigint as weight
            from counted join hashed using (f) join gains using (bucket) where side = 0 group by uid),
docs as (select row_number() over () as uid, doc_id from documents),
scored as (
  select uid, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double)
                                                  / 4294967296)))::bigint as score,
         coalesce(len(w), 0) >= 20 as able
  from docs left join weights using (uid) left join (select uid, w from words where side = 0) using (uid)),
placed as (select *, row_number() over (partition by able order by score desc, doc_id, uid) as place,
                  count(*) filter (able) over () as number from scored)
select doc_id, n_features, weight, score,
       case when able and place <= 5 * number // 100 then place end as rank
from placed
"""
