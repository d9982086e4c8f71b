"""Mixing sources to target weights by repeating and thinning documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.common import WORD, hash_unit, key_text, text_key, with_occurrence
from plantpulse.operators.order import SeriesSpec, running_sums, with_position
from plantpulse.session import staged

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix"
# up to so many sources their rates are broadcast; beyond, documents meet them by a salted join
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target of every source: (source, source_size) -> (source, source_size, target).

    Sources in code point order, a missing one last, take the weights in turn and share the sum of
    all sizes. No target exceeds `max_repeat` times its source; what lies above is shared again by
    weight. The result is the level L with sum(min(cap, L * weight)) = total: with sources sorted by
    cap / weight, L is the largest (total - caps before) / (weights from here on).
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("__none"))
    placed = with_position(named, SeriesSpec(keys=(), order="__none", tiebreak=("source",)), "__rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights)).cast("int") + 1)
    capped = placed.select(
        "source", "source_size", weight.cast("long").alias("__w"), "__rank",
        (F.lit(max_repeat) * F.col("source_size")).cast("long").alias("__cap"))
    capped = staged(capped.withColumn("__ratio", F.col("__cap") / F.col("__w")), "mix-sources")
    by_ratio = with_position(capped, SeriesSpec(keys=(), order="__ratio", tiebreak=("__rank",)), "__at")
    sums = running_sums(by_ratio, "__at", {"__caps": "__cap", "__ws": "__w"})
    total, weight_sum = capped.agg(F.sum("source_size"), F.sum("__w")).first()
    if not total:
        return capped.select("source", "source_size", F.lit(0.0).alias("target"))
    level = sums.agg(F.max((F.lit(total) - F.col("__caps")) / (F.lit(weight_sum) - F.col("__ws")))).first()[0]
    target = F.least(F.col("__cap").cast("double"), F.lit(level) * F.col("__w"))
    return capped.select("source", "source_size", target.alias("target"))


def draw(seed: str) -> Column:
    """Number in [0, 1) of a row with doc_id, __key and __again: each of several equal rows has its own."""
    return hash_unit(seed, F.concat_ws(":", key_text(F.col("doc_id")), F.col("__key"), F.col("__again")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT,
        seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    The rate of a source is target / source_size. A document is taken floor(rate) times, and once more
    when a number hashed from seed, doc_id, text and the row's number among equal rows lies below the fraction, so
    reruns agree, no document exceeds `max_repeat` copies, and rows without an id, or with the same one, are
    drawn each on its own. A missing doc_id hashes as the text 'null'. A missing or empty text has size 0, a source of size 0 has target 0 and rate 0, a
    missing source is a source of its own. Other columns are not read. An empty table gives no rows.

    Sizes are counted once and staged, so the text is read in one scan; sources are summed map-side
    before the shuffle, so a hot source costs one row per task.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               text_key(F.col("text")).alias("__key")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = staged(targets(sizes, weights, max_repeat), "mix-targets")
    named = goal.select(F.col("source").alias("__s"), "source_size", "target")
    sized = with_occurrence(sized, ["source", "doc_id", "__key"], "__again")
    if goal.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__s")))
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        spread = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("__p", salt).join(
            spread, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(seed) < rate - F.floor(rate)
    copies = F.floor(rate) + extra.cast("long")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT,
                    seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`.

    The rates are joined by source, so only texts of rows that repeat an id and a text are shuffled.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    goal = staged(targets(sizes, weights, max_repeat), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = goal.select(F.col("source").alias("__s"), rate.alias("__rate"))
    named, docs = docs.columns, docs.withColumn("__key", text_key(F.col("text")))
    docs = with_occurrence(docs, ["source", "doc_id", "__key"], "__again")
    if goal.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("__s")))
    else:
        spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__p", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(
            spread, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__salt")))
    whole = F.floor("__rate")
    copies = whole + (draw(seed) < F.col("__rate") - whole).cast("long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), copies))
    return joined.filter(copies > 0).withColumn("__copy", each).select(*named)


ORACLE = """with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5(coalesce(text, '')) as key, row_number() over (partition by source, doc_id, coalesce(text, '')) - 1 as again
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sizes),
capped as (select *, 3 * source_size as cap, 3 * source_size / w as ratio,
  row_number() over (order by source nulls last) as rk from ranked),
sums as (select *, coalesce(sum(cap) over before, 0) as caps, coalesce(sum(w) over before, 0) as ws
  from capped window before as (order by ratio, rk rows between unbounded preceding and 1 preceding)),
level as (select max((t.total - s.caps) / (t.ws - s.ws)) as l
  from sums s, (select sum(source_size) as total, sum(w) as ws from capped) t),
goal as (select source, source_size,
  case when (select sum(source_size) from capped) = 0 then 0e0
       else least(cast(cap as double), cast(l as double) * w) end as target from capped, level),
rated as (select d.doc_id, d.size, g.source_size, g.target,
  case when g.source_size > 0 then g.target / g.source_size else 0e0 end as rate,
  cast('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), 'null') || ':' || d.key || ':' || d.again), 1, 13) as bigint)
    / 4503599627370496e0 as u
  from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from rated"""
