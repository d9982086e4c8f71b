"""Jaccard join of word shingle sets by signature trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import per_batch
from plantpulse.llm.components import components
from plantpulse.llm.words import BASE, Texts, mix, slices, windows, word_hashes
from plantpulse.session import staged

SHINGLE_WORDS = 5
PERCENT = 80
# chance that a pair just at the threshold shares no anchor; it falls fast above the threshold
MISS = 1e-10
MOST_MINIMA = 192
# sets that one tree holds; larger blocks take several trees
TREE_SETS = 512
PAIR_WORDS = 1 << 21
SEED = 5


# --- sets -------------------------------------------------------------------------------------------

def shingle_sets(texts: Texts, n: int) -> Iterator[np.ndarray]:
    """For each row of a slice the sorted distinct hashes of its n-word shingles.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    hashes = word_hashes(texts, lower=True)
    grams = windows(hashes, n)
    for a, b in zip(texts.words[:-1], texts.words[1:]):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            power = np.array([pow(BASE, k + 1, 1 << 64) for k in range(b - a)], np.uint64)
            total = (hashes[a:b] * power).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(mix(np.array([total], np.uint64)))
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, minima in a band): the most selective bands that keep the chance of a miss."""
    t, best = percent / 100, (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(MISS) / math.log1p(-t ** rows)) if t < 1 else 1
        if bands * rows <= MOST_MINIMA:
            best = (bands, rows)
    return best


class Anchors:
    """Keys that two sets share with probability 1 - MISS or more when they are as alike as asked."""

    def __init__(self, percent: int, seed: int = SEED):
        self.bands, self.rows = band_shape(percent)
        rng = np.random.default_rng(seed)
        count = self.bands * self.rows
        self.flip = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32) | np.uint32(1)

    def of(self, values: np.ndarray) -> np.ndarray:
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 4096):
            least = np.minimum(least, ((low[at:at + 4096] ^ self.flip) * self.factor).min(axis=1))
        bands = least.reshape(self.bands, self.rows).astype(np.uint64)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            keys = mix(keys * np.uint64(BASE) + bands[:, k])
        return keys.view(np.int64)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set (128-bit fingerprint) and anchors of every document."""
    anchors = Anchors(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, keys, ends = [], [], [], [0]
        for texts in slices(batch.column(2)):
            for values in shingle_sets(texts, n):
                sizes.append(len(values))
                prints.append(fingerprint(values) if len(values) else None)
                if len(values):
                    keys.append(anchors.of(values))
                ends.append(ends[-1] + (anchors.bands if len(values) else 0))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists],
            names=["doc_id", "text_key", "n_shingles", "set", "anchors"])

    return per_batch(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run,
                     f"doc_id {id_type}, text_key long, n_shingles long, `set` binary, anchors array<long>")


# --- signature trees --------------------------------------------------------------------------------

class SignatureTree:
    """Sets sorted by size under a binary tree.

    A node holds the union of its sets' bitmaps, the range of their sizes, and how many elements a
    set may have beyond its bits. Two sets below nodes p and q share at most
    bits(p & q) + least excess elements, and at most the smaller size.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        width = 1 << max(8, min(16, int(2 * sizes.max()).bit_length()))
        bits = np.zeros((len(sets), width), bool)
        for i, values in enumerate(sets):
            bits[i, (values & np.uint64(width - 1)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        excess = sizes - bits.sum(axis=1)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(maps) > 1:
            maps, low, high, excess = self.levels[-1]
            if len(maps) % 2:  # the last node has one child, which stands here twice
                maps, low, high, excess = (np.concatenate([x, x[-1:]]) for x in (maps, low, high, excess))
            maps = maps[::2] | maps[1::2]
            self.levels.append((maps, np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]),
                                np.maximum(excess[::2], excess[1::2])))

    def possible(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a pair of sets at the threshold."""
        maps, low, high, excess = self.levels[level]
        share = self.percent
        out = (100 * high[p] >= share * low[q]) & (100 * high[q] >= share * low[p])
        at = np.flatnonzero(out)
        need = -(-share * (low[p[at]] + low[q[at]]) // (100 + share))
        bound = np.minimum(excess[p[at]], excess[q[at]])
        step = max(1, PAIR_WORDS // maps.shape[1])
        for a in range(0, len(at), step):
            part = at[a:a + step]
            bound[a:a + step] += np.bitwise_count(maps[p[part]] & maps[q[part]]).sum(axis=1, dtype=np.int64)
        out[at] = np.minimum(bound, np.minimum(high[p[at]], high[q[at]])) >= need
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that no bound excludes: dual traversal from the root, a level at a time."""
        p = q = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                count = len(self.levels[level][0])
                p, q = (np.concatenate([2 * p, 2 * p, 2 * p + 1, 2 * p + 1]), np.concatenate([2 * q, 2 * q + 1, 2 * q, 2 * q + 1]))
                keep = (p <= q) & (q < count)
                p, q = p[keep], q[keep]
            keep = self.possible(level, p, q)
            p, q = p[keep], q[keep]
        keep = p < q
        return p[keep], q[keep]

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return (100 + self.percent) * both >= self.percent * (len(a) + len(b))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _join(table: pa.Table, percent: int, across: bool) -> pa.Table:
    """Joined sets of one tree: each set and the least set that it reaches. With `across`, sides are compared."""
    names = table.column("set").to_pylist()
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    rows = sorted(first.values(), key=lambda i: (table.column("n")[i].as_py(), names[i]))
    sets = [np.frombuffer(table.column("elements")[i].as_py(), np.uint64) for i in rows]
    sides = [table.column("side")[i].as_py() for i in rows]
    parent = list(range(len(rows)))
    if len(rows) > 1:
        tree = SignatureTree(sets, percent)
        for i, j in zip(*(x.tolist() for x in tree.pairs())):
            if across and sides[i] == sides[j]:
                continue
            a, b = _root(parent, i), _root(parent, j)
            if a != b and tree.linked(i, j):
                parent[max(a, b)] = min(a, b)
    links = [(names[rows[i]], names[rows[_root(parent, i)]]) for i in range(len(rows)) if _root(parent, i) != i]
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


# --- the join ---------------------------------------------------------------------------------------

def _blocks(marks: DataFrame) -> DataFrame:
    """(key, block) of sets that share an anchor with another one, directly or through others."""
    spread = marks.select("key", F.explode("anchors").alias("anchor"))
    heads = staged(spread.groupBy("anchor").agg(F.min("key").alias("head"), F.max("key").alias("last"))
                   .filter("head < last").drop("last"), "heads")
    edges = spread.join(heads, "anchor").filter("key > head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    return components(edges).select(F.col("id").alias("key"), F.col("component").alias("block"))


def _elements(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The shingle sets of the wanted documents: block, set, n, elements.

    Documents are found by id and text, so that missing and repeated ids fetch no other document's text.
    """
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), "text")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key"))
    found = texts.join(wanted, same).select("block", "set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows meet in one task
        for batch in batches:
            keep, sizes, elements, expected, row = [], [], [], batch.column(1).to_pylist(), 0
            for texts in slices(batch.column(2)):
                for values in shingle_sets(texts, n):
                    name = expected[row]
                    if name not in seen and len(values) and fingerprint(values) == name:
                        seen.add(name)
                        keep.append(row)
                        sizes.append(len(values))
                        elements.append(values.tobytes())
                    row += 1
            at = pa.array(keep, pa.int64())
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()),
                     pa.array(elements, pa.binary())], names=["block", "set", "n", "elements"])

    return found.mapInArrow(run, "block long, `set` binary, n long, elements binary")


def _links(rows: DataFrame, percent: int, tree_sets: int) -> DataFrame:
    """Joined sets (a, b) of all blocks, by trees of at most about `tree_sets` sets.

    A block that fits one tree is done in the first round. A larger one is dealt to several trees by
    a hash. First each tree is joined with itself, then all trees with the block's first one; this joins groups of
    near copies whole. The sets that have not fallen to their block's largest class by then are the queries of the
    last round, tree by tree, against all sets of their block. Two sets of one class need no comparison.
    """
    def run(df: DataFrame, keys: list[str], across: bool) -> DataFrame:
        return df.groupBy(*keys).applyInArrow(lambda t: _join(t, percent, across), "a binary, b binary")

    counts = staged(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "trees", F.ceil(F.col("n") / tree_sets).cast("int")).drop("n"), "blocks")
    dealt = rows.join(counts, "block").withColumn("tree", F.pmod(F.xxhash64("set"), F.col("trees")).cast("int"))
    own = staged(run(dealt.withColumn("side", F.lit(0)), ["block", "tree"], False), "links")
    if not counts.filter("trees > 1").limit(1).count():
        return own
    large = dealt.filter("trees > 1")
    hub = large.filter("tree = 0").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("trees") - 1)))
    rest = large.filter("tree > 0").withColumn("other", F.col("tree"))
    sides = hub.withColumn("side", F.lit(0)).unionByName(rest.withColumn("side", F.lit(1)))
    joined = staged(own.unionByName(run(sides, ["block", "other"], True)), "links")
    classes = components(joined)
    labelled = staged(large.select("block", "set").join(classes, F.col("set") == F.col("id"), "left").select(
        "block", "set", F.coalesce("component", "set").alias("label")), "labels")
    by_size = labelled.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    main = staged(by_size.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main")
    odd = staged(labelled.join(main, "block").filter("label != main").select("block", "set"), "odd")
    groups = staged(odd.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select(
        "block", F.ceil(F.col("n") / tree_sets).cast("int").alias("groups")), "groups")
    if not groups.limit(1).count():
        return joined
    part = F.pmod(F.xxhash64("set", F.lit(1)), F.col("groups")).cast("int")
    queries = large.join(odd, ["block", "set"], "left_semi").join(groups, "block").withColumn("group", part)
    queries = queries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).withColumn("side", F.lit(0))
    against = large.join(groups, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    against = against.withColumn("other", F.col("tree")).withColumn("side", F.lit(1))
    names = ["block", "set", "n", "elements", "group", "other", "side"]
    last = run(queries.select(*names).unionByName(against.select(*names)), ["block", "group", "other"], False)
    return staged(joined.unionByName(last), "links")


def jaccard_join(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT,
                 tree_sets: int = TREE_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are runs of other characters than ASCII white space, A-Z counting as a-z; a set holds the distinct
    shingles of `shingle_words` words as 64-bit hashes. Two documents link when
    100 * intersection >= percent * union, which is verified on the whole sets; component_id is the
    smallest doc_id reachable. Null and empty texts have an empty set and link with nothing. Repeated
    rows share a set; a missing doc_id takes part but names no component unless nobody else does (then it is
    null). Other columns are not read. An empty table gives no rows.

    Equal sets are one set from the start, so copies cost one row each. Sets meet in a block when they
    share an anchor, directly or through others; an anchor is a group of minima of the set, and a
    pair at the threshold shares none with probability 1e-10 at most. Each block is joined by signature trees. No
    pairs are written, only each set with the least one it is joined to.
    """
    marks = staged(signatures(docs, shingle_words, percent), "signatures")
    key = F.conv(F.substring(F.hex("set"), 1, 15), 16, 10).cast("long")
    sets = marks.filter("n_shingles > 0").groupBy("set").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("anchors").alias("anchors"))
    sets = staged(sets.select("set", "row.*", "anchors", key.alias("key")), "sets")
    blocks = staged(_blocks(sets), "blocks")
    wanted = sets.select("key", "set", "doc_id", "text_key").join(blocks, "key").select("block", "set", "doc_id", "text_key")
    rows = staged(_elements(docs, wanted, shingle_words), "elements")
    classes = components(_links(rows, percent, tree_sets))
    grouped = marks.select("doc_id", "n_shingles", "set").join(
        classes.withColumnRenamed("id", "__id"), F.col("set") == F.col("__id"), "left")
    grouped = staged(grouped.select("doc_id", "n_shingles", F.coalesce("component", "set").alias("class")), "classes")
    least = staged(grouped.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    least = least.withColumnRenamed("class", "__class")
    return grouped.join(least, F.col("class") == F.col("__class"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
