"""Secret scans behind a trigram inverted index; DataFrame functions only.

Every rule is a regular expression. From its syntax follows a Boolean query over trigrams that any
match must contain. The index holds, for each segment of documents and each trigram that some query
names, the documents that contain it. Postings are intersected and united per segment, and only the
documents that are left are scanned with the rule. A rule without mandatory trigrams scans all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import key_text

SEGMENT_DOCS = 4096
BLOCK = 256
PLACEHOLDER = "[SECRET]"
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose `group` is shorter than `least` are dropped.

    A match of `pattern` runs on over `tail`, which may be empty and has no groups of its own.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    tail: str = ""


# What follows the first line of a private key: all up to its END line; where that is missing, header lines, runs of 16
# or more base64 characters, and a shorter last line. Line ends may be written as \n. Possessive, so that it is one pass.
_BETWEEN = r"(?:\\[nrt]|[^A-Za-z0-9+/=]){0,8}+"
PEM_TAIL = (r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
            rf"|(?:{_BETWEEN}[A-Z][A-Za-z]{{1,20}}-[A-Z][A-Za-z]{{1,20}}: [^\r\n\\]*+){{0,4}}+(?:{_BETWEEN}[A-Za-z0-9+/=]{{16,}}+)++"
            r"""(?:(?:\r|\\r)?(?:\n|\\n)[\x20\t]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\s\\"']|$))?)?""")

# The three base kinds, then well-known token formats.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
RULES = [
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", tail=PEM_TAIL),
]

# A query is a list of clauses, all of which hold; a clause is a list of alternatives; an alternative
# is a set of trigrams, all of which occur.
Query = list[list[frozenset[str]]]
MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of a pattern satisfies, in lower case."""
    exact, clauses = _analyse(list(re._parser.parse(pattern)))
    return [c for c in [*clauses, _clause(exact)] if c]


def _clause(strings: set[str] | None) -> list[frozenset[str]]:
    """One of the strings occurs: the trigrams of each; nothing if one of them has none."""
    found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings or {""}}
    # an alternative that asks for more than another one adds nothing
    return [] if frozenset() in found else [f for f in sorted(found, key=sorted) if not any(g < f for g in found)]


def _analyse(items: list) -> tuple[set[str] | None, Query]:
    """Of a concatenation: the strings that its last literal run may be, and the clauses before it."""
    run: set[str] = {""}
    clauses: Query = []
    for op, value in items:
        strings, inner = _strings(str(op), value)
        joined = {a + b for a, b in product(run, strings)} if strings is not None else set()
        if strings is not None and len(joined) <= MOST_STRINGS:
            run = joined
            continue
        clauses.append(_clause(run))
        clauses += inner
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    return run, [c for c in clauses if c]


def _strings(op: str, value) -> tuple[set[str] | None, Query]:
    """All strings that a node may match, if they are few and known; else the clauses it implies."""
    if op == "LITERAL":
        return {chr(value).lower()}, []
    if op == "IN":
        if all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}, []
        return None, []
    if op == "SUBPATTERN":
        return _whole(list(value[-1]))
    if op == "BRANCH":
        parts = [_whole(list(b)) for b in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), []
        return None, []
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = value
        strings, inner = _whole(list(body))
        if strings is not None and int(most) <= 1:
            return strings | {""} if least == 0 else strings, []
        if strings is not None and least == most and len(strings) == 1:
            return {next(iter(strings)) * int(least)}, []
        return None, inner if least else []
    return None, []


def _whole(items: list) -> tuple[set[str] | None, Query]:
    run, clauses = _analyse(items)
    known = not clauses and all(_strings(str(op), v)[0] is not None for op, v in items)
    return (run, []) if known else (None, [c for c in [*clauses, _clause(run)] if c])


def row_key() -> Column:
    """Stands for id and text of a row; equal rows share it."""
    return F.xxhash64(key_text(F.col("doc_id")), F.coalesce(F.col("text"), F.lit("")))


def candidates(docs: DataFrame, rules: list[Rule], segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """(__key, __rules): for each document with candidates, the numbers of the rules left to verify.

    Postings are keyed by (segment, trigram) with a segment of about `segment_docs` documents, so
    no posting list grows with the corpus, however frequent its trigram is.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for alternative in clause for g in alternative})
    segments = docs.count() // segment_docs + 1
    present = _bind(F.lower("text"), lambda low: F.array_compact(F.array(
        *[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])))
    keyed = docs.select(row_key().alias("__key"), present.alias("__grams"))
    postings = keyed.select(
        "__key", F.pmod("__key", F.lit(segments)).alias("__segment"), F.explode("__grams").alias("__gram"))
    lists = postings.groupBy("__segment", "__gram").agg(F.collect_set("__key").alias("__docs"))
    none = F.array().cast("array<bigint>")
    index = lists.groupBy("__segment").agg(*[
        F.coalesce(F.first(F.when(F.col("__gram") == i, F.col("__docs")), True), none).alias(f"__p{i}")
        for i in range(len(grams))])
    at = {g: F.col(f"__p{i}") for i, g in enumerate(grams)}

    def left(query: Query) -> Column:
        clauses = []
        for clause in query:
            alternatives = [_fold(F.array_intersect, [at[g] for g in sorted(a)]) for a in clause]
            clauses.append(_fold(F.array_union, alternatives))
        return _fold(F.array_intersect, clauses)

    found = [F.transform(left(q), _numbered(i)) for i, q in enumerate(queries) if q]
    hits = index.select(F.inline(F.concat(*found)))
    return hits.groupBy("__key").agg(F.collect_set("__rule").alias("__rules"))


def _fold(join: Callable[[Column, Column], Column], columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = join(out, c)
    return out


def _numbered(i: int) -> Callable[[Column], Column]:
    return lambda key: F.struct(key.alias("__key"), F.lit(i).alias("__rule"))


def with_candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows of `docs` with __rules, the rules to verify; texts are dealt by a hash of the row."""
    found = candidates(docs.select("doc_id", "text"), rules).hint("shuffle_hash")
    return docs.withColumn("__key", row_key()).join(found, "__key", "left").drop("__key")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in several places."""
    return F.transform(F.array(value), use)[0]


def _to_verify(rules: list[Rule], tails_first: bool = False) -> Column:
    """The rules that a row's text matches: its candidates, and those that must scan every text."""
    text, found = F.col("text"), []
    for i, rule in sorted(enumerate(rules), key=lambda r: tails_first and not r[1].tail):
        test = text.rlike(rule.pattern)
        if trigram_query(rule.pattern):
            test = F.array_contains("__rules", F.lit(i)) & test
        found.append(F.when(test, F.struct(
            F.lit(i).alias("rank"), F.lit(rule.pattern + rule.tail).alias("pattern"), F.lit(rule.group).alias("group"),
            F.lit(rule.least).alias("least"))))
    return F.array_compact(F.array(*found))


def _pieces(text: Column, rule: Column) -> Column:
    """A text cut at a rule's matches: array of (gap, hit, good); the last gap has no hit."""
    gaps = F.split(text, rule["pattern"], -1)
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    wanted = F.regexp_extract_all(text, rule["pattern"], rule["group"])
    return F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), wanted.alias("want")), lambda p: F.struct(
        p["gap"].alias("gap"), p["hit"].alias("hit"),
        (F.char_length(p["want"]) >= rule["least"]).alias("good")))


def _spans(text: Column, rule: Column) -> Column:
    """Spans of the good matches, in code points; running lengths are summed block by block."""
    nothing = F.array().cast(SPAN)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.coalesce(F.char_length(p["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), rule["rank"].alias("rank"), end.alias("end"))
        found = F.when(F.coalesce(p["good"], F.lit(False)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def block(pieces: Column, acc: Column, number: Column) -> Column:
        part = F.slice(pieces, number * BLOCK + 1, F.lit(BLOCK))
        zero = F.struct(acc["at"].alias("at"), nothing.alias("found"))
        return _bind(F.aggregate(part, zero, step), lambda done: F.struct(
            done["at"].alias("at"), F.concat(acc["found"], F.array(done["found"])).alias("found")))

    def all_blocks(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
        last = F.floor((F.size(pieces) - 1) / BLOCK).cast("int")
        return F.flatten(F.aggregate(
            F.sequence(F.lit(0), last), zero, lambda acc, number: block(pieces, acc, number))["found"])

    return _bind(_pieces(text, rule), all_blocks)


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) sorted by start, then by the rules' order.

    Starts and ends count code points, the end is exclusive. Spans of different rules may overlap. Null
    and empty texts have no spans, repeated rows give one row each, a missing doc_id is kept, other
    columns are not read, an empty table gives no rows.
    """
    marked = with_candidates(docs.select("doc_id", "text"), rules)
    verify = F.coalesce(_to_verify(rules), F.array())
    found = F.array_sort(F.flatten(F.transform(verify, lambda rule: _spans(F.col("text"), rule))))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return marked.select("doc_id", F.transform(found, lambda s: F.struct(
        F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(of(*[r.kind for r in BASE])), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """`docs` with every secret replaced by a placeholder; all columns and rows stay.

    The rules that a text matches apply in their order, each to what the ones before have left; those
    with a tail come first, as no other may take the mark that they begin with.
    """
    def cleaned(text: Column, rule: Column) -> Column:
        return F.array_join(F.transform(_pieces(text, rule), lambda p: F.concat(
            p["gap"], F.when(p["hit"].isNull(), "").when(p["good"], placeholder).otherwise(p["hit"]))), "")

    out = with_candidates(docs, rules)
    text = F.aggregate(_to_verify(rules, tails_first=True), F.col("text"), cleaned)
    return out.withColumn("text", F.coalesce(text, F.col("text"))).select(*docs.columns)


def _oracle() -> str:
    """SQL for `digest`: splits every text by every rule."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select k, {i} as rank, '{r.kind}' as kind, {r.least} as least,
  string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}', 0) as hits,
  regexp_extract_all(text, '{p}', {r.group}) as wants from d where regexp_matches(text, '{p}')""")
    return """with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
pieces as (""" + "\nunion all\n".join(parts) + """),
cut as (select k, rank, kind, least, unnest(hits) as hit, unnest(wants) as want,
  unnest(gaps[:len(hits)]) as gap, generate_subscripts(hits, 1) as i from pieces),
placed as (select *, sum(len(gap) + len(hit)) over (partition by k, rank order by i) as stop from cut),
good as (select *, kind || ':' || cast(stop - len(hit) as bigint) || ':' || cast(stop as bigint) as span
  from placed where len(want) >= least),
per as (select k, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access,
  count(*) filter (where rank = 2) as n_hex,
  string_agg(span, ',' order by stop - len(hit), rank) filter (where rank < 3) as base,
  string_agg(span, ',' order by stop - len(hit), rank) as spans from good group by k)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (k)"""


ORACLE = _oracle()
