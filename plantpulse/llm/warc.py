"""Resolution of "not modified" revisits against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.order import SeriesSpec, last_seen, lay_out

NOT_MODIFIED = "server-not-modified"
# Header fields that a 304 response may update in the stored response.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not name another page.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """One spelling per page: no scheme, user, www, default port, fragment, tracking parameter or closing slash.

    The host is lower-cased, the other parameters are sorted. A missing url stays missing.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def resolve(records: DataFrame) -> DataFrame:
    """Join every not-modified revisit to the latest earlier full response of its canonical URL.

    `records`: record_id, url, ts, kind (response, or the revisit profile), status, headers (map with
    lower-case names), body. Returns one row per revisit: record_id, canonical_url, ts, response_id,
    response_ts, outcome, headers and body.

    outcome: `resolved` (a validator that both sides carry agrees and none differs), `unvalidated` (no
    validator in common), `conflict` (etag or last-modified differs; weak and strong etags compare by
    value) or `missing` (no earlier full response). Headers of a resolved or unvalidated revisit are those
    of the response, updated by the fields that a 304 may change; body is that of the response. A
    conflict or missing one keeps its own headers and has no body.

    A full response is a response record of status 200; earlier means smaller (ts, record_id). Records
    without url or ts take no part as responses, and their revisits are `missing`. Repeated rows are
    resolved each; null headers count as none; other columns are not read; an empty table gives no rows.

    The body is not carried through the ordered pass: that pass moves ids and validators only, and only
    resolved revisits fetch headers and body by the id of their response. A hot URL is cut into blocks.
    """
    narrow = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "status",
        _header("etag").alias("etag"), _header("last-modified").alias("modified"), "headers")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    marked = narrow.withColumn("__full", F.coalesce(full, F.lit(False))).withColumn(
        "headers", F.when(F.col("kind") == NOT_MODIFIED, F.col("headers")))
    spec = SeriesSpec(keys=("canonical_url",), order="ts", tiebreak=("record_id",))
    stored = F.when(F.col("__full"), F.struct("record_id", "ts", "etag", "modified"))
    joined = last_seen(lay_out(marked, spec), {"stored": stored}, inclusive=False).frame()
    revisits = joined.filter(F.col("kind") == NOT_MODIFIED)
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("stored").isNotNull()
    # 1 where a validator agrees, 0 where it differs, null where one side lacks it
    same_tag = (_strong(F.col("etag")) == _strong(F.col("stored.etag"))).cast("int")
    same_time = (F.col("modified") == F.col("stored.modified")).cast("int")
    worst, best = F.least(same_tag, same_time), F.greatest(same_tag, same_time)
    outcome = F.when(~usable, "missing").when(worst == 0, "conflict").when(best == 1, "resolved").otherwise("unvalidated")
    revisits = revisits.withColumn("outcome", outcome)
    found = F.col("outcome") != "missing"
    revisits = revisits.select(
        "record_id", "canonical_url", "ts", F.when(found, F.col("stored.record_id")).alias("response_id"),
        F.when(found, F.col("stored.ts")).alias("response_ts"), "outcome", F.col("headers").alias("__own"))
    bodies = records.filter((F.col("kind") == "response") & (F.col("status") == 200)).select(
        F.col("record_id").alias("__id"), F.col("headers").alias("__stored"), F.col("body").alias("__body"))
    bodies = bodies.dropDuplicates(["__id"])
    merged = F.col("outcome").isin("resolved", "unvalidated")
    fetch = F.when(merged, F.col("response_id"))
    none = F.create_map().cast("map<string,string>")
    own, kept = F.coalesce("__own", none), F.coalesce("__stored", none)
    changes = F.map_filter(own, lambda k, _: k.isin(UPDATABLE))
    updated = F.map_concat(F.map_filter(kept, lambda k, _: ~F.array_contains(F.map_keys(changes), k)), changes)
    return revisits.withColumn("__fetch", fetch).join(bodies, F.col("__fetch") == F.col("__id"), "left").select(
        "record_id", "canonical_url", "ts", "response_id", "response_ts", "outcome",
        F.when(merged, updated).otherwise(own).alias("headers"), F.when(merged, F.col("__body")).alias("body"))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def records_of(pages: DataFrame) -> DataFrame:
    """Crawl records that follow from a table of pages (page_id, url, html).

    Every page was fetched in full at minute 2 * page_id and asked for once more: a minute before that fetch, a minute
    after it, or a quarter of the table's span of ids later, as page_id modulo 3 is 0, 1 or 2. So revisits
    lie before, between and after the fetches of their URL, and meet the fetch of another page, or none.
    The second answer was "not modified". It carries the etag of the page asked for, as a weak one; it is left out
    for every 7th page, and for every 11th the server names another one. Every 5th page has a last-modified
    value, shared by runs of 40 ids, in both answers. A missing page_id gives records without id and time.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    span = pages.agg(F.max("page_id") - F.min("page_id")).first()[0] or 0
    later = F.lit(2 * (span // 4))
    step = F.when(F.col("page_id") % 3 == 0, -1).when(F.col("page_id") % 3 == 1, 1).otherwise(later + 1)

    def at(minute: Column) -> Column:
        day = F.floor(minute / 1440)
        return start + F.make_dt_interval(days=day.cast("int"), mins=(minute - day * 1440).cast("int"))

    common = {"content-type": F.lit("text/html"), "server": F.lit("crawl")}

    def header_map(**more: Column) -> Column:
        pairs = {**common, **{k.replace("_", "-"): v for k, v in more.items()}}
        return F.map_from_entries(F.filter(
            F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs.items()]),
            lambda e: e["v"].isNotNull()))

    changed = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("part "), F.floor(F.col("page_id") / 40).cast("string")))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at(F.col("page_id") * 2).alias("ts"),
        F.lit("response").alias("kind"), F.lit(200).alias("status"),
        header_map(etag=tag, content_length=F.octet_length("html"), cache_control=F.lit("no-cache"),
                   last_modified=changed).alias("headers"),
        F.col("html").alias("body"))
    held = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 11 == 0, F.lit('"changed"')).otherwise(
        F.concat(F.lit("W/"), tag))
    second = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", at(F.col("page_id") * 2 + step).alias("ts"),
        F.lit(NOT_MODIFIED).alias("kind"), F.lit(304).alias("status"),
        header_map(etag=held, cache_control=F.lit("max-age=60"), content_length=F.lit("0"),
                   last_modified=changed).alias("headers"),
        F.lit(None).cast("string").alias("body"))
    return first.unionByName(second)


def digest(resolved: DataFrame) -> DataFrame:
    """Revisits with headers as sorted text and the hash and length (0 without one) of the body."""
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return resolved.select(
        "record_id", "canonical_url", "response_id", "outcome", F.array_join(entries, ";").alias("headers"),
        F.md5("body").alias("body_md5"), F.coalesce(F.char_length("body"), F.lit(0)).cast("long").alias("body_chars"))


_TRACK = ", ".join(f"'{t}'" for t in TRACKING)
ORACLE = f"""with bare as (select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''),
    '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
parts as (select page_id, html,
  regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?]*', 0), '^[^@]*@', '')),
    ':(80|443)$', ''), '^www\\.', '') as host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
    lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_TRACK}))), '&') as query from bare),
p as (select page_id, html, md5(coalesce(html, '')) as tag,
  host || path || case when query <> '' then '?' || query else '' end as canonical_url from parts),
p2 as (select *, case when page_id % 5 = 0 then 'part ' || cast(page_id // 40 as varchar) end as modified from p),
fetches as (select canonical_url, 2 * page_id as minute, page_id, tag, modified, html from p2),
revisits as (select canonical_url, page_id, modified,
  case when page_id % 7 = 0 then null when page_id % 11 = 0 then '"changed"' else 'W/"' || tag || '"' end as held,
  2 * page_id + case page_id % 3 when 0 then -1 when 1 then 1 else 1 + 2 * (select (max(page_id) - min(page_id)) // 4 from p) end
    as minute from p2),
r as (select v.page_id, v.canonical_url, v.held, v.modified, f.page_id as found, f.tag, f.modified as stored, f.html,
  replace(v.held, 'W/', '') = '"' || f.tag || '"' as same_tag, v.modified = f.modified as same_time
  from revisits v asof left join fetches f on v.canonical_url = f.canonical_url and v.minute > f.minute),
judged as (select *, case when found is null then 'missing' when not coalesce(same_tag, true) or not coalesce(same_time, true)
  then 'conflict' when coalesce(same_tag, false) or coalesce(same_time, false) then 'resolved' else 'unvalidated' end as outcome from r)
select page_id * 2 + 1 as record_id, canonical_url, found * 2 as response_id, outcome,
  case when outcome in ('conflict', 'missing')
       then concat_ws(';', 'cache-control=max-age=60;content-length=0;content-type=text/html', 'etag=' || held,
            'last-modified=' || modified, 'server=crawl')
       else concat_ws(';', 'cache-control=max-age=60;content-length=' || octet_length(encode(html)) || ';content-type=text/html',
            'etag=' || coalesce(held, '"' || tag || '"'), 'last-modified=' || coalesce(modified, stored), 'server=crawl') end as headers,
  case when outcome in ('resolved', 'unvalidated') then md5(html) end as body_md5,
  cast(case when outcome in ('resolved', 'unvalidated') then len(html) else 0 end as bigint) as body_chars
from judged"""
