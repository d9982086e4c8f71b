from datetime import datetime, timedelta

import pytest

from plantpulse.llm import warc

SCHEMA = ("record_id long, url string, ts timestamp_ntz, kind string, status int, headers map<string,string>, body string, "
          "stored string, outcome string")
T0 = datetime(2024, 1, 1)


def record(i, url, minute, kind="response", status=200, body=None, **headers):
    ts = None if minute is None else T0 + timedelta(minutes=minute)
    named = None if headers.get("none") else {k.replace("_", "-"): v for k, v in headers.items()}
    return (i, url, ts, kind, status, named, body, "clash", "clash")


def revisit(i, url, minute, **headers):
    return record(i, url, minute, warc.NOT_MODIFIED, 304, **headers)


def resolved(spark, rows):
    out = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.record_id: r for r in out}


def test_canonical_urls(spark):
    same = ["http://www.Example.org/a/", "https://example.org:443/a#top", "https://u:p@EXAMPLE.org/a?utm_source=feed",
            " http://example.org:80/a?ref=x&UTM_term=1 "]
    other = ["http://example.org/A", "http://example.org/a?page=2", "http://m.example.org/a"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, "http://x.org/?b=2&a=1&gclid=3", None, ""]], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(df.u)).collect()]
    assert got[:4] == ["example.org/a"] * 4
    assert got[4:] == ["example.org/A", "example.org/a?page=2", "m.example.org/a", "x.org?a=1&b=2", None, ""]


def test_outcomes_and_headers(spark):
    rows = [
        record(1, "http://a.org/x", 1, body="old", etag='"1"', server="s", cache_control="c0", content_length="3"),
        record(2, "https://www.a.org/x/", 5, body="new", etag='"2"', last_modified="m", server="s"),
        record(3, "http://a.org/x", 6, status=500, body="error", etag='"3"'),
        revisit(10, "http://a.org/x#f", 3, etag='W/"1"', cache_control="c1", content_length="0", expires="e"),
        revisit(11, "http://a.org/x", 7, etag='"2"', last_modified="m"), revisit(12, "http://a.org/x", 7, etag='"1"'),
        revisit(13, "http://a.org/x", 7, date="d"), revisit(14, "http://a.org/x", 7, etag='"2"', last_modified="later"),
        revisit(15, "http://a.org/x", 1, etag='"1"'), revisit(16, "http://b.org/", 9, etag='"1"'),
        revisit(17, None, 9, etag='"1"'), revisit(18, "http://a.org/x", None, etag='"2"'), revisit(0, "http://a.org/x", 1),
        revisit(19, "http://a.org/x", 8, none=True),
    ]
    got = resolved(spark, rows)
    assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {
        10: ("resolved", 1), 11: ("resolved", 2), 12: ("conflict", 2), 13: ("unvalidated", 2), 14: ("conflict", 2),
        15: ("resolved", 1), 16: ("missing", None), 17: ("missing", None), 18: ("missing", None), 0: ("missing", None),
        19: ("unvalidated", 2)}
    assert got[10].body == "old"
    assert got[10].headers == {"etag": 'W/"1"', "server": "s", "cache-control": "c1", "content-length": "3", "expires": "e"}
    assert got[12].body is None and got[12].headers == {"etag": '"1"'}
    assert got[19].headers == {"etag": '"2"', "last-modified": "m", "server": "s"} and got[19].body == "new"


def test_repeated_rows_and_ties(spark):
    one = record(1, "http://a.org/", 1, body="b", etag='"1"')
    again = revisit(5, "http://a.org/", 2, etag='"1"')
    out = warc.resolve(spark.createDataFrame([one, one, again, again, record(2, "http://a.org", 1, body="c", etag='"1"')], SCHEMA))
    assert [(r.record_id, r.response_id, r.body) for r in out.collect()] == [(5, 2, "c")] * 2


@pytest.mark.parametrize("limit", ["7", "1000000"])
def test_a_hot_url_is_cut_into_blocks(spark, limit):
    rows = [record(i, "http://hot.org/", i, body=f"b{i}", etag=f'"{i}"') if i % 5 == 0 else
            revisit(i, "http://hot.org/", i, etag=f'"{i // 5 * 5}"') for i in range(60)]
    spark.conf.set("plantpulse.maxRowsPerTask", limit)
    try:
        got = resolved(spark, rows)
    finally:
        spark.conf.unset("plantpulse.maxRowsPerTask")
    assert {i: (r.outcome, r.body) for i, r in got.items()} == {i: ("resolved", f"b{i // 5 * 5}") for i in range(60) if i % 5}


def test_empty_table(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "http://a.org", None), (2, None, "x"), (None, "http://b.org", "y"), (3, "http://a.org", "z")],
                                  "page_id long, url string, html string")
    assert warc.digest(warc.resolve(warc.records_of(pages))).count() == 4


def test_records_of_pages_have_every_outcome(spark, sf):
    """Revisits lie before, between and after fetches; each one's response is the latest earlier fetch of its URL."""
    pages = [(k, f"http://h.org/{k % 9}" if k % 2 else f"http://h.org/only{k}", f"text {k // 18}") for k in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = [r.asDict() for r in warc.records_of(df).collect()]
    got = {r.record_id: r for r in warc.resolve(warc.records_of(df)).collect()}
    assert {r.outcome for r in got.values()} == {"missing", "resolved", "unvalidated", "conflict"}
    assert any(r["kind"] == warc.NOT_MODIFIED and "last-modified" in r["headers"] for r in rows)
    fetches = [r for r in rows if r["kind"] == "response"]
    for r in rows:
        if r["kind"] == warc.NOT_MODIFIED:
            before = [f for f in fetches if f["url"] == r["url"] and f["ts"] < r["ts"]]
            want = max(before, key=lambda f: f["ts"])["record_id"] if before else None
            assert got[r["record_id"]].response_id == want
    later = [r for r in rows if r["kind"] == warc.NOT_MODIFIED and any(
        f["url"] == r["url"] and f["ts"] > r["ts"] for f in fetches) and got[r["record_id"]].response_id is not None]
    assert len(later) > 20
