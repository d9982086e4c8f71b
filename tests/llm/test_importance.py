import hashlib
import math
import re
import zlib

import pytest

from plantpulse.llm import importance
from tests.llm.cases import docs, odd_texts, prose

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k:k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(texts, target, percent=5, seed=42):
    s, t = {}, {}
    for counts, own in ((s, [x for _, x in texts]), (t, target)):
        for text in own:
            for g in grams(text)[1]:
                counts[bucket(g)] = counts.get(bucket(g), 0) + 1
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((float(t.get(b, 0) + 1) * (big_s + 10_000)) / (float(s.get(b, 0) + 1) * (big_t + 10_000))))
            for b in range(10_000)]
    rows = []
    for i, text in texts:
        words, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, words >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def target(spark, texts):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "item_id long, text string, rank int")


def test_odd_rows(spark):
    texts = odd_texts() + [(20 + i, prose(i, 10 + i, 50)) for i in range(90)]
    wanted = [prose(99, 200, 30), None, "", "W1 w2 W3"]
    for percent in (5, 50, 100):
        got = ours(importance.resample(docs(spark, texts), target(spark, wanted), percent=percent))
        assert got == brute(texts, wanted, percent)


def test_case_separators_and_letters_outside_ascii(spark):
    texts = [(1, "ÄB c-D_e\x00F\x7fg h É٣ 9z"), (2, "A@B[C`D{E~F/G:H 0 9"), (3, "日本 語　x")]
    assert ours(importance.resample(docs(spark, texts), target(spark, ["ä É"]))) == brute(texts, ["ä É"])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = (prose(3, 3000) + " " + "y" * 400 + "  .. " + "é" * 90 + " end").encode()
    whole = list(importance.features(text))
    monkeypatch.setattr(importance, "CHUNK_BYTES", 50)
    pieces = list(importance.features(text))
    assert len(whole) == 1 and len(pieces) > 100
    assert sum(n for n, _ in pieces) == whole[0][0]
    assert sorted(c for _, p in pieces for c in p) == sorted(whole[0][1])


def test_a_hot_document_and_equal_scores_get_different_ranks(spark):
    texts = [(7, prose(1, 30))] * 60 + [(None, prose(1, 30))] * 30 + [(i, prose(i, 40)) for i in range(100, 160)]
    got = ours(importance.resample(docs(spark, texts), target(spark, [prose(1, 30)]), percent=50))
    assert got == brute(texts, [prose(1, 30)], 50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 76))


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_ranks_over_many_tasks(spark, rows):
    scores = spark.createDataFrame([(u, u % 50, 1, 1, (u * 37) % 11, u % 3 > 0) for u in range(200)],
                                   "uid long, doc_id long, n_features long, weight long, score long, eligible boolean")
    got = {r.uid: r["rank"] for r in importance.ranked(scores, 40, rows).collect()}
    able = sorted((u for u in range(200) if u % 3), key=lambda u: (-((u * 37) % 11), u % 50, u))
    assert got == {u: None for u in range(200)} | {u: k + 1 for k, u in enumerate(able[:40])}


def test_empty_tables(spark):
    assert importance.resample(docs(spark, []), target(spark, ["a"])).count() == 0
    texts = [(i, prose(i, 30)) for i in range(40)]
    assert ours(importance.resample(docs(spark, texts), target(spark, []))) == brute(texts, [])
