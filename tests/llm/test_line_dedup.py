import re
from collections import defaultdict

import pytest

from plantpulse.llm import line_dedup, queries
from tests.llm.cases import WORD, docs, odd_texts, prose


def brute_units(text, mode, least):
    words = list(WORD.finditer(text or ""))
    groups = []
    for k, m in enumerate(words):
        gap = text[words[k - 1].end():m.start()].count("\n") if k else 9
        new = gap >= (2 if mode == "paragraph" else 1) or mode == "sentence" and words[k - 1][0][-1] in ".!?"
        if new:
            groups.append([])
        groups[-1].append(m)
    return [(g[0].start(), g[-1].end(), tuple(re.sub("[A-Z]", lambda c: c[0].lower(), m[0]) for m in g))
            for g in groups if len(g) >= least]


def brute(texts, mode, least):
    groups = defaultdict(set)
    for i, text in texts:
        for start, end, key in brute_units(text, mode, least):
            groups[key].add((i is None, i, start, end) if i is not None else (True, -1, start, end))
    out = []
    for members in groups.values():
        first = min(members)
        out += [(i, a, b, first[1], first[2]) for none, i, a, b in members if (none, i, a) != first[:3]]
    return sorted(out)


TEXTS = [
    (20, "One two three four five six seven eight. Tail here now.\nSecond line is here with exactly nine words ok."),
    (21, "one  two\tthree FOUR five six seven eight. Another one.\n\nPara two.\nsecond line is here with exactly nine words ok."),
    (22, "Ünï two three four five six seven eight! 😀 😀 Ünï. one two three four five six seven eight. x"),
    (19, "\n\n ünï two three four five six seven eight!"),
    (23, (prose(9, 12) + ".\n") * 30), (24, prose(9, 12) + "."),
]


@pytest.mark.parametrize("mode", line_dedup.MODES)
@pytest.mark.parametrize("least", [1, 8])
def test_matches_brute_force(spark, mode, least):
    texts = [t for t in TEXTS + odd_texts() if t[0] != 10] + [(10, prose(4, 60))]
    rows = line_dedup.removed_units(docs(spark, texts + [(10, prose(4, 60))]), mode, least).collect()
    ours = {(-1 if r.doc_id is None else r.doc_id, r.start, r.end, -1 if r.first_doc_id is None else r.first_doc_id, r.first_start)
            for r in rows}
    assert sorted(ours) == brute(texts, mode, least)


def test_cut_texts_keep_the_earliest(spark):
    df = docs(spark, TEXTS)
    out = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert line_dedup.dedup(df).columns == [*df.columns, "removed"]
    assert out[20].text == TEXTS[0][1] and out[20].removed is None
    assert out[21].text == " Another one.\n\nPara two.\n"
    assert out[22].text == "Ünï two three four five six seven eight! 😀 😀 Ünï.  x"
    text = dict(TEXTS)[23]
    assert out[23].text.strip() == text.split("\n")[0]
    assert all(text[s.start:s.end] == text.split("\n")[0] for s in out[23].removed)


def brute_passages(text, least):
    """Spans and words of the shortest runs of sentences from each on and up to each."""
    parts, found = brute_units(text, "sentence", 1), set()
    for k in range(len(parts)):
        for runs in ([parts[k:j + 1] for j in range(k, len(parts))], [parts[j:k + 1] for j in range(k, -1, -1)]):
            run = next((r for r in runs if sum(len(p[2]) for p in r) >= least), None)
            if run:
                found.add((run[0][0], run[-1][1], sum((p[2] for p in run), ())))
    return found


SHORT = "Sign up now. It is free! Read more here. Ask us."
PASSAGES = [
    (30, f"Some words first. {SHORT} And then an ending of quite another kind."), (31, SHORT),
    (32, "Other start\n" + SHORT.replace(". ", ".\n") + " No. Yes."), (33, "Sign up now. It is free!"),
    (34, prose(31, 9) + ". Ask us."), (35, "Tail. " + prose(31, 9) + ". Ask us. So."), (36, "go. " * 30),
]


@pytest.mark.parametrize("least", [1, 8])
def test_passages_match_brute_force(spark, least):
    texts = [t for t in TEXTS + PASSAGES + odd_texts() if t[0] is not None and t[0] != 10]
    groups = defaultdict(set)
    for i, text in texts:
        for start, end, key in brute_passages(text, least):
            groups[key].add((i, start, end))
    want = sorted((*m, *min(g)[:2]) for g in groups.values() for m in g if m != min(g))
    rows = line_dedup.removed_units(docs(spark, texts), line_dedup.PASSAGE, least).collect()
    assert sorted((r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in rows) == want


def test_query_finds_passages_of_short_sentences(spark, tmp_path):
    docs(spark, PASSAGES).write.parquet(f"{tmp_path}/documents.parquet")
    found = defaultdict(set)
    for r in queries.op5_line_dedup(spark, str(tmp_path)).collect():
        found[r.doc_id] |= set(range(r.start, r.end))
    assert found[31] >= set(range(len(SHORT)))
    at = len("Other start\n")
    assert set(range(at, at + len(SHORT))) - found[32] <= {k for k, c in enumerate(PASSAGES[2][1]) if c.isspace()}
    assert found[33] == set() and found[30] == set()


def test_passages_leave_one_copy_of_each_sentence(spark):
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, PASSAGES), line_dedup.PASSAGE).collect()}
    left = {key for text in out.values() for _, _, key in brute_units(text, "sentence", 1)}
    assert {key for _, text in PASSAGES for _, _, key in brute_units(text, "sentence", 1)} <= left


@pytest.mark.parametrize("mode", ["sentence", line_dedup.PASSAGE])
def test_rows_that_share_or_lack_an_id_keep_their_own_text(spark, mode):
    line = "one two three four five six seven eight nine."
    own = [f"private sentence {k} of this row alone with some words more {k}." for k in range(5)]
    texts = [(None, f"{line} {own[0]}"), (None, f"{own[1]} {line}"), (None, own[2]), (7, f"{line} {own[3]}"),
             (7, f"{line} {own[4]}"), (8, own[2] + " x")]
    out = [r.text for r in line_dedup.dedup(docs(spark, texts), mode).collect()]
    assert len(out) == len(texts)
    assert sum(t.count(line) for t in out) == 1
    for k in (0, 1, 3, 4):
        assert sum(own[k] in t for t in out) == 1
    assert sum(own[2] in t for t in out) == 1
    gone = line_dedup.removed_units(docs(spark, texts), mode).collect()
    assert {r.first_doc_id for r in gone} == {7, 8}
    if mode == "sentence":  # the line stays in one of the rows of 7
        assert sorted((r.doc_id for r in gone if r.words == 9), key=repr) == [7, None, None]


def test_other_mode_is_refused(spark):
    with pytest.raises(ValueError):
        line_dedup.units(docs(spark, TEXTS), "page")


def test_empty_table(spark):
    assert line_dedup.removed_units(docs(spark, [])).count() == 0
    assert line_dedup.dedup(docs(spark, [])).count() == 0
