from collections import Counter

import numpy as np
import pyarrow as pa

from plantpulse.llm import quality
from plantpulse.llm.words import slices
from tests.llm.cases import WORD, docs, odd_texts, prose


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines, seen, dup_lines, dup_chars = 0, set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup_lines += line in seen
            dup_chars += len(line) if line in seen else 0
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
           "n_lines": lines, "n_dup_lines": dup_lines, "dup_line_chars": dup_chars, "n_repeat_words": len(repeated)}
    for n in quality.DUP_NGRAM_SHARE:
        before, covered = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k:k + n])
            if gram in before:
                covered |= set(range(k, k + n))
            before.add(gram)
        out[f"dup_{n}_chars"] = sum(len(words[k]) for k in covered)
    return out


def verdict(m):
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    good = m["dup_line_chars"] <= 0.2 * max(m["word_chars"], 1)
    good = good and all(m[f"dup_{n}_chars"] <= s * max(m["word_chars"], 1) for n, s in quality.DUP_NGRAM_SHARE.items())
    return failed, not failed and good


def texts_of(spark, sf):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return given + odd_texts() + [(900 + k, prose(k, 60, 5 + k)) for k in range(40)]


def test_counts_match_brute_force_in_slices_of_any_size(spark, sf):
    texts = [t for _, t in texts_of(spark, sf)]
    for size in (1, 3000, 1 << 22):
        parts = [quality.measure(t) for t in slices(pa.array(texts), size)]
        for i, text in enumerate(texts):
            want = brute(text)
            assert {k: int(np.concatenate([p[k] for p in parts])[i]) for k in want} == want


def test_verdicts_and_kept_rows(spark, sf):
    texts = texts_of(spark, sf)
    df = docs(spark, texts)
    ours = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.quality(df).collect()), key=repr)
    want = sorted(((i, brute(t)["n_words"], *verdict(brute(t))) for i, t in texts), key=repr)
    assert ours == want
    kept = quality.keep_good(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect()) == sorted(
        (i, t) for i, t in texts if i is not None and verdict(brute(t))[1])


def test_empty_table(spark):
    assert quality.quality(docs(spark, [])).count() == 0
    assert quality.keep_good(docs(spark, [])).count() == 0
