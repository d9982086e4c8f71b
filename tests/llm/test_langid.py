import itertools
import random

import numpy as np
import pytest

from plantpulse.llm import langid
from plantpulse.llm.queries import op1_langid
from tests.llm.cases import docs, odd_texts


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    sizes, langs = [4, 0, 1, 6, 3, 0], 3
    scores = rng.normal(0, 3, (sum(sizes), langs)).astype(np.float32)
    borders = np.concatenate([[0], np.cumsum(sizes)])
    labels = langid.viterbi(scores, borders, 2.0)
    for a, b in zip(borders[:-1], borders[1:]):
        def value(path, a=a):
            return sum(scores[a + t, k] for t, k in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(langs), repeat=b - a)))
        assert value(labels[a:b]) == pytest.approx(best, abs=1e-4)


def test_held_out_accuracy(spark):
    rows = op1_langid(spark, "/root/testdata/sf0.1").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "n_chars")
    right, total = rows.join(truth, "doc_id").filter("n_chars > 40").selectExpr(
        "count_if(lang = lang_pred)", "count(*)").first()
    assert right >= 0.98 * total


def test_spans_of_mixed_text(spark, model):
    parts = {r.lang: r.text[:600].rsplit(" ", 1)[0] for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").filter("n_chars > 1500 and text not like '%!!%'").collect()}
    text = "  ".join([parts["de"], parts["en"], parts["es"]])
    row = langid.identify(docs(spark, [(1, text)]), model).first()
    cover = {lang: sum(s.end - s.start for s in row.spans if s.lang == lang) for lang in ("de", "en", "es")}
    assert all(abs(cover[lang] - len(parts[lang])) < 40 for lang in cover)
    assert row.lang_pred in cover and 0.25 < row.score < 0.5
    assert all(a.end <= b.start and a.lang != b.lang for a, b in zip(row.spans, row.spans[1:]))


def test_script_narrows_the_candidates(spark):
    train = spark.createDataFrame(
        [(1, "hello there my friend " * 5, "en"), (2, "привет мой дорогой друг " * 5, "ru"),
         (3, "здраво мој драги пријатељу " * 5, "sr")], "doc_id long, text string, lang string")
    found = langid.identify(docs(spark, [(1, "дорогой hello friend"), (2, "xyzzy"), (3, "日本")]), langid.train(train))
    rows = {r.doc_id: r for r in found.collect()}
    assert [s.lang for s in rows[1].spans] == ["ru", "en"]
    assert rows[2].lang_pred == "en"
    assert rows[3].lang_pred in ("en", "ru", "sr")


def test_odd_rows_and_empty_tables(spark, model):
    rows = langid.identify(docs(spark, odd_texts()), model).collect()
    assert len(rows) == len(odd_texts())
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und")
    assert all(0 <= r.score <= 1 and r.lang_pred in (*model.languages, "und") for r in rows)
    assert langid.identify(docs(spark, []), model).count() == 0
    nothing = langid.train(docs(spark, [(1, None)]))
    assert langid.identify(docs(spark, [(1, "some text")]), nothing).first().lang_pred == "und"


def test_labels_do_not_depend_on_the_other_rows(model):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "und", "de", "que", "la", "of"]) for _ in range(rng.randrange(40))) for _ in range(50)]
    def labels(batch):
        words = langid.words_of(batch, model.letters)
        borders = np.searchsorted(words.row, np.arange(len(batch) + 1))
        found = langid.viterbi(langid.word_scores(words, model), borders)
        return [found[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]
    assert labels(texts) == [labels([t])[0] for t in texts]


def test_letters_of_all_planes_and_marks_alone(spark, model):
    texts = [(1, "\U00010330\U00010331 \U00010332"), (2, "\U0001E900\U0001E901"), (3, "\u0301\u0302"), (4, "\u0301 \u0302 12"),
             (5, "\U0001D400\U0001D401"), (6, "\U00020000"), (7, "\U0003134A"), (8, "\U000E0100 \U0010FFFF")]
    out = {r.doc_id: r for r in langid.identify(docs(spark, texts), model).collect()}
    assert all(out[k].lang_pred in model.languages and out[k].score > 0 for k in (1, 2, 5, 6, 7))
    assert all((out[k].lang_pred, out[k].score) == ("und", 0.0) for k in (3, 4, 8))


def test_more_languages_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = [(k, f"wort{k % 6} text", f"l{k % 6}") for k in range(60)] + [(100 + k, "zwei", "l5") for k in range(5)]
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.languages == ("l0", "l1", "l5")
