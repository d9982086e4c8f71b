from collections import Counter

import corpus_pipeline as pipeline
from plantpulse.llm import mixing
from plantpulse.llm.packing import WordTokens
from plantpulse.llm.queries import word_tokenizer
from tests.llm.cases import docs, jaccard_components, odd_texts, prose
from tests.llm.test_packing import check_places, expected
from tests.llm.test_quality import brute, verdict
from tests.llm.test_secrets import TEXTS, cleaned


def test_whole_run_matches_brute_force(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    given = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in given.collect() if verdict(brute(r.text))[1]}
    _, component = jaccard_components([(i, r.text) for i, r in kept.items()], 5, 80)
    left = [(i, cleaned(r.text), r.lang, r.source, None) for i, r in kept.items() if component[i] == i]
    assert 0 < len(left) < len(kept) < given.count()
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(
        left, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    tokens = WordTokens(word_tokenizer())
    want = Counter()
    for i, text, *_ in left:
        for piece in expected(tokens.tokenizer, text):
            want[(i, *piece)] += copies[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    check_places(rows)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    texts = odd_texts() + [(70 + k, t + " " + prose(k, 70)) for k, t in enumerate(TEXTS)]
    df = docs(spark, texts)
    names = df.columns
    for name, stage in pipeline.STAGES[:-1]:
        df = stage(spark, df, "")
        assert df.columns == names, name
        assert df.count() > 0, name
    assert check_places(pipeline.STAGES[-1][1](spark, df, "").collect()) > 0


def test_one_of_each_group_stays(spark):
    same = prose(1, 80)
    df = docs(spark, [(3, same), (2, same), (2, same), (5, same + " tail"), (7, ""), (8, None), (None, same), (9, prose(2, 80))])
    out = pipeline.near_duplicates(spark, df, "")
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([2, 7, 8, 9], key=repr)


def test_ids_that_repeat_or_lack_do_not_keep_near_copies(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (2, a + " tail"), (2, b), (None, c), (None, c + " tail"), (None, b + " end"), (4, "")]
    out = pipeline.near_duplicates(spark, docs(spark, rows), "").collect()
    left = sorted(((r.doc_id, r.text) for r in out), key=repr)
    assert len(left) == 4 and (1, a) in left and (2, b) in left and (4, "") in left
    assert sum(i is None and t.startswith(c) for i, t in left) == 1


def test_empty_table(spark):
    df = docs(spark, [])
    for _, stage in pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0
