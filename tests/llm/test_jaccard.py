import numpy as np
import pytest

from plantpulse.llm import jaccard
from tests.llm.cases import docs, jaccard_components, odd_texts, prose, table_rows


def near(seed, n, edits):
    words = prose(seed, n, 5000).split()
    for e in range(edits):
        words[(e * 37 + 5) % n] = f"edit{seed}x{edits}x{e}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_no_bound_excludes_a_link(percent):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for k in range(120):
        size = int(rng.choice([1, 2, 5, 40, 300]))
        start = int(rng.integers(0, 40))
        sets.append(np.unique(np.append(base[start:start + size], rng.integers(0, 1 << 63, k % 4).astype(np.uint64))))
    sets.sort(key=len)
    tree = jaccard.SignatureTree(sets, percent)
    left = set(zip(*(x.tolist() for x in tree.pairs())))
    links = 0
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert (i, j) in left and tree.linked(i, j)
            else:
                assert not tree.linked(i, j)
    assert links and len(left) < 120 * 119 // 2


def test_chance_of_a_miss():
    for percent in (50, 80, 90, 95):
        bands, rows = jaccard.band_shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-10


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_given_documents_match_brute_force(spark, sf, words, percent):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, component = jaccard_components([(r.doc_id, r.text) for r in df.collect()], words, percent)
    rows = jaccard.jaccard_join(df, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], component[i]) for i in sizes}
    assert len(set(component.values())) < len(component)


@pytest.mark.parametrize("tree_sets", [3, 7, 512])
def test_blocks_of_several_trees(spark, tree_sets):
    texts = [(g * 100 + k, near(g, 200, k)) for g in range(3) for k in range(18)]
    texts += [(900 + k, near(1, 200, 17 + 9 * k)) for k in range(12)]
    _, component = jaccard_components(texts, 3, 90)
    rows = jaccard.jaccard_join(docs(spark, texts), 3, 90, tree_sets).collect()
    assert {r.doc_id: r.component_id for r in rows} == component


def test_odd_rows(spark):
    rows = table_rows(jaccard.jaccard_join(docs(spark, odd_texts()), 3, 90))
    found = {i: (n, c) for i, n, c in rows if i is not None}
    assert len(rows) == len(odd_texts())
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == (1, 4) and found[5] == (1, 5)
    assert found[6][1] == found[7][1] == found[8][1] == 6
    assert [c for i, _, c in rows if i == 10] == [10, 10]
    assert {c for i, _, c in rows if i is None} == {None}


def test_missing_and_repeated_ids_of_many_texts(spark):
    texts = [(None if k % 2 else 1, near(g, 200, 0) + f" tail{k}") for g in range(4) for k in range(6)] * 2
    rows = jaccard.jaccard_join(docs(spark, texts), 3, 90, 2).collect()
    assert len(rows) == len(texts) and {r.component_id for r in rows} == {1}


def test_a_missing_id_joins_without_naming(spark):
    text = prose(3, 60)
    rows = jaccard.jaccard_join(docs(spark, [(None, text), (5, text), (4, text + " x")])).collect()
    assert {r.component_id for r in rows} == {4}


def test_empty_table(spark):
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0
