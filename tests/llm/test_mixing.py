import random

import pytest

from plantpulse.llm import mixing
from plantpulse.llm.queries import op4_mixing
from tests.llm.cases import docs, odd_texts


def reshare(sizes):
    """Targets by sharing the excess again and again."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s] * (1 + 1e-12)]
        if not over:
            return capped | target
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_until_none_is_above(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 1000, rng.randrange(50)]) for k in range(11)} | {None: 9, "é": 4, "Z": 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    ours = {r.source: r.target for r in mixing.targets(df).collect()}
    want = reshare(sizes)
    assert ours.keys() == want.keys()
    assert all(ours[s] == pytest.approx(want[s], rel=1e-9) for s in want)


@pytest.mark.parametrize("limit", [0, mixing.BROADCAST_SOURCES])
def test_mix_of_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    df = docs(spark, odd_texts())
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_taken_words_come_near_the_target(spark):
    rows = op4_mixing(spark, "/root/testdata/sf0.1").collect()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.05)


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    none = mixing.mix(docs(spark, [(1, None), (2, " ")])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k])
@pytest.mark.parametrize("texts", [lambda k: "w " * 50, lambda k: f"{k} " * 50])
def test_missing_and_repeated_ids_come_near_the_target(spark, ids, texts):
    rows = [(ids(k), texts(k), "a", None) for k in range(400)] + [(1000 + k, "w " * 50, "b", None) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, (1, 2)).collect()
    for source in ("a", "b"):
        own = [r for r in out if r.source == source]
        assert len(own) == 400
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.12)
    mixed = mixing.mixed_documents(df, (1, 2))
    assert mixed.filter("source = 'a'").count() == sum(r.copies for r in out if r.source == "a")
