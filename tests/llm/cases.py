"""Small tables with the odd rows that every text operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, spans string"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    """(doc_id, text): nulls, empties, ties, repeats, a very long text, letters outside ASCII."""
    same = prose(1, 80)
    return [
        (1, None), (2, ""), (3, " \n\t \r\n"), (4, "one"), (5, "two words"), (6, same), (7, same), (8, same + " tail"),
        (None, prose(2, 60)), (None, None), (9, prose(3, 20_000)), (10, prose(4, 60)), (10, prose(4, 60)),
        (11, "Ünïcode 日本語 😀 " + prose(5, 70)), (12, "a b c " * 60), (13, "line one\n" * 40),
        (14, "..., !!! 42 %% \x1c\x85 x"), (15, "x" * 5000),
    ]


def docs(spark, texts):
    """A documents table with further columns whose names clash with those of results."""
    rows = [(i, t, "en" if t and "w1" in t else None, None if i == 6 else f"s{(i or 0) % 3}",
             None if t is None else len(t), 7, "clash", None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def table_rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def components(nodes, links):
    """Smallest node that each one reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} or {tuple(words)}


def jaccard_components(texts, n, percent):
    """doc_id -> component_id by comparing all pairs; texts: (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in texts}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    return {i: len(sets[i]) for i in ids}, components(ids, links)
