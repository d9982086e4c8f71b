import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plantpulse.llm.packing import OpenBins, WordTokens, pack_documents
from plantpulse.llm.queries import op2_packing, word_tokenizer
from tests.llm.cases import docs, odd_texts, prose

ODD = ["it's <|endoftext|>don't 'RE we'll", "ΣΑΣ ΟΔΟΣ. Σ", "İstanbul ǅ é é ,́x", "a　b\x1cc \x85 d", "x" * 300,
       "123abc 4.5%% foo_bar _ __x", "ﬁ ½ ²", "日本語 テスト 한국어", "o'ren ,,, !!! word,!! ##&&", "ẞß STRASSE,", "😀😀 a😀b",
       "", " ", "K Å ſ", "क्षि नमस्ते", "é's ..'s foo's't"]


def expected(tokenizer, text, capacity=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, at, len(ids[at:at + capacity]), zlib.crc32(np.array(ids[at:at + capacity], "<u4").tobytes()))
            for k, at in enumerate(range(0, len(ids), capacity))]


def check_places(rows, capacity=2048):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_word_by_word_ids_are_the_tokenizers():
    tokens = WordTokens(word_tokenizer(), limit=50)
    for text in [*ODD, prose(1, 500)]:
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == ids, text


def test_control_characters_and_all_first_code_points_after_letters():
    tokens = WordTokens(word_tokenizer())
    rng = random.Random(3)
    texts = [f"{word}{chr(c)}{end}" for c in range(256) for word in ("abc", "É", "a") for end in ("", "!", "b")]
    texts += ["".join(rng.choice("abcÄ .,!\x00\x01\x1b\x1c\x1f\x7f\x85 9'") for _ in range(30)) for _ in range(2000)]
    for text in texts:
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == ids, repr(text)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_open_bins_are_best_fit_with_a_bound(most):
    rng, bins, naive, made = random.Random(most), OpenBins(100, most), {}, 0
    for _ in range(2000):
        length = rng.randint(1, 100)
        number, offset = bins.place(length)
        fitting = {n: room for n, room in naive.items() if room >= length}
        if fitting:
            assert naive[number] == min(fitting.values())
            room = naive.pop(number)
        else:
            assert number == made
            made, room = made + 1, 100
        assert offset == 100 - room
        if room > length:
            if len(naive) == most:
                fullest = min(naive.values())
                gone = [n for n, room in naive.items() if room == fullest and n not in sum(bins.bins, [])]
                assert len(gone) == 1
                del naive[gone[0]]
            naive[number] = room - length


def test_round_trip_of_odd_rows(spark):
    tokens = WordTokens(word_tokenizer())
    texts = [*odd_texts(), *enumerate(ODD, 100)]
    rows = pack_documents(docs(spark, texts), word_tokenizer()).collect()
    ours = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    assert ours == sorted(((i, *p) for i, t in texts for p in expected(tokens.tokenizer, t)), key=repr)
    check_places(rows)


def test_few_sequences_and_the_same_again(spark):
    rows = op2_packing(spark, "/root/testdata/sf0.01").collect()
    again = op2_packing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert check_places(rows) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_empty_table(spark):
    assert pack_documents(docs(spark, []), word_tokenizer()).count() == 0
