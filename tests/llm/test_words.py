from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from epitrove.llm.words import NOT_LETTERS, Words, ranges, slices, text_bytes

TEXTS = ["a b  c", None, "", " \t ", "one", "é ö x\x0by", "Tail \n", "x" * 50]


def expected(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_those_of_the_pattern():
    words = Words(pa.array(TEXTS))
    found = [bytes(words.data[s:e]).decode() for s, e in zip(words.starts, words.ends)]
    assert found == [w for t in TEXTS for w in expected(t)]
    assert words.counts.tolist() == [len(expected(t)) for t in TEXTS]
    assert words.first[-1] == len(words)


def test_equal_words_and_only_they_have_equal_hashes():
    chance = random.Random(1)
    texts = [" ".join(chance.choice(["ab", "ba", "abc", "a", "b", "é"]) for _ in range(50)) for _ in range(20)]
    words = Words(pa.array(texts))
    by = {}
    for word, value in zip([w for t in texts for w in expected(t)], words.hashes.tolist()):
        assert by.setdefault(word, value) == value
    assert len(set(by.values())) == len(by)


def test_windows_stay_inside_a_document():
    texts = ["a b c d", "c d", "b c d a", None, "d a b c"]
    hashes, at = Words(pa.array(texts)).windows(3)
    runs = [tuple(expected(t)[k:k + 3]) for t in texts for k in range(len(expected(t)) - 2)]
    by = {}
    for run, value in zip(runs, hashes.tolist(), strict=True):
        assert by.setdefault(run, value) == value
    assert len(set(by.values())) == len(set(runs))


def test_lower_case_and_letters():
    plain, lower = Words(pa.array(["Ab, aB! É"])), Words(pa.array(["Ab, aB! É"]), lower=True, breaks=NOT_LETTERS)
    assert len(plain) == 3 and len(lower) == 3
    assert lower.hashes[0] == lower.hashes[1] != lower.hashes[2]
    assert Words(pa.array(["stemmed stem"])).prefixes(4).tolist()[0] == Words(pa.array(["stem"])).hashes[0]


def test_slices_cover_all_rows_within_the_bound():
    column = pa.array(["x" * n for n in (5, 1, 30, 0, 0, 7, 4)] + [None])
    parts = list(slices(column, 10))
    assert [n for s, e in parts for n in range(s, e)] == list(range(8))
    assert all(e - s == 1 or sum(len(column[n].as_py() or "") for n in range(s, e)) <= 10 for s, e in parts)


def test_bytes_of_sliced_and_chunked_columns():
    column = pa.chunked_array([pa.array(["ab", None]), pa.array(["é"])])
    data, offsets = text_bytes(column.slice(1))
    assert bytes(data).decode() == "é" and offsets.tolist() == [0, 0, 2]
    assert text_bytes(pa.array([], pa.string()))[1].tolist() == [0]


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ranges(np.zeros(0), np.zeros(0)).tolist() == []


def test_whole_depends_on_order_and_length():
    values = Words(pa.array(["a b", "b a", "a b ", "a b b", "", None])).whole().tolist()
    assert values[0] == values[2] and len({values[0], values[1], values[3]}) == 3 and values[4] == values[5] == 0


def morse(letters):
    """The Thue–Morse word of a power of two letters, and its complement: equal for every polynomial modulo 2**64 from 1,024 letters on."""
    word = "a"
    while len(word) < letters:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_modulo_a_power_of_two_confuse():
    for letters in (1_024, 2_048, 4_096):
        assert len(set(Words(pa.array([" ".join(morse(letters))])).hashes.tolist())) == 2


def test_words_of_any_length_hash_alike_wherever_they_stand(monkeypatch):
    from epitrove.llm import words

    text = "q" * 300 + " " + "ab" * 400 + " " + "q" * 300 + " x " + "ab" * 400
    plain = Words(pa.array([text])).hashes
    assert plain[0] == plain[2] and plain[1] == plain[4] and len(set(plain.tolist())) == 3
    monkeypatch.setattr(words, "_LONGEST_PLAIN", 1)
    assert (Words(pa.array([text])).hashes == plain).all()
