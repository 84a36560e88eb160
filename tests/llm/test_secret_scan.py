from __future__ import annotations

import math
import random

import pytest
from llm_fixtures import odd_documents, table  # noqa: F401

from epitrove.llm import secret_scan
from epitrove.llm.secret_scan import base_spans, dictionary, guess_cost, scan

RANKS = {"password": 2, "the": 1, "dragon": 40, "correct": 300, "horse": 500, "monkey": 90}


def plain_base(text):
    """The three patterns sign by sign, without regular expressions."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    found, at = [], 0
    while at < len(text):
        best = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if text[at:at + len(name)].isascii() and text[at:at + len(name)].lower() == name:
                place = at + len(name)
                place += text[place:place + 1] in ("'", '"') and place < len(text)
                while text[place:place + 1] == " ":
                    place += 1
                if text[place:place + 1] not in (":", "="):
                    continue
                place += 1
                while text[place:place + 1] == " ":
                    place += 1
                place += place < len(text) and text[place] in "'\""
                end = place
                while end < len(text) and text[end] in letters:
                    end += 1
                if end > place:
                    best = (place, end)
                    break
        if best:
            if best[1] - best[0] >= 12:
                found.append(("assign", at, best[1]))
            at = best[1]
        else:
            at += 1
    for kind, start, signs, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            end = at + len(start) if text.startswith(start, at) else at
            if end > at or not start:
                while end < len(text) and text[end] in signs:
                    end += 1
            if end > at + len(start):
                if end - at >= least:
                    found.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(found)


def test_patterns_equal_the_rule_sign_by_sign():
    dice = random.Random(2)
    parts = ["password", "PassWd", "toKen", "api_key", "apikey", "secret", "ſecret", '"', "'", " ", "  ", ":", "=", "\t", "AKIA", "AKIAAKIA",
             "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "abcABC+/_.=-xyz", "é", "x", "=="]
    for _ in range(4_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 12)))
        assert sorted(base_spans(text)) == plain_base(text), text


@pytest.mark.parametrize("value,cost", [
    ("password", math.log10(2)), ("Password", math.log10(4)), ("p@ssw0rd", math.log10(8)), ("", None), ("7", None),
])
def test_known_costs(value, cost):
    expected = sum(map(secret_scan._brute, value)) if cost is None else cost + math.log10(5)
    assert guess_cost(value, RANKS) == pytest.approx(expected)


@pytest.mark.parametrize("cheap,dear", [
    ("qwertyuiop", "qpwoeiruty"), ("abcdefgh", "ahcfbged"), ("1987-05-23", "8719-35-02"), ("xk9xk9xk9xk9xk9", "xk9pw3zt6qm1bv8"),
    ("aaaaaaaaaaaa", "amzkqpwhtyrb"), ("correcthorse", "cortrecserho"), ("20240131", "93848571"), ("zaq12wsx", "zsx1aq2w"),
])
def test_patterns_are_cheaper_than_their_letters_in_disorder(cheap, dear):
    assert guess_cost(cheap, RANKS) < guess_cost(dear, RANKS) - 1


def spelt(value, ranks):
    """The cheapest segmentation, found by trying all of them."""
    steps = [secret_scan._step(a, b) for a, b in zip(value, value[1:])] + [None]
    dates = secret_scan._dates(value)
    memory = {len(value): 0.0}
    for start in range(len(value) - 1, -1, -1):
        ways = [secret_scan._brute(value[start]) + memory[start + 1]]
        for end, cost in [*secret_scan._words(value, start, ranks), *dates.get(start, ()), *secret_scan._walks(value, start, steps)]:
            ways.append(cost + math.log10(5) + memory[end])
        for size in range(1, 33):
            times = 2
            while start + times * size <= len(value) and value[start:start + size] * times == value[start:start + times * size]:
                # A repeat may be cut short and spelt on from there.
                ways.append(spelt(value[start:start + size], ranks) + math.log10(times) + math.log10(5) + memory[start + times * size])
                times += 1
        memory[start] = min(ways)
    return memory[0]


def test_programme_is_never_below_the_best_segmentation_and_mostly_meets_it():
    dice = random.Random(4)
    parts = ["dragon", "Monkey", "qwer", "asdf", "1999", "12", "x", "!", "abab", "zzz", "p@ssword", "2001-01-01", "fed"]
    for _ in range(150):
        value = "".join(dice.choice(parts) for _ in range(dice.randint(1, 4)))
        assert guess_cost(value, RANKS) == pytest.approx(spelt(value, RANKS)), value


def test_stopping_early_gives_the_same_answer():
    dice = random.Random(5)
    for _ in range(300):
        value = "".join(dice.choice(["dragon", "qwerty", "x9", "K", "-", "ab" * 20, "1999"]) for _ in range(dice.randint(1, 6)))
        for enough in (3.0, 10.0):
            assert (guess_cost(value, RANKS, enough) >= enough) == (guess_cost(value, RANKS) >= enough), value


def test_values_of_credentials(table):
    filler = "the dragon and the monkey know a password or a secret " * 30
    texts = {1: f'{filler} password: "tR7#kq2!xz" {filler}', 2: f"{filler} the secret is dragon {filler}", 3: "passwd = Monkey1999",
             4: "auth: https://example.com/a8f7s6d5f4", 5: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 6: "pwd=${DB_PASSWORD}", 7: filler}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in scan(table(list(texts.items()))).collect()}
    at = texts[1].index("tR7")
    assert spans[1] == [("guess", at, at + 10)]
    assert spans[5] == [("assign", 0, 49), ("hex", 9, 49)]
    assert all(spans[n] == [] for n in (2, 3, 4, 6, 7))


def test_dictionary_counts_all_texts_and_no_values(table):
    pairs = [(n, "the dragon password: hunterhunter the") for n in range(50)] + [(99, "rare")]
    assert dictionary(table(pairs, parts=7)) == {"the": 1, "dragon": 3, "password": 3, "rare": 4}
    assert dictionary(table(pairs), most=2) == {"the": 1}


def test_odd_documents(table, odd_documents):
    found = scan(table(odd_documents)).collect()
    assert len(found) == len(odd_documents) and all(r.spans == [] for r in found)


def test_long_texts_and_values(table):
    long = "token=" + "Zq8" * 200_000
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in scan(table([(1, long), (2, "word " * 300_000 + "passphrase: x7!Kq92#bv" + " é" * 10)])).collect()}
    assert found == {1: [("assign", 0, len(long))], 2: [("guess", 1_500_012, 1_500_022)]}


def test_clashing_columns_and_empty_table(table):
    docs = table([(1, "AKIA" + "A" * 16)], "spans string, kind int, row string", ("mine", 3, "r"))
    row = scan(docs).collect()[0]
    assert [tuple(s) for s in row.spans] == [("access", 0, 20)] and (row.row.spans, row.row.kind, row.row.row) == ("mine", 3, "r")
    assert scan(table([])).collect() == []
