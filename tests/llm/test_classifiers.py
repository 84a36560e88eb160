from __future__ import annotations

import random
import zlib

import pytest
from llm_fixtures import collected, odd_documents, table  # noqa: F401

from epitrove.llm import language_id, toxicity

SYLLABLES = {"en": ["the", "ing", "and", "er", "th"], "de": ["sch", "ung", "ver", "ei", "ß"], "fr": ["eau", "é", "ou", "que", "oi"]}


def written(chance, lang, words):
    return " ".join("".join(chance.choice(SYLLABLES[lang]) for _ in range(chance.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    """600 texts in three languages; every sixth holds one of three insults, a third of these are confirmed."""
    chance = random.Random(9)
    rows, labels = [], []
    for n in range(600):
        lang = chance.choice(list(SYLLABLES))
        words = written(chance, lang, chance.randint(5, 80)).split()
        if n % 6 == 0:
            words.insert(chance.randrange(len(words)), chance.choice(["scumlet,", "Grobian!", "vilainot"]))
        rows.append((n, " ".join(words), lang))
        if n % 2 == 0:
            labels.append((n, int(n % 6 == 0)))
    return rows, labels


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def frames(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_of_the_held_out_part_are_found(spark, corpus):
    docs, labels = frames(spark, corpus)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(found[n].held_out == crc_held_out(n) and found[n].predicted == (found[n].score >= 0.7) for n in found)
    held = [n for n in found if found[n].held_out]
    assert sum(found[n].predicted for n in held if n % 6 == 0) >= 0.9 * sum(n % 6 == 0 for n in held)
    assert sum(found[n].predicted for n in held if n % 6) <= 0.02 * len(held)


def test_scores_depend_on_the_text_alone_and_not_on_partitions(spark, corpus):
    docs, labels = frames(spark, corpus)
    first = collected(toxicity.toxicity(docs, labels))
    turned = [(i, int(t == 0) if crc_held_out(i) else t) for i, t in corpus[1]]
    assert first == collected(toxicity.toxicity(docs.repartition(9), spark.createDataFrame(turned, "doc_id long, toxic int").repartition(3)))


def test_toxicity_of_odd_documents(spark, table, odd_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 1), (9, 0), (77, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(table(odd_documents, "score string, places int, positive int", ("x", 1, 2)), labels).collect()
    assert len(found) == len(odd_documents) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.toxicity(table([]), labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(table(odd_documents), none).collect())


def test_languages_of_the_held_out_part_are_found(spark, corpus, monkeypatch):
    docs, _ = frames(spark, corpus)
    found = {r.doc_id: r for r in language_id.languages(docs).collect()}
    held = [row for row in corpus[0] if crc_held_out(row[0])]
    assert all(found[i].held_out for i, _, _ in held)
    assert sum(found[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_of_odd_documents(table, odd_documents):
    docs = table([*odd_documents, (20, "123 !? ..."), (21, "العربية")], "found string, lettered int", ("f", 1))
    found = {r.doc_id: r.lang_pred for r in language_id.languages(docs).collect() if r.doc_id is not None}
    assert [n for n in sorted(found) if found[n] == "und"] == [3, 4, 5, 20]
    assert language_id.languages(table([])).collect() == []


def test_slopes_of_the_network_are_those_of_its_loss():
    import numpy as np

    chance = np.random.default_rng(1)
    rows, classes = chance.integers(32, 127, (3, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2])
    network = language_id.Network(3)
    loss = lambda: -np.log(network.forward(rows)[0][np.arange(3), classes]).mean()
    slopes = network.slopes(rows, classes)
    for name, values in network.values.items():
        flat, own = values.reshape(-1), slopes[name].reshape(-1)
        for place in np.argsort(-np.abs(own))[:3]:
            before, step = flat[place], 1e-5
            flat[place] = before + step
            above = loss()
            flat[place] = before - step
            below = loss()
            flat[place] = before
            assert abs((above - below) / (2 * step) - own[place]) < 1e-4, name


def test_tables_answer_like_the_network():
    import numpy as np

    network = language_id.Network(4)
    rows = np.random.default_rng(2).integers(0, 256, (20, language_id.WINDOW)).astype(np.uint8)
    assert np.abs(language_id.Tables(network).chances(rows) - network.forward(rows)[0]).max() < 1e-4


def test_scores_are_those_of_each_text_by_itself(spark, corpus):
    """The fitted weights added up word by word, text by text."""
    import math
    import re

    import pyarrow as pa

    docs, labels = frames(spark, corpus)
    open_part = lambda rows: rows.where("crc32(cast(doc_id as string)) % 3 <> 1")
    used, weights = toxicity.fit(open_part(docs), open_part(labels))
    weight = dict(zip(used.tolist(), weights[:-1]))
    known = {}

    def buckets(word):
        if word not in known:
            known[word] = set(toxicity.features(pa.array([word]))[0].tolist())
        return known[word]

    expected = {}
    for doc_id, text, _ in corpus[0]:
        words = re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())
        held = set().union(*[buckets(w.decode(errors="surrogateescape")) for w in {w.lower() for w in words}]) if words else set()
        expected[doc_id] = 1 / (1 + math.exp(-max(-30, min(30, sum(weight.get(b, 0.0) for b in held) + weights[-1]))))
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert max(abs(found[n] - expected[n]) for n in expected) < 1e-9


def test_languages_are_those_of_each_text_by_itself(spark, corpus):
    """The network itself, window by window, the windows weighed by their letters."""
    import numpy as np
    import pyarrow as pa

    docs, _ = frames(spark, corpus)
    network, names = language_id.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(docs).collect()}
    for doc_id, text, _ in corpus[0][::7]:
        rows, _ = language_id.windows(pa.array([text]))
        letters = np.array([max(1e-9, sum(chr(b).isalpha() or b >= 128 for b in row.tolist())) for row in rows])
        chances = (network.forward(rows)[0] * letters[:, None]).sum(axis=0) / letters.sum()
        assert abs(found[doc_id][1] - chances.max()) < 0.02
        assert found[doc_id][0] == names[chances.argmax()] or np.diff(np.sort(chances)[-2:])[0] < 0.02


def test_an_id_that_repeats_is_learned_from_once(spark, corpus, monkeypatch):
    docs, labels = frames(spark, corpus)
    again = docs.unionByName(docs.where("doc_id in (6, 12)").crossJoin(spark.range(300).drop("id")))
    assert collected(toxicity.toxicity(again, labels).distinct()) == collected(toxicity.toxicity(docs, labels))
    taken = []
    trained = language_id.train
    monkeypatch.setattr(language_id, "train", lambda rows, *more: taken.append(len(rows)) or trained(rows, *more))
    for frame in (docs, again):
        language_id.fit(frame)
    assert taken[0] == taken[1]
