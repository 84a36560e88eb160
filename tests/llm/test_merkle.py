from __future__ import annotations

import hashlib
import random

import pytest
from llm_fixtures import odd_documents, table  # noqa: F401
from pyspark.sql import functions as F

from epitrove.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climb(nodes):
    """The last node, and for each of ``nodes`` its siblings level by level as (before, after)."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, place in enumerate(places):
            run = nodes[place // 16 * 16:place // 16 * 16 + 16]
            proofs[n].append((run[:place % 16], run[place % 16 + 1:]))
            places[n] = place // 16
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows):
    """(doc_id, leaf, subroot, root, proof as text) of every row."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts, subroots = [], []
    for source in sources:
        members = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        leaves = [leaf(r) for r in members]
        subroot, proofs = climb(leaves)
        subroots.append(subroot)
        parts.append((members, leaves, proofs))
    root, tops = climb(subroots)
    return sorted(((m["doc_id"], h, subroot, root, "".join("".join(b) + "".join(a) for b, a in proof + top))
                   for (members, leaves, proofs), subroot, top in zip(parts, subroots, tops) for m, h, proof in zip(members, leaves, proofs)), key=str)


def checked(docs):
    found = merkle.manifest_of(docs, FIELDS, {"told": merkle.leaf([F.col(f) for f in FIELDS[:-1]] + [F.lower("text")])})
    found = found.withColumns({"all": merkle.siblings("proof"), "folded": merkle.fold("leaf", "proof"), "other": merkle.fold("told", "proof")})
    rows = found.collect()
    assert all(r.folded == r.root for r in rows)
    assert all((r.other == r.root) == (r.told == r.leaf) for r in rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.all) for r in rows), key=str) == brute([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 40], [5000, 16, 2]])
def test_equals_brute_force(spark, sizes):
    rows = [(n * 7 % 5003, f"Text {n}", "en", f"s{s}", n) for s, size in enumerate(sizes) for n in range(size)]
    checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_many_sources(spark):
    dice = random.Random(3)
    rows = [(n, "ä", None, dice.choice([f"{n}", f"é{n}", "hot"]), None) for n in range(700)] + [(1, None, "x", None, 3)]
    checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))


def test_odd_documents(table, odd_documents):
    checked(table(odd_documents))


def test_empty_table(table):
    found = merkle.manifest_of(table([]), FIELDS)
    assert found.collect() == [] and found.columns == ["source", "doc_id", "leaf", "proof", "subroot", "root"]


def test_clashing_columns(spark):
    one, two = sha("one"), sha("two")
    rows = spark.createDataFrame([("s", 1, one, 7, 8), ("s", 2, two, 9, 10)], "source string, doc_id long, leaf string, pos int, mine int")
    found = {r.doc_id: r for r in merkle.manifest(rows).collect()}
    assert found[1].mine == 8 and found[2].root == sha(one + two) and [(x.place, x.siblings.hex()) for x in found[2].proof] == [(1, one)]


def test_no_run_reaches_the_root_alone(spark):
    """Distances double: three levels in the source and one above take two joins."""
    rows = [(n, str(n), "en", "big" if n else "small", 1) for n in range(4100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    joins = []
    pinned, merkle.pin = merkle.pin, lambda df: joins.append(df) or pinned(df)
    try:
        merkle.manifest_of(docs, FIELDS).collect()
    finally:
        merkle.pin = pinned
    jumped = [df for df in joins if df.columns == ["at", "up", "way", "places"]]
    assert len(jumped) == 1 + 3 and max(len(r.way) for r in jumped[-1].collect()) == 5
