from __future__ import annotations

import hashlib
import re

import pytest
import xxhash
from llm_fixtures import collected, odd_documents, some_documents, table  # noqa: F401

from epitrove.llm import fingerprints as fp


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hashed(*values):
    """Spark's xxhash64 over strings, ints and longs: each seeds the next."""
    seed = 42
    for value in values:
        data = value.encode() if isinstance(value, str) else (value[0] & ((1 << 8 * value[1]) - 1)).to_bytes(value[1], "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def pieces_of(text):
    """Words of up to 12 characters; longer ones sign by sign, closed after a cut or 12 characters."""
    cut, out = re.compile(f"[{fp.CUTS}]"), []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        if len(word) <= fp.PIECE:
            out.append(word)
            continue
        held = ""
        for sign in word:
            held += sign
            if cut.match(sign) or len(held) == fp.PIECE:
                out.append(held)
                held = ""
        out += [held] if held else []
    return out


def sketch(text):
    pieces = pieces_of(text)
    grams = [tuple(pieces[k:k + 3]) for k in range(len(pieces) - 2)] or [tuple(pieces[:2])]
    seen, found = {}, []
    for place, gram in enumerate(grams):
        seen[gram] = seen.get(gram, 0) + 1
        bits = hashed(*gram) >> 26
        if seen[gram] > 1:
            bits = hashed((bits, 8), (seen[gram], 4)) >> 26
        found.append((bits, place))
    least = [b & ((1 << 38) - 1) for b, _ in sorted(sorted(found)[:fp.SURVIVORS], key=lambda f: f[1])]
    out = []
    for turn in range(1, fp.SKETCHES + 1):
        ranks = sorted((hashed((b, 8), (turn, 4)) & ~63) | i for i, b in enumerate(least))
        two = sorted(r & 63 for r in (ranks * 2)[:2])
        out.append(hashed((least[two[0]], 8), (least[two[1]], 8)) & 0xFFFFFFFF)
    return out


def brute(documents):
    rows = sorted(documents, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        near = lambda x, y: sum(p == q for p, q in zip(x, y)) / fp.SKETCHES
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:08x}" for v in a),
                    "".join(f"{v:08x}" for v in b), near(a, b), near(a, c)))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("size", [8_000_000, 4_000])
def test_equals_brute_force(table, some_documents, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    assert collected(fp.fingerprints(table(some_documents))) == brute(some_documents)


@pytest.mark.parametrize("size", [8_000_000, 10_000])
def test_odd_documents(table, odd_documents, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    unspaced = [(30, "中文文本没有空格" * 5 + "mixed" + "ไทย" * 9), (31, "QmFzZTY0/+xyzXYZ==" * 20), (32, "BCDFGHJKLMNPQRSTVWXZ" * 4 + "🙂" * 30 + "한국어" * 8)]
    assert collected(fp.fingerprints(table(odd_documents + unspaced))) == brute(odd_documents + unspaced)


def test_empty_table_one_row_and_clashing_columns(table):
    assert fp.fingerprints(table([])).collect() == []
    docs = table([(5, "a b c d e f")], "sketch string, next_text string, edited string, __key int", ("s", "n", "e", 1))
    assert collected(fp.fingerprints(docs)) == brute([(5, "a b c d e f")])


def test_likeness_falls_with_edits_and_with_order(spark):
    words = [f"w{n}" for n in range(200)]
    texts = [words, words[:190] + ["x"] * 10, words[:120] + ["x"] * 80, words[100:] + words[:100], [f"v{n}" for n in range(200)]]
    base, *others = [sketch(" ".join(t)) for t in texts]
    near = [sum(a == b for a, b in zip(base, o)) for o in others]
    assert near[0] > near[1] > near[3] == 0 and near[2] < fp.SKETCHES


def test_no_python_in_the_plan(table, some_documents):
    plan = fp.fingerprints(table(some_documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("signs", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "".join(map(chr, range(0x4E00, 0x5200)))])
def test_one_sign_more_in_a_text_without_spaces_changes_little(signs):
    import random

    chance = random.Random(3)
    near = []
    for _ in range(20):
        text = "".join(chance.choice(signs) for _ in range(2_000))
        at = chance.randrange(1, 100)
        near.append(sum(a == b for a, b in zip(sketch(text), sketch(text[:at] + chance.choice(signs) + text[at:]))) / fp.SKETCHES)
    assert sum(near) / len(near) > 0.8
