from __future__ import annotations

import random

import pytest

import corpus_pipeline
from epitrove.llm import queries
from epitrove.plans.storage import pin

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, pin(stage(spark, docs, FOLDER))
        out.append((before, docs))
    return out


def test_stages_keep_the_columns_and_types(steps):
    for before, after in steps[:-1]:
        assert after.columns == COLUMNS and after.dtypes == before.dtypes


def test_decisions_take_effect(spark, steps):
    from epitrove.llm.minhash import near_duplicates

    toxic, near, cut, mixed, packed = (after for _, after in steps)
    assert 0 < toxic.count() < steps[0][0].count()
    found = near_duplicates(steps[1][0], 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in found.where("kept").collect())
    assert sorted(r.doc_id for r in cut.collect()) == sorted(r.doc_id for r in near.collect())
    before = {r.doc_id: r for r in near.collect()}
    assert all(r.n_chars == len(r.text) if r.text != before[r.doc_id].text else r == before[r.doc_id] for r in cut.collect())
    assert sorted(cut.collect()) == sorted(mixed.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_is_the_stages_one_after_the_other(spark, steps):
    def pieces(frame):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())

    assert pieces(corpus_pipeline.run(spark, FOLDER)) == pieces(steps[-1][1])


def test_sequences_follow_the_mix_whatever_the_files(spark, tmp_path):
    chance = random.Random(1)
    # No two of these documents fit one sequence, so sequences are numbered in the order of packing.
    rows = [(n, " ".join(chance.choice(["a", "b"]) for _ in range(1_200)), "en", f"src{0 if n % 3 == 0 else n % 20}", 2_399) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()
    # The stage's files hold a range of the mix each; Spark lists the largest first.
    at = 0
    for size in (10, 60, 20, 90, 30, 5, 120, 65):
        spark.createDataFrame(mixed[at:at + size]).coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
        at += size
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), FOLDER).collect()
    assert len({r.sequence_id for r in packed}) == len(rows)
    assert [r.doc_id for r in sorted(packed, key=lambda r: r.sequence_id)] == [r.doc_id for r in mixed]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_no_documents(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "a b c", "en", "src0", 5), (1, "a b c", "en", "src0", 5), (2, None, None, None, None), (None, "a b c", None, "x", 5), (3, "", "en", "src1", 0)]
    function = corpus_pipeline.STAGES[stage][1]
    found = function(spark, spark.createDataFrame(odd, schema), FOLDER).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, None}
    assert function(spark, spark.createDataFrame([], schema), FOLDER).collect() == []


def test_queries_have_the_columns_of_their_contracts(spark):
    expected = {
        "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    }
    for name, columns in expected.items():
        assert queries.QUERIES[name](spark, FOLDER).columns == columns
