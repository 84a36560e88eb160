"""One query for each operator of this package, over the whole table it is meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epitrove.llm import (
    embedding_dedup, fingerprints, language_id, merkle, minhash, mixing, oracles, packing, periodic_runs, secret_scan, sharding, substring_dedup,
    toxicity, url_filter,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text")
    return substring_dedup.cut_repeats(docs, window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(_documents(spark, folder).select("doc_id", "text"), count=16)


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(vectors, threshold=0.9)


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder), size=3, percent=85)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, folder).select("doc_id", "text"))


def tokenizer_path() -> str:
    """The public vocabulary that sequences are packed with; installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder), tokenizer_path(), most=2048, end_id=0)


SOURCE_WEIGHTS = {"src0": 4.0} | {f"src{n}": 1.0 for n in range(1, 20)}
"""Target weights: the source with a third of all documents gets four times the share of any other."""


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS)


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(_documents(spark, folder).select("doc_id", "text", "lang"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the checksum of its id, repeats its words with a period from some word on."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("h", mark).withColumn("w", F.expr(r"if(h % 10 = 0, regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1), null)"))
    words = words.withColumn("n", F.when(F.col("w").isNotNull(), F.size("w").cast("long"))).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % nullif(n, 0)"))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 AS int)))), ' ')")
    return words.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_planted_periods(_documents(spark, folder).select("doc_id", "text"))
    rows = periodic_runs.collapse_runs(docs, least=12).withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))"))
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-best.start").alias("start"), F.col("best.length").alias("length"),
        F.expr("-best.period").alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select(*LEAF_FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([F.col(f) for f in LEAF_FIELDS[:-1]] + [lower]))
    rows = merkle.manifest_of(docs, LEAF_FIELDS, {"tampered": tampered}).withColumn("told", F.coalesce("tampered", "leaf"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("proof"), 256).alias("proof_sha256"), merkle.fold("told", "proof").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, folder).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle": op12_merkle,
    "op13_secrets": op13_secrets,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.substring_dedup(13),
    "op2_sharding": oracles.sharding(16),
    "op3_embedding_dedup": oracles.embedding_dedup(0.9),
    "op4_minhash": oracles.minhash(3, 85),
    "op8_mixing": oracles.mixing(mixing.parts_of({**SOURCE_WEIGHTS, mixing.OTHERS: 1.0}), mixing.OTHERS, mixing.BLOCK_ROWS),
    "op9_url_filter": oracles.url_filter(URL_RULES),
    "op11_periodic_runs": oracles.periodic_runs(12),
    "op12_merkle": oracles.merkle(LEAF_FIELDS),
}
