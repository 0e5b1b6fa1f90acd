"""The operators bound to the test tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewloom.llm import (
    bpe, exact_dedup, language_crf, merkle, neural_lm, packing, prefix_trie, quality_crf, quality_rules,
    secret_scan, simhash, substring_dedup, url_filter,
)
from viewloom.llm.common import fold, table
from viewloom.llm.vocabulary import Vocabulary
from viewloom.operators.staging import stored

LEAST_QUALITY = 0.7


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.ledger(table(spark, sf_dir, "documents"), keep="largest")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = quality_rules.ablated(judged)
    return found.select(*first, *[c for c in found.columns if c not in first])


def quality_model(spark: SparkSession, sf_dir: str) -> quality_crf.QualityModel:
    """Fitted on labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return quality_crf.train(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_crf.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(fold("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang")
    found = language_crf.predict(docs, language_crf.train(learn))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), Vocabulary())
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.array_size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(
        "doc_id",
        *counts[:3],
        F.sha2(secret_scan.digest_text(base), 256).alias("base_sha256"),
        secret_scan.digest_text(F.col("spans")).alias("spans"),
        *counts[3:],
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary()
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(F.coalesce(fold("doc_id", 10) != 0, F.lit(True))).select("text")
    counts = neural_lm.count(learn)
    found = neural_lm.score(docs, counts, neural_lm.train(learn, counts))
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return found.select(
        "doc_id", held_out, "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.token_lengths(table(spark, sf_dir, "documents"), Vocabulary())))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    base, head = F.col("conv") - F.col("conv") % 20, fold("conv", 4)
    rebuilt, plans = prefix_trie.with_shared_heads(turns, prefix_trie.lengths_of(turns), base, head, most=3)
    return prefix_trie.trie(prefix_trie.prefixes(rebuilt, plans))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_quality_rules, op3_quality_classifier, op4_language_id, op5_secret_scan,
        op6_simhash, op7_url_filter, op8_bpe, op9_lm_score, op10_packing,
        op11_prefix_trie, op12_merkle_manifest, op13_substring_dedup,
    )
}
