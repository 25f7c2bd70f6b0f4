"""Registered queries of this subpackage: importing it fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.llm import bpe, chat, collocations, decontaminate, lexical, licences, mixing, near_dedup, oracles, pii, quality, quality_rules, substring_dedup, suffix_array
from tableseek.llm.registry import ORACLES, QUERIES, load, query
from tableseek.llm.scratch import stored

__all__ = ["ORACLES", "QUERIES"]


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality.statistics(load(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    model = quality.fit_quality(measured, load(spark, sf_dir, "labels"))
    scored = quality.score_measured(measured, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op5_byte_level_bpe")
def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_documents(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_substring_dedup", oracles.SUBSTRING_DEDUP)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_passages(load(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.remove_repeated_bytes(load(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_quality_rules", oracles.QUALITY_RULES)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("op8_licence_scan", oracles.LICENCES)
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(load(spark, sf_dir, "documents"), ["doc_id"])


@query("op9_chat_formatting", oracles.CHAT)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_conversations(*chat.format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op4_pii_surrogates")
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), size=2)


@query("op11_token_budget_mix")
def op11_token_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_phrase_collocations", oracles.COLLOCATIONS)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


@query("op12_lexical_search", oracles.LEXICAL_SEARCH)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
