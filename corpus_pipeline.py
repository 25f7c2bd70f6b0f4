"""From raw documents to token ids in five stages; each works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents, whatever others the table has besides. Empty tables give
empty results, nulls are handled as each operator's docstring says, and repeated rows are copies of which one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.llm import bpe, decontaminate, near_dedup, pii, quality
from tableseek.llm.registry import load
from tableseek.llm.scratch import shared_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier gives a chance of at least one half to be good."""
    measured = stored(quality.statistics(docs, ["doc_id"]), "statistics")
    model = quality.fit_quality(measured, load(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles and a similarity of 0.8 or more: the one with the
    smallest id."""
    return near_dedup.keep_one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of the benchmark occurs, give or take its edit budget."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    out = pii.replace_personal_data(docs.select(*COLUMNS), pii.session_key(spark))
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; decoded_ok says that they decode to the text's bytes."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_documents(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "n_tokens", "ids", same.alias("decoded_ok"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("byte-level BPE", encoding_stage),
]
# The classifier's fit and the tokenizer cannot be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{number}-{uuid.uuid4().hex}"
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
