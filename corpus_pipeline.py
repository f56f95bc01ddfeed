"""A training corpus from ``documents``: good, harmless, different texts, without repeated passages, packed.

STAGES are (name, function of (spark, docs, sf_dir)); each gets what the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.llm import jaccard_join, packing, quality, suffix_dedup, toxicity
from examloom.storage import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.3 or more; null and empty texts are judged by the model's bias."""
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(quality.score(model, docs["text"]) >= 0.3)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(toxicity.score(model, docs["text"]) < 0.5)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component of near duplicates; documents without shingles or doc_id stay."""
    copies = jaccard_join.jaccard_components(docs).filter(F.col("doc_id") != F.col("component_id"))
    return jaccard_join.without(docs, copies)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; every document stays, with its new n_chars. A null text becomes an empty one."""
    cut = suffix_dedup.remove_repeats(docs, carry=True, as_text=True).withColumnRenamed("kept", "text")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[own[c].alias(c) if c in own else F.col("carried")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of at most 4096: one row per piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", good), ("toxicity", harmless), ("near_duplicates", different), ("repeated_passages", unrepeated), ("packing", packed)]

#: Classifiers and suffix arrays are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
