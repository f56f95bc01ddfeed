"""The registered queries of this subpackage: thin adapters from the tables to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.suffix_dedup import remove_repeats

    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from examloom.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    packed = pack_documents(table(spark, sf_dir, "documents"), path, F.crc32("ids").alias("ids_crc32"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from examloom.llm.bpe import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.media import UNIT, media_columns

    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.url_filter import filter_urls, rule

    return filter_urls(table(spark, sf_dir, "pages"), [rule(*r) for r in URL_RULES])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.conversations import damaged, digests, repair

    talks = table(spark, sf_dir, "conversations")
    report, turns = repair(damaged(talks))
    every = talks.select("conv_id").distinct().alias("e")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for some, name in ((report, "r"), (digests(turns), "d")):
        every = every.join(some.withColumnRenamed("conv_id", f"{name}_id"), F.col("e.conv_id").eqNullSafe(F.col(f"{name}_id")), "left")
    return every.select(
        F.col("e.conv_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from examloom.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from examloom.llm.backtrack import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_toxicity, op4_jaccard_join, op5_packing, op6_bpe, op7_media_columns, op8_url_filters, op9_quality_classifier, op10_fingerprints, op11_conversation_repair, op12_importance, op13_byte_bpe, pipeline)}


def llm_oracle_sql() -> dict[str, str]:
    from examloom.llm import oracles, url_filter

    return {"op1_suffix_dedup": oracles.OP1, "op4_jaccard_join": oracles.OP4, "op8_url_filters": oracles.op8(URL_RULES, url_filter.DAMPING, url_filter.DECIMALS), "op11_conversation_repair": oracles.OP11, "op12_importance": oracles.OP12}
