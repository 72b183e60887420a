"""The dealt operators over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import chat, decontaminate, infill, jaccard, licences, line_dedup, pieces, quality, sharding, substrings, tokens, toxicity, variants
from tripleloom.llm.sql import SQL  # noqa: F401
from tripleloom.session import written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.chat_digests(chat.format_chat(turns.unionByName(probe)))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), BYTE_BPE)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"), PIECE_BPE)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train_toxicity(docs, labels.where(~held_out))
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.licence_scan(docs, licences.train_licences(docs))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    content = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    dims = {name: F.col(name) for name in ("lang", "source", "size")}
    cut = sharding.hilbert_shards(facts, dims, "doc_id", 40)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = written(variants.vocabulary(variants.runs(table(spark, folder, "documents"))))
    return variants.spelling_variants(words)


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    back = infill.restored(cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "fim_text"))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored_text", 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_licence_scan": op6_licence_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}
