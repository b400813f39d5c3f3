"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import common

VOCABULARY = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    common.bounded_batches(spark)
    return common.read(spark, sf_dir, table)


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.quality import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.language import held_out, identify, training_sample

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sample = training_sample(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), "doc_id", "text", "lang")
    return identify(docs, sample).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.suffixes import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.urls import RULES, judge

    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return judge(read(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rows} AS r(verdict, host, path)"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.decontaminate import decontaminate

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.chat import adjacent_pairs, format_preferences

    return format_preferences(adjacent_pairs(read(spark, sf_dir, "conversations")))


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.bpe import encode_documents

    docs = read(spark, sf_dir, "documents")
    return encode_documents(docs, vocabulary_file(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.jaccard import link_documents

    return link_documents(read(spark, sf_dir, "documents"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.pii import find_spans

    found = find_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scans, op3_language_id, op4_suffix_dedup, op5_url_filters,
        op6_decontamination, op7_chat_format, op8_bpe_tokens, op9_ngram_jaccard, op10_pii_spans,
    )
}
