"""A corpus from raw documents to tokens: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again before the next. All but the last return the columns of ``docs``. Rows with null or
empty text have no language and go in the first stage; later stages still accept them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.bpe import encode_documents
from keyloom.llm.common import bounded_batches, fits, materialise, read
from keyloom.llm.decontaminate import decontaminate
from keyloom.llm.jaccard import BROADCAST_IDS, link_documents
from keyloom.llm.language import UNKNOWN, identify, training_sample
from keyloom.llm.pii import find_spans
from keyloom.llm.queries import vocabulary_file


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not among ``ids`` (column id)."""
    ids = materialise(ids.where("id is not null").distinct())
    ids = F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids
    return docs.join(ids, docs["doc_id"] == F.col("id"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be found go; a missing ``lang`` is filled in.

    Where no row has a label there is no language to learn; then all documents with a letter stay, and ``lang`` stays null.
    """
    bounded_batches(spark)
    sample = training_sample(docs, "doc_id", "text", "lang")
    if not sample:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, sample, keep=docs.columns, lang_out="found_language", score_out="found_score")
    lang = F.coalesce("lang", "found_language").alias("lang")
    return found.where(F.col("found_language") != UNKNOWN).select(*[lang if c == "lang" else c for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays, once.

    Rows without an id are not compared and stay. Rows that share an id are one document; the one whose text has the smallest hash stays.
    """
    bounded_batches(spark)
    linked = link_documents(docs)
    left = _without(docs, linked.where("doc_id <> component_id").select(F.col("doc_id").alias("id")))
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    again = materialise(again)
    if not again.limit(1).count():
        return left
    single = left.join(again, left["doc_id"] == F.col("id"), "left_anti")
    several = left.join(again, left["doc_id"] == F.col("id"), "left_semi")
    one = several.groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct(*docs.columns), F.sha2("text", 256)).alias("k"))
    return single.unionByName(one.select("k.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words five in a hundred or more stand in benchmark windows go, each row by its own text."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=docs.columns).where("not contaminated").select(docs.columns)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind; n_chars follows."""
    bounded_batches(spark)
    found = find_spans(docs, keep=[c for c in docs.columns if c != "text"], masked="text")
    return found.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids."""
    bounded_batches(spark)
    return encode_documents(docs, vocabulary_file(), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("privacy", privacy_stage),
    ("tokens", token_stage),
]

#: Trained models and token automata are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
