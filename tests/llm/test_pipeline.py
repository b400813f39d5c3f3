"""The pipeline's stages against a plain version of each."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, component_rows, documents, hits_of, benchmark_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in documents()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(benchmark_rows(), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "privacy", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.language_stage(spark, docs, folder)
    assert first.columns == columns and first.where("lang is null").count() == 0
    have = {r["doc_id"] for r in first.collect()}
    assert not have & {100, 101, 102} and set(range(60)) <= have
    second = corpus_pipeline.near_duplicate_stage(spark, first, folder)
    rows = [(r["doc_id"], r["text"]) for r in first.where("doc_id is not null").collect()]
    component = component_rows(rows)
    assert second.columns == columns
    assert sorted(r["doc_id"] for r in second.where("doc_id is not null").collect()) == sorted(i for i, c in component.items() if i == c)
    third = corpus_pipeline.benchmark_stage(spark, second, folder)

    def clean(text):
        words, hit, _ = hits_of(text)
        return not hit or 20 * len(hit) < len(words)

    want = sorted(r["doc_id"] for r in second.where("doc_id is not null").collect() if clean(r["text"]))
    assert sorted(r["doc_id"] for r in third.where("doc_id is not null").collect()) == want
    fourth = corpus_pipeline.privacy_stage(spark, third, folder)
    assert fourth.columns == columns and fourth.count() == third.count()
    assert not fourth.where(F.col("text").contains("a.b@c.example.org")).count()
    assert not fourth.where(F.length("text") != F.col("n_chars")).count()


def test_language_stage_keeps_documents_without_any_label(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["plain words here", "\u03a3\u03b1\u03c2", None, "", "12 -- 34"])] + [(None, "no id", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect()} == {"plain words here", "\u03a3\u03b1\u03c2", "no id"}


def test_near_duplicate_stage_keeps_one_row_of_an_id(spark):
    rows = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, "one two three four five"), (3, "lone words stand here now"), (4, None), (4, ""), (None, "one two three four five")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in got] == [0, 1, 3, 4] and got[1][1] in {t for i, t in rows if i == 1}


def test_benchmark_stage_judges_rows_without_and_with_repeated_ids(spark, folder):
    taken = next(t for _, t in benchmark_rows() if t and not clean_of(t))
    rows = [(None, taken), (None, "nothing of it"), (7, taken), (7, "other words"), (8, "more words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.benchmark_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(i, t) for i, t in rows if t != taken}


def clean_of(text):
    words, hit, _ = hits_of(text)
    return not hit or 20 * len(hit) < len(words)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    rows = out.collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
