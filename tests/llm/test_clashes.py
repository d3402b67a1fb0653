"""Columns of the given table that are named as operators' own ones."""

from pyspark.sql import functions as F

import corpus_pipeline
from postlark.llm import lines, near_dup, substrings, toxicity

TEXT = "some words of a line that stands twice in this small table of documents " * 8


def table(spark, *extra):
    rows = spark.createDataFrame([(1, TEXT, "en"), (2, TEXT, "en"), (3, None, None)], "doc_id long, text string, lang string")
    return rows.select("*", *(F.lit(f"own {c}").alias(c) for c in extra))


def test_line_and_substring_columns(spark):
    docs = table(spark, "runs", "dropped", "group", "component", "text_hash", "doc", "key")
    for out in (lines.drop_repeated_lines(docs), substrings.remove_repeats(docs)):
        rows = out.collect()
        assert len(rows) == 3 and all(r.runs == "own runs" and r.dropped == "own dropped" and r["key"] == "own key" for r in rows)


def test_near_duplicate_columns(spark):
    out = near_dup.keep_one(table(spark, "class_id", "n_class", "band", "component", "id", "text_key"))
    assert {(r.doc_id, r.class_id, r.id) for r in out.collect()} == {(1, "own class_id", "own id"), (3, "own class_id", "own id")}


def test_toxicity_stage_keeps_a_score_column(spark, tmp_path):
    docs = table(spark, "score", "toxic")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and all(r.score == "own score" and r.toxic == "own toxic" for r in out.collect())


def test_an_id_in_very_many_rows_reaches_the_driver_once(spark):
    docs = spark.createDataFrame([(1, "bad words here", "en")] * 50 + [(2, "good words there", "en")] * 50, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.with_toxicity(docs, model).count() == 100


def test_decontamination_stage_keeps_a_hits_column(spark, tmp_path):
    docs = table(spark, "hits", "item_id")
    spark.createDataFrame([(7, TEXT)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [(r.doc_id, r.hits) for r in out.collect()] == [(3, "own hits")]
