"""Texts with bytes that are no UTF-8, as Spark's strings may hold, go through every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def with_odd_bytes(spark, path, odd):
    """The documents, and copies of 20 of them with ``odd`` after their first 40 characters."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.where("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(20)
    cut = F.concat(F.substring("text", 1, 40), odd, F.expr("substring(text, 41)"))
    docs.unionByName(some.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": cut})).write.parquet(f"{path}/documents.parquet")
    return str(path)


def stage_rows(spark, top, name, stage, docs):
    stage(spark, docs, top).write.parquet(f"{top}/{name}")
    return spark.read.parquet(f"{top}/{name}")


def test_stages_with_odd_bytes(spark, tmp_path):
    """They count as U+FFFD: each stage keeps the rows that it keeps if that stands there."""
    odd = {"bytes": F.expr("cast(unhex('FFC328E282') AS string)"), "signs": F.lit("��(�")}
    tops = {k: with_odd_bytes(spark, tmp_path / k, c) for k, c in odd.items()}
    docs = {k: spark.read.parquet(f"{top}/documents.parquet") for k, top in tops.items()}
    assert docs["bytes"].where("NOT is_valid_utf8(text)").count() == 20
    for name, stage in corpus_pipeline.STAGES:
        docs = {k: stage_rows(spark, tops[k], name, stage, d) for k, d in docs.items()}
        ids = {k: sorted(r.doc_id for r in d.select("doc_id").collect()) for k, d in docs.items()}
        assert ids["bytes"] == ids["signs"] and max(ids["bytes"]) >= 1_000_000, name
    ids = {k: sorted((r.doc_id, r.piece, r.ids_crc32) for r in d.collect()) for k, d in docs.items()}
    assert ids["bytes"] == ids["signs"]


def test_odd_bytes_stay_in_rows_that_pass(spark, tmp_path):
    top = with_odd_bytes(spark, tmp_path, F.expr("cast(unhex('FF') AS string)"))
    docs = spark.read.parquet(f"{top}/documents.parquet").where("doc_id >= 1000000")
    kept = corpus_pipeline.quality_classifier_stage(spark, docs, top)
    assert kept.count() and kept.where("is_valid_utf8(text)").count() == 0
