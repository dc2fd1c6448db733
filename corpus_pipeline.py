"""Corpus preparation in stages: rules, classifier, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import line_dedup, minhash, packing, quality_model, quality_rules
from filingloom.llm.common import scratch, table, without


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts fail the base test and go."""
    return without(docs, quality_rules.rejected(docs))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null and empty texts go.

    It learns from all ``documents``: the rules have left little junk in ``docs`` to learn from.
    """
    judged = quality_model.classify(docs, learn_from=table(spark, sf_dir, "documents"))
    return without(docs, judged.where("NOT kept").select("_id", "_h"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; ``n_chars`` follows the text.

    A document whose every line stands elsewhere has no text left and goes;
    one that was empty before stays.
    """
    # Columns are numbered on the way through, so that none clashes with those that the operator adds.
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    done = line_dedup.line_dedup(docs.toDF(*own.values()), own["doc_id"], own["text"])
    text = F.col(own["text"])
    left = done.where(~((F.col("removed_lines") > 0) & ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")))
    length = F.when(F.col("removed_lines") > 0, F.length(text).cast("long"))
    return left.select(*[(F.coalesce(length, F.col(k)) if c == "n_chars" else F.col(k)).alias(c) for c, k in own.items()])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return minhash.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its place in a sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("best_fit_packing", packing_stage),
]

#: Expectation-maximisation, the trained scorer and the tokenizer aren't SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
