"""Each stage of the pipeline on its own input against brute force, with odd rows among the documents and on an empty table."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from filingloom.llm import quality_model, quality_rules, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Some words of a long text that goes on about the sea and its ports. " * 2000
ODD = [(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, " \n\t", None, "x", 3), (-4, LONG, None, None, None), (-5, LONG, "en", "x", 5), (-6, "one", "en", "x", 3), (-6, "one", "en", "x", 3)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The paths of the documents and of what each stage gave."""
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    paths = [f"{top}/documents.parquet"]
    docs.unionByName(spark.createDataFrame(ODD, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)).write.parquet(paths[0])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(paths[-1]), str(top)).write.parquet(f"{top}/{name}")
        paths.append(f"{top}/{name}")
    return paths


def rows(spark, path):
    df = spark.read.parquet(path)
    return [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()], sorted(df.columns)


def texts(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()]


def test_rules_stage(spark, stages):
    (before, columns), (after, kept_columns) = rows(spark, stages[0]), rows(spark, stages[1])
    assert columns == kept_columns and not collections.Counter(after) - collections.Counter(before)
    judged = quality_rules.judge(spark.read.parquet(stages[0])).collect()
    assert sorted(i for i, _ in texts(spark, stages[1])) == sorted(r.doc_id for r in judged if r.kept)
    assert all(len(WORD.findall(t or "")) >= 20 for _, t in texts(spark, stages[1]))


def test_classifier_stage(spark, stages):
    (before, columns), (after, kept_columns) = rows(spark, stages[1]), rows(spark, stages[2])
    assert columns == kept_columns and not collections.Counter(after) - collections.Counter(before)
    judged = quality_model.classify(spark.read.parquet(stages[1]), learn_from=spark.read.parquet(stages[0])).collect()
    assert sorted(i for i, _ in texts(spark, stages[2])) == sorted(r.doc_id for r in judged if r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    there = good & {i for i, _ in texts(spark, stages[1])}
    assert len(there & {i for i, _ in texts(spark, stages[2])}) >= 0.98 * len(there)


def test_line_stage(spark, stages):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{stages[2]}/*.parquet')")
    found = con.sql(queries.oracle_sql()["op1_line_dedup"])
    at = [found.columns.index(c) for c in ("doc_id", "text", "removed_lines")]
    want = [(r[at[0]], r[at[1]]) for r in found.fetchall() if not (r[at[2]] and not WORD.search(r[at[1]] or ""))]
    assert sorted(texts(spark, stages[3]), key=str) == sorted(want, key=str)
    assert rows(spark, stages[3])[1] == rows(spark, stages[2])[1]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_duplicates_stage(spark, stages):
    sets = {i: shingles(t) for i, t in sorted(texts(spark, stages[3]))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(i for i, _ in texts(spark, stages[4])) == [i for i in ids if find(i) == i]
    assert rows(spark, stages[4])[1] == rows(spark, stages[3])[1]


def test_packing_stage(spark, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = spark.read.parquet(stages[5]).collect()
    size, bins = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        size[p.doc_id] += p.length
        bins[p.sequence_id].append((p.offset, p.length))
    assert size == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(spark, stages[4])}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Columns named like those that operators add pass through every stage but the last."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).selectExpr("*", "'a' AS kept", "1 AS _id", "2 AS _h", "'n' AS removed_lines", "3 AS posterior", "4 AS component_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns, name
        docs = out
    assert docs.where("kept = 'a' AND _id = 1 AND removed_lines = 'n'").count() == docs.count() > 0
