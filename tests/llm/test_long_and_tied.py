"""One text of very many lines, turns that differ in escaped order, payloads that most pages share, searches for more than an index keeps."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from filingloom.llm import byte_bpe, chat_format, graph_ann, line_dedup, warc


def test_a_text_of_many_lines(spark):
    lines = "\n".join(f"line {i} of {i * 7919 % 1009} words" for i in range(32_000))
    docs = spark.createDataFrame([(1, lines), (2, "first\n" + lines), (3, "a\nb")], "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.line_dedup(docs).collect()}
    # Work that grows with the square of the lines took 50 seconds for half as many.
    assert time.time() - t < 60
    assert got[1] == (0, lines) and got[2] == (32_000, "first") and got[3] == (0, "a\nb")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 33])
def test_running_sums(spark, n):
    numbers = [(i * 5) % 7 for i in range(n)]
    df = spark.createDataFrame([(numbers,)], "x array<int>")
    assert df.select(line_dedup._running(F.col("x")).alias("y")).first().y == [sum(numbers[: i + 1]) for i in range(n)]


def test_ties_by_text(spark):
    texts = ["<s>", "<b", "\\", "[INST]", "[0"]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    back = chat_format.format_conversations(df).select(chat_format.read_back(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in back] == sorted(texts)


def test_a_payload_that_most_pages_share(spark):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("html"))
    last = warc.read_chunks(warc.write_archives(pages), with_data=False).where("is_last").select("page_id", "record_type", "refers_to").collect()
    assert len(last) == 6000 and collections.Counter((r.record_type, r.refers_to) for r in last) == {("response", None): 2001, ("revisit", 5999): 3999}


def test_more_neighbours_than_an_index_keeps(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    index = graph_ann.build_index(df, keep_ids=5)
    assert graph_ann.search(index, df, k=4).count() == 120
    for k, beam in ((5, 128), (4, 3)):
        with pytest.raises(ValueError, match="at most"):
            graph_ann.search(index, df, k=k, beam=beam)


def test_byte_bpe_query_on_a_table(spark):
    import base64
    import hashlib

    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, path).collect()}
    assert got == want
