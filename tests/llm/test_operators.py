"""The corpus operators against brute force, libraries and SQL, and on odd rows."""

import base64
import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import byte_bpe, chat_format, graph_ann, line_dedup, minhash, packing, quality_model, quality_rules, queries, tokens, url_filters, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g " * 3000), (6, "a b c d e f g " * 3000), (6, "a b c d e f g " * 3000), (7, "é \U0001f600 's\n" * 40)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, kept string, n string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    found = con.sql(queries.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def base(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.judge(docs).collect()
    assert all(tuple(r[s] for s in quality_rules.STATS) == base(texts[r.doc_id]) for r in got)
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.doc_id < 5)
    assert quality_rules.judge(empty).count() == 0


def test_classifier_on_held_out_labels(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_model.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in found)
    assert right / len(found) > 0.95
    assert all(r.kept for r in found if r.quality == 1)
    assert quality_model.classify(odd).count() == len(ODD) and quality_model.classify(empty).count() == 0


def test_line_dedup(spark, odd, empty):
    block = "alpha beta\ngamma delta\nepsilon zeta\neta theta\niota kappa\nlambda mu\nnu xi\nomicron pi"
    docs = spark.createDataFrame([(1, "first\n" + block + "\nx"), (2, "other\n" + block + "\ny"), (3, block), (4, block), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines > 0 and got[3].removed_lines > 0
    assert got[2].text.startswith("other") and got[4].text == "" and got[5].text is None
    assert line_dedup.line_dedup(odd).columns[:4] == ["doc_id", "text", "kept", "n"]
    assert line_dedup.line_dedup(odd).count() == len(ODD) and line_dedup.line_dedup(empty).count() == 0


def test_warc_round_trip(spark, empty):
    rows = [(1, "http://a/\r\nx", "x" * 2500), (2, None, "same"), (3, "http://b/", "same"), (4, "http://c/", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, chunk_bytes=1000)
    chunks = warc.read_chunks(manifest, chunk_bytes=700)
    got = collections.defaultdict(list)
    for r in chunks.orderBy("page_id", "chunk_no").collect():
        got[r.page_id].append(r)
    assert [len(got[1]), got[1][-1].is_last, got[1][1].bytes_so_far] == [4, True, 1400]
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i][-1].digest_so_far == base64.b32encode(hashlib.sha1(raw).digest()).decode() and got[i][-1].payload_bytes == len(raw)
        if got[i][0].record_type == "response":
            assert b"".join(bytes(r.data) for r in got[i]) == raw
    assert got[2][0].refers_to == 3 and got[4][0].refers_to == 5 and got[5][0].record_type == "response"
    assert warc.dangling_revisits(chunks).count() == 0
    twice = pages.union(pages.where("page_id IN (2, 3)")).selectExpr("*", "'x' AS digest", "1 AS n", "2 AS payload", "3 AS refers_to")
    last = warc.read_chunks(warc.write_archives(twice)).where("is_last").select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, last), key=str) == sorted([(1, "response", None), *[(2, "revisit", 3)] * 2, *[(3, "response", None)] * 2, (4, "revisit", 5), (5, "response", None), (6, "response", None)], key=str)
    assert warc.read_chunks(warc.write_archives(pages.where("false"))).count() == 0


def test_graph_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    found = graph_ann.search(graph_ann.build_index(df, shard_rows=400), df.where("vec_id % 50 = 0"))
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits, xs = 0, x.astype(float)
    for q, near in got.items():
        d = np.sqrt(((xs - xs[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hits += len(set(true) & {v for v, _ in near})
        assert [v for v, _ in near] == [v for v, _ in sorted(near, key=lambda p: (p[1], p[0]))] and q not in dict(near)
        if q in range(99, 160):
            assert [v for v, _ in near] == true
    assert hits / (10 * len(got)) >= 0.9 and len(got) == 30


def test_graph_repeated_ids_and_odd_tables(spark):
    rows = [(1, [0.0, 1.0]), (1, [5.0, 5.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 6.0]), (4, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS cell", "3 AS shard", "4 AS v")
    found = graph_ann.search(graph_ann.build_index(df), df).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in found if r.query_id == 1] == [(2, 1.0), (3, 1.0), (4, 32**0.5)]
    assert [r.vec_id for r in found if r.query_id == 4] == [3, 1, 2] and [r.rank for r in found if r.query_id == 4] == [1, 2, 3]
    none = df.where("false")
    assert graph_ann.search(graph_ann.build_index(none), none).count() == 0 and graph_ann.search(graph_ann.build_index(df), none).count() == 0


@pytest.mark.parametrize("shard_rows", [128, 16_384])
def test_graph_recall_on_embeddings(spark, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = graph_ann.build_index(df, shard_rows=shard_rows)
    found = graph_ann.search(index, df.where("vec_id % 50 = 0")).collect()
    near = collections.defaultdict(set)
    for r in found:
        near[r.query_id].add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = 0
    for q in near:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(near[q] & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(near) and len(near) == (ids % 50 == 0).sum()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<s>\\[INST]\\\\<\\s>"), (1, 1, "assistant", "a</s>"), (1, 2, "assistant", None), (1, 3, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in done.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert got[1].l == "a</s>" and got[2].l == "" and [t.text for t in got[2].t] == [""]
    assert chat_format.format_conversations(df.where("false")).count() == 0
    nulls = df.where("conv_id IS NULL").union(spark.createDataFrame([(None, 0, "user", "n"), (None, 1, "user", "m")], df.schema))
    assert sorted(r.formatted.count("n") for r in chat_format.format_conversations(nulls.selectExpr("*", "1 AS own", "2 AS formatted")).collect()) == [0, 3]  # with that of the mark between


def test_long_conversation(spark):
    turns = spark.range(30_000).selectExpr("id % 3 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role", "concat('t', id) AS text")
    done = chat_format.format_conversations(turns).select(F.size("loss_spans").alias("n"), chat_format.loss_text(F.col("formatted"), F.slice("loss_spans", 1, 2)).alias("two"), "conv_id").collect()
    assert {r.conv_id: (r.n, r.two) for r in done} == {0: (5000, "t0t6"), 1: (5000, "t4t10"), 2: (5000, "t2t8")}


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "https://x.example.com/en/7?q", "http://example.com/en/8", "http://notexample.net/de/8", "http://Example.NET/de/81#x", "no url", None, "x://b.org", "http://com/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    rules = url_filters.rules_frame(spark, url_filters.QUERY_RULES)
    got = [(r.page_id, r.rule, r.verdict) for r in url_filters.judge(pages, rules).orderBy("page_id").collect()]
    expect = ["com/en/", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None, None, "com/en/"]
    assert [g[1] for g in got] == [expect[0], *expect] and got[3][2] == "block" and got[2][2] == "allow"
    few = url_filters.judge(pages.selectExpr("*", "'x' AS host", "1 AS salt"), rules, salt_rows=1).orderBy("page_id").collect()
    assert [(r.page_id, r.rule, r.verdict) for r in few] == got
    long = spark.createDataFrame([(1, "http://" + "a." * 300 + "com/en/" + "x" * 100_000), (2, "http://com" + "/" * 50_000)], "page_id long, url string")
    assert [r.rule for r in url_filters.judge(long, rules).orderBy("page_id").collect()] == ["com/en/", None]
    assert url_filters.judge(pages.where("false"), rules).count() == 0 and url_filters.judge(pages, rules.where("false")).count() == 10


def corpus(n):
    rng = random.Random(5)
    letters = "ab'strevldm  \n\t.,12é中 '’\U0001f600A\x1c\x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "x" * 3000, "\n" * 9 + "a", "ΑΣ Σ", "<|endoftext|> hi"]


def test_byte_bpe(spark, odd, empty, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = corpus(3000)
    for size in (1 << 20, 50):
        monkeypatch.setattr(tokens, "ROUND_CHARS", size)
        got = byte_bpe.RankFile(path).encode(texts)
        assert [list(g) for g in got] == [lib.encode_ordinary(t) for t in texts]
    monkeypatch.undo()
    back = byte_bpe.decode(byte_bpe.encode(odd, path), path)
    assert sorted((r.doc_id, bytes(r.data)) for r in back.collect()) == sorted((i, (t or "").encode()) for i, t in ODD)
    assert byte_bpe.round_trip(empty, path).count() == 0


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = corpus(3000)
    assert [list(i) for i in packing.WordTokens(path)(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    rows = packing.pack(odd, path).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack(empty, path).count() == 0


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_minhash(spark, odd, empty):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    hot, docs = [rng.choice(words) for _ in range(60)], []
    for g in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([2, 4, 6, 12, 40, 150]))]
        text = hot + text if g % 3 == 0 else text
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    docs += [(9000, None), (9001, ""), (9002, " \n")]
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    rows = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(odd).collect())
    assert rows == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7)]
    assert minhash.near_duplicates(empty).count() == 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    one = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (0, 1, 40, 180, 3000)]
    other = [np.unique(np.concatenate([s[len(s) // 4 :], rng.integers(0, 2**63, 9, np.uint64)])) for s in one]
    bits = [sum(int(x).bit_count() for x in row) for row in (minhash.parities(one) ^ minhash.parities(other)).view(np.uint64)]
    assert all(b <= len(np.setxor1d(x, y)) for b, x, y in zip(bits, one, other, strict=True))
    assert not minhash.parities([]).size
