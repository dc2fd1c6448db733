"""Packing: ids as the library gives them by default, and every column of the result against a plain recomputation."""

import collections
import sys
import unicodedata
import zlib

import numpy as np
import pytest

from filingloom.llm import packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.WordTokens(path), Tokenizer.from_file(path)


def test_all_code_points(both):
    own, lib = both
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or unicodedata.category(chr(c)) not in ("Co", "Cn") or c % 97 == 0)]
    texts = [f"Ab{chr(c)}cD {chr(c)} 1{chr(c)}{chr(c)}s" for c in points]
    texts += ["x".join(chr(c) for c in points[i : i + 40]) for i in range(0, len(points), 40)]
    for lo in range(0, len(texts), 20_000):
        some = texts[lo : lo + 20_000]
        want = lib.encode_batch(some, add_special_tokens=False)
        bad = [t for t, a, b in zip(some, own(some), want, strict=True) if a.tolist() != b.ids]
        assert not bad, bad[:3]


def test_added_tokens(both):
    own, lib = both
    texts = ["<|endoftext|> hi", "a<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "É<|endoftext|>́x <|endoftext", "", "<|endoftext|>", " <|endoftext|> \n" * 9, "\U000e0001͸<|ENDOFTEXT|>͸", "plain"]
    assert [list(i) for i in own(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [list(i) for i in own(["plain <|endoftext|>"])][0][-1] == 49407


def test_query_against_the_library(spark, both):
    rows = queries.op9_best_fit_packing(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want, total = {}, 0
    for doc, text in texts.items():
        ids = np.array([*both[1].encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            want[doc, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    check_places(rows)
    assert len({r.sequence_id for r in rows}) <= 1.05 * total / 2048 + 1


def check_places(rows):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048


def test_open_bins_of_many_tasks_are_merged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.repartition(40), path).collect()
    check_places(rows)
    least = sum(r.length for r in rows) / 2048
    assert len({r.sequence_id for r in rows}) <= 1.03 * least + 1
    alone = packing.pack(docs.repartition(40), path, merge_tasks=1).collect()
    assert len({r.sequence_id for r in alone}) > len({r.sequence_id for r in rows})
