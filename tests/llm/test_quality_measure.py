"""Classifier: words and texts measured by arrays against plain Python, and one measure of each text."""

import collections
import math
import random
import re

import numpy as np

from filingloom.llm import quality_model

WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
ALPHABET = list("abcXYZ019  \t\n\x0b\x0c\r\x85#*$%&|<>.,;-_'ßİıΣςŉǅ²½Ⅷ٣三é́😀𝐀𝒷𝟘𐐀")


def plain(text):
    """MEASURES and features of a text; white space after a word tells it from others, as ``measure`` has it."""
    words = WORD.findall(text)
    sums, shapes = np.zeros(5, int), collections.Counter()
    for w in (x.strip(" \t\n\x0b\x0c\r") for x in words):
        letters, others = sum(c.isalpha() for c in w), sum(not c.isalnum() for c in w)
        sums += (len(w), sum(c in "#*$%&|<>" for c in w), letters > 1 and w.upper() == w != w.lower(), others, letters > 0 and others <= 1)
        signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        shapes[quality_model._slot("s", re.sub(r"(.)\1\1+", r"\1\1", signs, flags=re.DOTALL))] += 1
    n, adjacent = len(words), sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = sum(len(set(words[k : k + quality_model.BLOCK])) for k in range(0, n, quality_model.BLOCK))
    features = [(s, math.sqrt(c / n)) for s, c in sorted(shapes.items())]
    if n:
        features += [(quality_model._slot("r", "adjacent"), math.sqrt(adjacent / n)), (quality_model._slot("r", "variety"), math.sqrt(1 - distinct / n))]
    return [n, *sums.tolist(), adjacent, distinct], features


def test_measure_against_plain_python():
    rng = random.Random(7)
    texts = ["", " ", "\n\t", "  lead", "trail  ", "a", "😀"]
    texts += ["".join(rng.choice(ALPHABET[: rng.randint(3, len(ALPHABET))]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["foo", "BAR", "x1", "😀😀😀", "a-b"]) for _ in range(n)) for n in (499, 500, 501, 1700)] + ["Aa bb " * 200_000, "z" * 1_100_000 + " q"]
    rng.shuffle(texts)
    m, features = quality_model.measure(texts)
    for text, row, (slots, shares) in zip(texts, m.tolist(), features, strict=True):
        assert (row, list(zip(slots.tolist(), shares.tolist(), strict=True))) == plain(text), text[:80]


def test_each_text_is_measured_once(spark):
    """The result reads what the votes' pass wrote, not the texts again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = quality_model.classify(docs)
    assert found.inputFiles() and not set(found.inputFiles()) & set(docs.inputFiles())
    assert found.count() == docs.count()
