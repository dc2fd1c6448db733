"""Fill-in-the-middle, clusters around centroids and exact duplicates against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from filingloom.llm import centroids, exact_dedup, fill_middle
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "A b " * 9000), (6, "a B " * 9000), (6, "a B " * 9000), (7, "É \U0001f600 's\n" * 40), (8, "é \U0001f600 's\n" * 40), (None, "one"), (None, "none"), (9, "x <M> y"), (10, "< P>\x85  z<\x0b")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "s") for i, t in rows], "doc_id long, text string, tag string, n int, id string").repartition(3)


def middle(i, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice("ab é\U0001f600\n\t<PSM>\x0b\x0c\r\x85 ") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    done = fill_middle.fill_in_middle(documents(spark, rows))
    got = done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((middle(i, t) for i, t in rows), key=str)
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(documents(spark, rows).where("false")).count() == 0


def test_texts_are_dealt_once(spark):
    done = fill_middle.fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    done.collect()
    final = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # One exchange carries the texts; the other two readers reuse it.
    assert final.count("ReusedExchange") == 2 and final.count("FileScan") == 1 and "Broadcast" not in final


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("fan", [2, 16])
def test_exact_dedup(spark, monkeypatch, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    rng = random.Random(2)
    rows = ODD + [(100 + i, rng.choice(["hot", "HOT", "Hot", f"t{i}", f"T{i % 40}", "É", "é", "KK"])) for i in range(900)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    docs = documents(spark, rows).repartition(7)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
        want = []
        for text, ids in groups.items():
            best = pick([i for i in ids if i is not None], default=None)
            kept = iter([True])
            want += [(i, best, len(ids), i == best and next(kept, False), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = exact_dedup.deduplicate(docs)
    assert whole.columns == docs.columns and sorted(lower(r.text) for r in whole.collect()) == sorted(groups)
    assert exact_dedup.exact_duplicates(docs.where("false")).count() == 0 and exact_dedup.deduplicate(docs.where("false")).count() == 0


def test_exact_dedup_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Broadcast" not in plan


def lloyd(rows, k, rounds):
    """Plain integer rounds without bounds."""
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in x)
    m = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(m))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in x]
        for j in range(len(m)):
            own = [v for (_, v), f in zip(x, found) if f == j]
            if own:
                m[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [near(v) for _, v in x]
    by = collections.Counter()
    for d, j in last:
        by[j] += d
    return [(i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, m[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(x, last)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "large"])
def test_centroids(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "spread": rng.normal(size=(150, 64)), "clusters": rng.normal(size=(8, 64))[rng.integers(0, 8, 150)] * 3 + rng.normal(size=(150, 64)) * 0.1,
        "ties": rng.integers(0, 2, (150, 64)) * (np.arange(64) < 3), "large": rng.normal(size=(150, 64)) * 1e5,
    }[kind].astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [0.0] * 64), (7, [0.0] * 64), (None, [0.5] * 64), (200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [float("inf")] + [0.0] * 63), (204, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = sorted((tuple(r) for r in centroids.report(df, k=12, rounds=4).collect()), key=str)
    assert got == sorted(lloyd(rows, 12, 4), key=str)


def test_bounds_settle_most_vectors_of_clusters():
    rng = np.random.default_rng(4)
    middles = rng.integers(-2000, 2000, (10, 64))
    x = middles[rng.integers(0, 10, 2000)] + rng.integers(-20, 20, (2000, 64))
    first = centroids.Assigner(middles, None)
    state = first(x, None, None, None)
    moved, scanned = middles + 1, []
    then = centroids.Assigner(moved, middles)
    full = then.full
    then.full = lambda rows: scanned.append(len(rows)) or full(rows)
    assert (then(x, *state)[0] == state[0]).all() and sum(scanned) < 20


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance, r.inertia) for r in centroids.report(few).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert centroids.report(few.where("false")).count() == 0
    beyond = few.union(spark.createDataFrame([(3, [1e30] * 64)], few.schema))
    assert centroids.report(beyond).count() == 2
