import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factweave.llm import substring


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=2, n=80):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(12)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(60), text(36), text(35), text(34)]
    rows = []
    for i in range(n):
        w = text(rng.choice([0, 3, 30, 34, 35, 36, 120]))
        for s in rng.sample(shared, rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = s
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(100, None), (101, ""), (102, "  "), (103, "same " * 200), (104, " ".join(["a", "b"] * 50)), (3, rows[3][1]), (None, rows[7][1]), (105, " nb sp  x y " * 20)]
    return rows


@pytest.mark.parametrize(("group_runs", "bits"), [(10_000, 27), (2, 12)])
def test_as_brute_force(spark, group_runs, bits):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substring.digest(df, group_runs=group_runs, bits=bits).collect()), key=str)
    assert got == brute(rows, 35)


def test_short_windows(spark):
    rows = corpus(5, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((tuple(r) for r in substring.digest(df, window=5).collect()), key=str) == brute(rows, 5)


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x " * 40, "k", 1), (2, "a  b", None, 2), (3, None, "z", 3)], "doc_id long, text string, key string, row int")
    out = {r.doc_id: r for r in substring.dedup(df).collect()}
    assert out[1].text == "" and out[2].text == "a  b" and out[3].text is None and out[1].key == "k"
    assert substring.dedup(df.limit(0)).collect() == []


def test_inner_nodes():
    rng = np.random.default_rng(0)
    for n, kinds in ((0, 1), (1, 1), (2, 1), (40, 1), (120, 2), (200, 5)):
        codes = rng.integers(0, kinds, n)
        shared = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or codes[i + k] != codes[j + k]), 0)  # noqa: E731, B023
        assert substring.depths(codes).tolist() == [max((shared(i, j) for j in range(n) if i != j), default=0) for i in range(n)]
