import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factweave.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=8):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            y = words(x)
            k = min(n, len(y))
            wins = {tuple(y[j : j + k]) for j in range(len(y) - k + 1)} if y else set()
            at = [j for j in range(len(w) - k + 1) if y and tuple(w[j : j + k]) in wins]
            hit |= {p for j in at for p in range(j, j + k)}
            if at and i is not None:
                ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "é1", "dos", "x"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.choice([9, 12, 20]))) for i in (1, 2, 10, 30)] + [(4, None), (5, ""), (6, "..."), (7, "x é1 x"), (None, text(9)), (1, text(8))]
    docs = []
    for i in range(40):
        parts = [text(rng.choice([0, 5, 30]))] + [rng.choice(items)[1] or "" for _ in range(rng.choice([0, 1, 2]))] + [text(4)]
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(parts)))
    return [*docs, (100, None), (101, ""), (102, "!!"), (3, docs[3][1]), (None, docs[5][1])], items


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_as_brute_force(spark, bound):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    s = D.scan(d, b, broadcast_windows=bound)
    got = s.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items"), 256), "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_clean_and_columns(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"Keep this. {item.upper()}, and That!", "k", 1), (2, "nothing here", None, 2), (3, None, "z", 3), (4, f"{item} | ten eleven twelve thirteen fourteen fifteen sixteen seventeen", "k", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string, row int")
    b = spark.createDataFrame([(1, item), (2, "ten eleven twelve thirteen fourteen fifteen sixteen seventeen")], "item_id long, text string")
    out = {r.doc_id: r for r in D.clean(d, b).collect()}
    assert D.clean(d, b).columns == d.columns and set(out) == {1, 2, 3}
    assert out[1].text == "Keep this. and That!" and out[2].text == "nothing here" and out[3].text is None
    assert D.scan(d, b.limit(0)).where("contaminated or n_hit > 0").count() == 0 and D.scan(d, b.limit(0)).count() == 4
    assert D.scan(d.limit(0), b).count() == 0


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_long_texts_of_hits_take_linear_time(spark, bound):
    import time

    item = " ".join(f"w{i}" for i in range(64))
    text = "Start, " + " and so ".join([item.upper()] * 6000) + " end"
    d = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "w1 w2 w3")], "item_id long, text string")
    began = time.time()
    r = {x.row.doc_id: x for x in D.scan(d, b, min_items=3, broadcast_bytes=bound).collect()}
    assert r[1].n_hit == 64 * 6000 and len(r[1]["items"]) == 2 and r[2].n_hit == 0
    if bound:
        out = {x.doc_id: x.text for x in D.clean(d, b, min_items=3).collect()}
        assert out[1] == "Start, " + "and so " * 5999 + "end"
    assert time.time() - began < 60
