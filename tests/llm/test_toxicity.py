import math
import random

import numpy as np

from factweave.llm import toxicity as T


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ka lo mi tu ren sol vag dor pel fin".split() for b in "ta ri no sem bul gar ten".split()]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        sents = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9))]
        if toxic:
            k = rng.randrange(len(sents))
            sents[k] += " " + rng.choice(["nastyword", "uglyword", "Stemxx" + rng.choice(vocab)])
        docs.append((i, ". ".join(sents) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_place(spark):
    docs, labels = corpus()
    extra = [(5000, None), (5001, ""), (None, "nastyword"), (docs[0][0], docs[0][1])]
    d = spark.createDataFrame([*docs, *extra], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (77, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = T.train(d, lab)
    out = T.score(d, model).collect()
    assert len(out) == len(docs) + len(extra)
    truth, text = {i: y for i, _, y in labels}, dict(docs)
    held = [r for r in out if r.doc_id in truth and T.held_out(r.doc_id)]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    for r in out:
        assert 0 <= r.score <= 1
        for o in r.offending:
            if r.doc_id in text:
                assert any(w in text[r.doc_id][o.start : o.end].lower() for w in ("nastyword", "uglyword", "stemxx"))
    assert [r.score for r in out if r.doc_id in (5000, 5001)] == [0, 0]
    assert next(r.score for r in out if r.doc_id is None) > 0.5


def test_score_is_noisy_or():
    m = T.Model(-3.0, {"bad": 2.0, "badn*": 1.0})
    got = next(T._score(m)(iter([__import__("pyarrow").RecordBatch.from_pydict({"text": ["Bad day. badness! fine\nx"], "doc_id": [1]})])))
    s = [1 / (1 + math.exp(-z)) for z in (-1.0, -2.0, -3.0, -3.0)]
    assert abs(got.column("score")[0].as_py() - (1 - math.prod(1 - x for x in s))) < 1e-12


def test_held_out_labels_are_not_seen(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, q, 1 - t if T.held_out(i) else t) for i, q, t in labels]
    a, b = (T.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert a == b


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = T.train(d, none)
    assert T.score(d, m).first().score < 1e-9
    assert T.score(d.limit(0), m).collect() == []
