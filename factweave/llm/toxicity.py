"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence scores s = sigmoid(b + sum of its features' weights);
the document scores 1 - prod(1 - s). Only documents have labels, so the likelihood of document scores
is climbed, and sentence scores fall out of it: they say where the offence is.

Features are lower-cased words and their prefixes of 4 to 7 letters, once per sentence; only those
that documents labelled 1 hold clearly more often (z-score) get a weight. Training takes at most
`train_docs` labelled documents, chosen by a hash of the id, whole texts each; that bound holds what the
driver sees. Scoring covers every document.

Inputs of a score are the text alone. Defined results: null and empty texts have no sentence and score
what the model gives for none, 0. Without any label of 1, all scores are 0. Labels other than 0 and 1
or null, and labels of unknown documents, are not used; repeated labels count once each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import load
from factweave.llm.tokens import slices

TRAIN_DOCS, FOLDS = 6000, 5
MIN_DOCS, MIN_Z, MAX_FEATURES, PREFIXES = 8, 4.0, 2000, (4, 5, 6, 7)
STEPS, RATE, L2 = 600, 0.4, 2e-5
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
OFFENDING = 0.5


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and words of each sentence that has words."""
    words: list[str] = []
    start = end = 0
    for m in TOKEN.finditer(text or ""):
        x = m[0]
        if x[0] in ".!?\n":
            if words:
                yield start, end, words
            words = []
        else:
            if not words:
                start = m.start()
            words.append(x.lower())
            end = m.end()
    if words:
        yield start, end, words


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def select(bags: list[list[list[str]]], labels: np.ndarray) -> list[str]:
    """Features that bags labelled 1 hold more often, strongest first."""
    pos, neg = Counter(), Counter()
    for bag, y in zip(bags, labels, strict=True):
        (pos if y else neg).update({f for s in bag for w in set(s) for f in features(w)})
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    scored = []
    for f, c in pos.items():
        if c + neg[f] >= MIN_DOCS:
            p1, p0 = (c + 0.5) / (n1 + 1), (neg[f] + 0.5) / (n0 + 1)
            z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
            if z >= MIN_Z and p1 > 2 * p0:
                scored.append((-z, f))
    return [f for _, f in sorted(scored)[:MAX_FEATURES]]


def fit(bags: list[list[list[str]]], labels: list[int]) -> Model:
    """Climbs the likelihood of noisy-or document scores by Adam, from fixed starting values."""
    y = np.array(labels, float)
    if not y.sum():
        return Model(-40.0, {})
    names = select(bags, y.astype(int))
    at = {f: i for i, f in enumerate(names)}
    doc, feature, sentence, n_sent = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            doc.append(d)
            got = {at[f] for w in s for f in features(w) if f in at}
            feature += got
            sentence += [n_sent] * len(got)
            n_sent += 1
    doc, feature, sentence = (np.array(x, np.int64) for x in (doc, feature, sentence))
    per_doc = max(1.0, n_sent / max(1, len(bags)))
    x = np.zeros(len(names) + 1)
    x[-1] = np.log(0.02 / per_doc)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        z = x[-1] + np.bincount(sentence, x[feature], n_sent)
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        miss = np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(bags))
        p = np.clip(-np.expm1(miss), 1e-9, 1)
        pull = np.where(y == 1, -(1 - p) / p, 1.0)  # d loss / d sum of -log(1 - s)
        dz = pull[doc] * s
        g = np.append(np.bincount(feature, dz[sentence], len(names)), dz.sum()) / len(bags)
        g[:-1] += L2 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= RATE * (1 - (t - 1) / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(x[-1]), {f: float(w) for f, w in zip(names, x, strict=False) if w})


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """At most so many labelled training documents (text, toxic), by a hash of the id; held-out ids are never among them."""
    id_text = F.col("doc_id").cast("string")
    own = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(F.crc32(id_text) % FOLDS != 0)
    few = own.orderBy(F.xxhash64(id_text, F.lit(7)), "doc_id", "toxic").limit(train_docs)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    rows = sample(docs, labels, train_docs).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    bags = [[w for _, _, w in sentences(t.as_py())] for t in rows.column("text")]
    return fit(bags, rows.column("toxic").to_pylist())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        rest = 1 / (1 + np.exp(-model.bias))
        calm = float(np.log1p(-rest))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for whole in batches:
            for batch in slices(whole, 0):
                scores, where = [], []
                for text in batch.column(0).to_pylist():
                    miss, found = 0.0, []
                    for start, end, words in sentences(text):
                        z = 0.0
                        for w in set(words):
                            k = known.get(w)
                            if k is None:
                                if len(known) > 500_000:
                                    known.clear()
                                k = known[w] = model.word(w)
                            z += k
                        if z:
                            z = min(max(z + model.bias, -40.0), 40.0)
                            miss -= float(np.log1p(np.exp(z)))
                            if (s := 1 / (1 + np.exp(-z))) >= OFFENDING:
                                found.append({"start": start, "end": end, "score": float(s)})
                        else:
                            miss += calm
                    scores.append(float(-np.expm1(miss)))
                    where.append(found)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(where, kind)], [*batch.schema.names[1:], "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, and offending: start, end (code points) and score of each sentence at 0.5 or more."""
    two = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(_score(model), f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double>>")


def query(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    out = score(docs, train(docs, load(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
