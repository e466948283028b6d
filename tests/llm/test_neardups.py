import random

import numpy as np

from factweave.llm import neardups


def grams(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    both = len(a & b)
    return both >= 0.8 * (len(a) + len(b) - both)


def groups(rows):
    """Smallest id of each document's component, from all pairs."""
    up, own = list(range(len(rows))), [grams(t) for _, t in rows]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(own[i], own[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[k] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed=6, n=150):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(w)
        for _ in range(rng.choice([0, 0, 1, 3])):
            texts.append(edited(rng, w, rng.choice([0.005, 0.01, 0.02, 0.03])))
    base = [f"b{rng.randrange(3000)}" for _ in range(300)]
    texts += [edited(rng, base, 0.008) for _ in range(120)]  # a large group
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_recall_and_precision_against_all_pairs(spark):
    rows = corpus()
    root = groups(rows)
    want = {i for i, r in enumerate(root) if r == i}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in neardups.dedup(df).collect()}
    gone = set(range(len(rows))) - want
    assert len(gone) > 150 and want <= kept  # what the definition keeps stays
    assert len(gone - kept) >= 0.97 * len(gone)
    table = neardups.prepared(df)
    for few in (2, 30):  # hot shards go to the next levels
        at = {r.key: r.doc_id for r in table.select("key", "doc_id").collect()}
        pairs = [(at[r.a], at[r.b]) for r in neardups.links(table, shard_rows=few).collect()]
        assert len(pairs) > 150 and all(alike(grams(rows[a][1]), grams(rows[b][1])) for a, b in pairs)


def test_odd_rows_and_all_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(3, "a b c d", "x", 1), (1, "A  b c d", "y", 1), (1, "A  b c d", "y", 1), (1, "A  b c d", "a", 0), (2, None, "x", 1), (7, "", None, 1), (9, "other words here now then", "z", 1), (None, "a b\nc d", "n", 5), (11, long, None, None), (12, f"{long} w0", None, None), (13, "a b", "k", 1)]
    cols = "doc_id long, text string, key string, row int"
    df = spark.createDataFrame(rows, cols)
    got = neardups.dedup(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(2, None, "x", 1), (9, "other words here now then", "z", 1), (None, "a b\nc d", "n", 5), (11, long, None, None), (13, "a b", "k", 1)], key=str)
    again = neardups.dedup(spark.createDataFrame(rows[1:4], cols)).collect()
    assert [tuple(r) for r in again] == [(1, "A  b c d", "a", 0)]
    assert neardups.dedup(df.limit(0)).collect() == []


def test_signatures_estimate_the_angle():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        d = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            y = x.copy()
            y[int(400 * 2 * share / (1 + share)) :] = rng.integers(0, 1 << 63, 400 - int(400 * 2 * share / (1 + share)))
            d.append(int(np.bitwise_count(neardups.signature(np.unique(x)) ^ neardups.signature(np.unique(y))).sum()))
        want = 256 * np.arccos(min(1.0, 2 * share / (1 + share))) / np.pi
        assert abs(np.mean(d) - want) < 6


def test_no_link_is_lost_at_any_shard_size(spark):
    rows = corpus(seed=9, n=60)
    root = groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = neardups.prepared(df)
    at = {r.key: r.doc_id for r in table.select("key", "doc_id").collect()}
    for few, radius in ((2, neardups.RADIUS), (2048, 4)):  # large shards; a radius that most pairs are outside of
        up = list(range(len(rows)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for r in neardups.links(table, shard_rows=few, radius=radius).collect():
            a, b = sorted((find(at[r.a]), find(at[r.b])))
            up[b] = a
        assert [find(i) for i in range(len(rows))] == root


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (0, 5, 0), (1, 1, 1), (64, 65, 60), (300, 300, 270), (300, 2000, 290), (2048, 2049, 1900), (5000, 5000, 0)]:
        s = rng.permutation(1 << 20)[: n + m - both].astype("<u4") * np.uint32(4093)
        x, y = np.sort(s[:n]), np.sort(s[n - both :])
        d = neardups.differing(neardups.parity(x), neardups.parity(y))
        assert len(x) == n and len(y) == m and d <= n + m - 2 * both and (n + m - d) % 2 == 0
        assert neardups.differing(neardups.parity(x), neardups.parity(x)) == 0
    assert d > (n + m) * 0.2 / 1.8  # unlike ones are told apart


def test_sets_of_unlike_documents_are_not_sent(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"u{rng.randrange(10**7)}" for _ in range(150)] + passage)) for i in range(60)]  # one passage, else unlike
    rows += [(100 + i, " ".join(edited(rng, [f"b{k}" for k in range(200)], 0.01))) for i in range(4)]
    table = neardups.prepared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    asked, ends = [], neardups._with_ends

    def counted(pairs, t, *columns, **more):
        asked.append((columns, pairs.count()))
        return ends(pairs, t, *columns, **more)

    monkeypatch.setattr(neardups, "_with_ends", counted)
    at = {r.key: r.doc_id for r in table.select("key", "doc_id").collect()}
    every = sorted(at)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(every) for b in every[i + 1 :]], "a binary, b binary")
    got = {tuple(sorted((at[r.a], at[r.b]))) for r in neardups.verified(pairs, table, 0.8).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and alike(grams(x), grams(y))}
    assert got == want and len(want) > 3
    assert [c for c, _ in asked] == [("n", "bits"), ("shingles",)] and asked[0][1] == 64 * 63 // 2 and asked[1][1] <= 6
    monkeypatch.setattr(neardups, "_with_ends", lambda *a: ends(*a, few=0))  # more ends than are broadcast
    assert neardups.verified(pairs, table, 0.8).count() == len(want)


def test_pairs_of_one_shingle_need_enough_after_it(spark):
    """Every pair within the similarity is met at a shingle of both prefixes, over batches of any length; no more pairs than need be."""
    rows = corpus(seed=12, n=40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = neardups.prepared(df)
    at = {r.key: r.doc_id for r in table.select("key", "doc_id").collect()}
    none = spark.createDataFrame([], "a binary, b binary")
    own = {i: grams(t) for i, t in rows}
    want = {(a, b) for a in own for b in own if a < b and alike(own[a], own[b])}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (old, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for most in (0, 200_000):
                got = [tuple(sorted((at[r.a], at[r.b]))) for r in neardups.rest(table, none, 0.8, most=most).collect()]
                assert len(set(got)) == len(got) and want <= set(got)
                assert all(0.8 * len(own[a]) <= len(own[b]) <= len(own[a]) / 0.8 for a, b in got)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
