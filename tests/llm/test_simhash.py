import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import simhash

SP = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in SP:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur] if cur else out


def brute_fp(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", low[root(i)]) for i, (d, f) in enumerate(zip([r[0] for r in rows], fps, strict=True))), key=str)


def near_copies(n=60, seed=5):
    rng = random.Random(seed)
    vocab = [f"W{i}é" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = words(rng.choice(rows)[1])
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, "\n ".join(w)))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 40, 400])))))
    return [*rows, (900, None), (901, ""), (5, rows[5][1]), (None, rows[7][1])]


def test_components_as_brute_force(spark, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    c = simhash.components(df)
    got = sorted(((r.doc_id, f"{r.fingerprint % 2**64:016x}", r.component_id) for r in c.collect()), key=str)
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(got)


def test_hot_shards_go_to_deeper_levels(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = [base]
    for _ in range(200):  # a dense ball around one fingerprint
        x = fps[int(rng.integers(len(fps)))]
        for k in rng.integers(0, 63, int(rng.integers(1, 6))):
            x ^= 1 << int(k)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    want = simhash.classes(np.array(fps, np.int64).view(np.uint64))
    from factweave.operators.graph import components

    for limit, tree in ((2, 2048), (20, 16), (8192, 2048)):
        named = {r.node: r.component for r in components(simhash.links(df, shard_rows=limit, tree=tree)).collect()}
        got = [fps.index(named.get(f, f)) for f in fps]
        assert got == list(want), limit


def test_shards_stay_whole_when_a_join_turns_into_a_broadcast(spark):
    """Planned as a sort-merge join, run as a broadcast join with local reads, as on larger tables."""
    rng = np.random.default_rng(4)
    fps = rng.integers(-(1 << 63), 1 << 63, 600, dtype=np.int64)
    fps = np.unique(np.concatenate([fps, fps ^ (np.int64(1) << rng.integers(0, 63, 600)), fps ^ (np.int64(5) << rng.integers(0, 60, 600))]))
    want = simhash.classes(fps.view(np.uint64))
    from factweave.operators.graph import components

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a small table is one partition
    try:
        df = spark.createDataFrame([(int(f),) for f in fps], "fingerprint long")
        named = {r.node: r.component for r in components(simhash.links(df, tree=64)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [named.get(int(f), int(f)) for f in fps] == [int(fps[k]) for k in want]


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=120, unique=True), st.integers(0, 4))
def test_bk_tree_finds_all(xs, radius):
    fps = np.array([x * 0x1111 for x in xs], np.uint64)
    tree, found = simhash.BKTree(fps, leaf=4), set()
    for i, near in tree.matches(fps, radius):
        found |= {(i, int(j)) for j in near}
    want = {(i, j) for i in range(len(xs)) for j in range(len(xs)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert found - {(i, i) for i in range(len(xs))} == want - {(i, i) for i in range(len(xs))}


def test_trees_branch_and_wide_fingerprints():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, (1500, 4)).astype(np.uint64)
    fps[700:] = fps[:800]
    for row in fps[700:]:
        for k in rng.integers(0, 256, 30):
            row[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    tree = simhash.BKTree(fps)
    assert tree.branches > 10
    got = {i: set(near.tolist()) for i, near in tree.matches(fps, 40)}
    for i in range(0, 1500, 37):
        want = {j for j in range(1500) if sum(int(a ^ b).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= 40}
        assert got.get(i, {i}) == want


def test_first_level_keeps_few_bits():
    for bits in (0, 1, 5, 16, 40):
        masks = simhash.levels(3, bits)[0]
        assert all(m.bit_count() == min(bits, 16) for m in masks) and len(masks) == (4 if bits else 1)
