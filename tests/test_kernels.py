import itertools
import random

import pytest
from pyspark.sql import functions as F

from factweave.functions.text import ancestors, glob_regex
from factweave.operators import graph, lines, scoring, sets, similar


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def pairs(spark, xs, schema="src long, dst long"):
    return spark.createDataFrame(xs, schema)


def test_run_ends_and_band(spark):
    d = spark.createDataFrame([("f", "x\n//a\n//b\n\n//c"), ("g", None)], "path string, content string")
    x = lines.lines(d)
    assert rows(lines.run_ends(x, F.col("text").startswith("//")), "line", "run_end") == [(2, 3), (3, 3), (5, 5)]
    t = spark.createDataFrame([("f", i) for i in (1, 4, 7, 8)], "file string, line long")
    m = spark.createDataFrame([("f", 4), ("f", 20), ("g", 7)], "file string, line long")
    assert rows(lines.band_mark(t, m, 3, ["file"]), "line") == [(4,), (7,)]
    assert rows(lines.band_unmarked(t, m, 3, ["file"]), "line") == [(1,), (8,)]
    assert rows(lines.orphans(m, t, 3, ["file"])) == [("f", 20), ("g", 7)]
    assert rows(lines.orphans(m, t, 3, ["file"], whole_file=t.limit(1).select("file"))) == [("g", 7)]


def test_scan(spark, tmp_path):
    for p in ("a.rs", "src/b.rs", "target/c.rs", ".git/d.rs", "src/gen/e.rs", "x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"line {p}\ntwo")
    assert rows(lines.scan(spark, str(tmp_path), exclude=("src/gen/*",)), "path") == [("a.rs",), ("src/b.rs",)]


def test_globs():
    import re

    for glob, yes, no in [("src/*.rs", "src/a/b.rs", "lib/a.rs"), ("**/x.rs", "x.rs", "y.rs"), ("{a,b}?", "ac", "cc"), ("[ab]x", "ax", "cx"), ("[!a]x", "bx", "ax"), ("a.b", "a.b", "axb"), ("a/**/b", "a/b", "ab")]:
        assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no), glob


def test_sets(spark):
    d = spark.createDataFrame([(1, "a", "T::a"), (2, "b", "T::b"), (3, None, "c"), (4, "d", "d")], "id long, name string, full string")
    n = spark.createDataFrame([("a",), ("T::b",), (None,)], "name string")
    assert rows(sets.inside(d, n, ["name", "full"]), "id") == [(1,), (2,)]
    assert rows(sets.outside(d, n, ["name", "full"]), "id") == [(3,), (4,)]
    g, rest = sets.exact_groups(spark.createDataFrame([(1, ["x"]), (2, ["x"]), (3, ["y"]), (4, [])], "id long, t array<string>"), "t", "id")
    assert rows(g) == [(1, 2, 1), (2, 2, 1)] and rows(rest, "id") == [(3,), (4,)]
    f = spark.createDataFrame([(1, 5, 2), (1, 4, 9), (2, 1, 1)], "k int, o int, v int")
    assert rows(sets.first_by(f, ["k"], ["o"])) == [(1, 4, 9), (2, 1, 1)]
    o = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["b"]), ("g", 3, []), ("h", 1, ["a"])], "g string, o int, s array<string>")
    assert rows(sets.overlap(o, "g", "o", "s")) == [("g", 1.0)]
    assert rows(sets.having_count(f, ["k"], 2), "k") == [(1,)]
    c = sets.classify(d, "full", [("q", "T::*"), ("r", "T::a"), ("s", "c")])
    assert rows(c.where("layer is not null"), "id", "layer") == [(1, "q"), (2, "q"), (3, "s")]
    e = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z")], "src string, dst string")
    r = spark.createDataFrame([("x", "low"), ("y", "high")], "node string, layer string")
    assert rows(sets.rank_violations(e, r, ["low", "high"]), "src", "dst") == [("x", "y")]
    p = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x"]), (3, [])], "id int, s array<string>")
    assert rows(sets.candidate_hits(p, "s", "a/b"), "id") == [(1,)] and rows(sets.candidate_hits(p, "s", "a", ["*/x"]), "id") == [(1,)]
    assert [r.x for r in p.select(ancestors(F.col("s")).alias("x")).collect()][0] == ["a/b/c", "a/b", "a"]
    u = sets.uncovered(d, spark.createDataFrame([(1, 0), (2, 3)], "id long, hits long"), ["id"])
    assert rows(u, "id") == [(1,)]
    path = spark.createDataFrame([("a/x",), ("b/x",), ("b/y",)], "p string")
    got = lambda **k: rows(path.where(sets.scope(F.col("p"), **k)))
    assert got(allow=["a/*"]) == [("b/x",), ("b/y",)] and got(forbid=["b/*"], exceptions=["*y"]) == [("b/x",)] and got() == [] and got(allow=[], forbid=[]) == []


def test_near_dups(spark):
    d = [(i, [f"t{i}_{k}" for k in range(12)]) for i in range(3)] + [(10, list("aabbcdefgh")), (11, list("aabbcdefgx")), (12, list("aabbcdefg")), (13, [])]
    df = spark.createDataFrame(d, "id long, t array<string>")
    assert rows(similar.near_dups(df, "id", "t", 0.8)) == [(10, 11, pytest.approx(9 / 11))]
    assert rows(similar.near_dups(df, "id", "t", 9 / 11)) != [] and rows(similar.near_dups(df, "id", "t", 0.82)) == []
    many = spark.createDataFrame([(i, ["same"] * 10) for i in range(51)], "id long, t array<string>")
    assert rows(similar.near_dups(many, "id", "t")) == [] and len(rows(similar.near_dups(many.limit(50), "id", "t"))) == 50 * 49 // 2


def brute_fragments(seqs, w, cap):
    seen = {}
    for s, v in seqs.items():
        for i in range(len(v) - w + 1):
            seen.setdefault(tuple(v[i : i + w]), []).append((s, i + 1))
    by = {}
    for where in seen.values():
        if 2 <= len(where) <= cap:
            for (a, i), (b, j) in itertools.product(where, where):
                if a < b:
                    by.setdefault((a, b), []).append((i, j))
    out = []
    for (a, b), m in by.items():
        run = None
        for i, j in sorted(m):
            if run and i == run[2] + 1 and j == run[3] + 1:
                run[2:] = [i, j]
            else:
                if run:
                    out.append((a, b, run[0], run[1], run[2] - run[0] + w))
                run = [i, j, i, j]
        out.append((a, b, run[0], run[1], run[2] - run[0] + w))
    return sorted(out)


def test_fragments(spark):
    rng = random.Random(7)
    for n, cap in ((3, 50), (3, 4)):
        seqs = {s: [rng.choice("abc") for _ in range(rng.randint(0, 14))] for s in range(n)}
        df = spark.createDataFrame([(s, i, x) for s, v in seqs.items() for i, x in enumerate(v)], "s long, o long, v string")
        assert rows(similar.fragments(df, "s", "o", "v", window=3, cap=cap)) == brute_fragments(seqs, 3, cap)


def test_degrees_and_gradient(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    e = pairs(spark, [(0, 1), (0, 1), (1, 2), (3, 1), (2, 2)])
    d = graph.degrees(nodes, e)
    assert rows(d, "node", "fan_in", "fan_out", "instability") == [(0, 0, 1, 1.0), (1, 2, 1, 1 / 3), (2, 1, 0, 0.0), (3, 0, 1, 1.0), (4, 0, 0, 0.0)]
    assert rows(graph.gradient(pairs(spark, [(2, 1), (1, 0), (0, 3), (0, 1)]), d), "src", "dst") == [(1, 0), (2, 1)]


def reachable(edges, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in edges:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graphs_as_brute_force(spark, seed):
    rng = random.Random(seed)
    e = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(12)})
    df = pairs(spark, [*e, (None, 1)])
    r = {n: reachable(e, n) for n in range(9)}
    want = sorted((n, min(m for m in r[n] if n in r[m])) for n in range(9) if any(m != n and n in r[m] for m in r[n]))
    assert rows(graph.scc(df)) == [(n, min(n, c)) for n, c in want]
    und = e + [(b, a) for a, b in e]
    touched = sorted({x for p in e for x in p})
    assert rows(graph.components(df, "src", "dst")) == [(n, min({n} | reachable(und, n))) for n in touched]
    seeds = spark.createDataFrame([(0,), (77,)], "node long")
    assert rows(graph.closure(df, seeds)) == [(n,) for n in sorted({0, 77} | r[0])]
    starts = df.select(F.col("src").alias("start"), F.col("dst").alias("node")).where("start is not null")
    hops = {}
    for s in range(9):
        front, seen = {d for a, d in e if a == s} - {s}, {}
        for h in (1, 2):
            for x in front:
                seen.setdefault(x, h)
            front = {d for x in front for a, d in e if a == x} - {s} - set(seen)
        hops |= {(s, n): h for n, h in seen.items()}
    assert rows(graph.reach(df, starts, 2)) == sorted((s, n, h) for (s, n), h in hops.items())
    bad = {n: rng.random() < 0.7 for n in range(8)}
    good = {n for n in bad if not bad[n]}
    while more := {n for n in bad if n not in good and all(d in good for s, d in e if s == n)}:
        good |= more
    got = graph.settle(spark.createDataFrame([(n, b) for n, b in bad.items()], "node long, bad boolean"), df)
    assert rows(got) == [(n, n not in good) for n in sorted(bad)]


def test_scores(spark):
    one = spark.createDataFrame([(5.0, 0.0)], "x double, z double")
    val = lambda c: one.select(c.alias("v")).first().v
    x, z = F.col("x"), F.col("z")
    assert val(scoring.composite([(0.5, x, 10), (0.5, x, 0), (0.25, x, 1), (2.0, z, 0)])) == 1.0
    assert [val(scoring.ramp(x, *lh)) for lh in ((0, 10), (5, 9), (1, 5), (9, 1), (1, 0), (7, 7))] == [0.5, 0, 1, 1, 1, 1]
    assert val(scoring.ratio(x, z)) == 0 and val(scoring.deficit(x, z)) == 0 and val(scoring.over_limit(x, z, 0.1)) is False
    assert val(scoring.weighted([x / 5, z + 0.9], [0.5, 0.5])) == pytest.approx(0.9)
    assert val(scoring.weighted([z, z], [0.5, 0.5])) == 0 and val(scoring.weighted([z], [0.0])) == 0 and val(scoring.weighted([z + 1], [0.0])) == 0
    assert val(scoring.first_gate([("a", x > 9), ("b", x > 1), ("c", x > 1)])) == "b"
    assert rows(sets.flags(one, [("r", x, 4), ("s", x, 5)], ["x"])) == [(5.0, "r", 5.0, 4.0)]
    d = scoring.diff(one, one.withColumn("x", x + 1), ["x", "z"])
    assert rows(d) == [("x", 5.0, 6.0, 1.0), ("z", 0.0, 0.0, 0.0)]
    assert one.agg(scoring.calibrated(x, 3).alias("v")).first().v == 6


def test_near_dups_without_a_cap_as_brute_force(spark):
    from collections import Counter

    rng = random.Random(8)
    vocab, docs = [f"w{i}" for i in range(60)], []
    for i in range(120):
        t = list(rng.choice(docs)[1]) if docs and rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(40, 49))]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        docs.append((i, t))
    want = {}
    for i, x in docs:
        for j, y in docs[i + 1 :]:
            m = sum((Counter(x) & Counter(y)).values())
            if len(x) // 10 == len(y) // 10 and m / (len(x) + len(y) - m) >= 0.85:
                want[i, j] = m / (len(x) + len(y) - m)
    df = spark.createDataFrame(docs, "id long, t array<string>")
    assert len(want) > 50 and rows(similar.near_dups(df, "id", "t")) == []
    assert {(a, b): s for a, b, s in rows(similar.near_dups(df, "id", "t", cap=None))} == pytest.approx(want)


def test_fragments_of_many_sequences_without_a_cap(spark):
    seqs = {s: [f"x{s}", "a", "b", "c", "d", f"y{s}"] for s in range(55)}
    seqs[54] = ["a", "b", "c", "d"] * 2
    df = spark.createDataFrame([(s, i, v) for s, x in seqs.items() for i, v in enumerate(x)], "s long, o long, v string")
    want = brute_fragments(seqs, 3, 10**9)
    assert len(want) > 54 * 53 // 2 and rows(similar.fragments(df, "s", "o", "v", window=3)) == []
    assert rows(similar.fragments(df, "s", "o", "v", window=3, cap=None)) == want


def test_near_dups_of_any_length_and_once(spark):
    from collections import Counter

    rng, docs = random.Random(9), []
    for size in (1, 9, 10, 11, 63, 64, 600, 5000):
        base = [f"w{int(rng.expovariate(0.01))}" for _ in range(size)]
        for k in range(6):
            t = [x if rng.random() > 0.03 * k else (None if rng.random() < 0.1 else f"y{rng.random()}") for x in base]
            docs.append((len(docs), t, f"c{len(docs)}"))
    docs.append((len(docs), docs[40][1], "c40"))
    want, bare = {}, lambda t: Counter(x for x in t if x is not None)
    for i, x, p in docs:
        for j, y, q in docs[i + 1 :]:
            m = sum((bare(x) & bare(y)).values())
            if len(x) // 10 == len(y) // 10 and m / (len(x) + len(y) - m) >= 0.85 and "c40" not in (p, q):
                want[i, j] = m / (len(x) + len(y) - m)
    df = spark.createDataFrame(docs, "id long, t array<string>, c string")
    got = {(a, b): s for a, b, s in rows(similar.near_dups(df, "id", "t", cap=None, once="c"))}
    assert got == pytest.approx(want) and len({len(docs[a][1]) for a, _ in want}) >= 6
