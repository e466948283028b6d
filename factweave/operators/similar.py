"""Similarity kernels: near-duplicate pairs and shared fragments (K7, K8)."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed, ship


#: near_dups counts tokens by so many hashes; the driver and each task hold that many counts.
SLOTS = 1 << 16
#: Ids of up to so many candidate pairs are broadcast, so that only their tokens are shuffled.
ENDS = 500_000
#: Rows of a bucket that have pairs are dealt to groups of about so many; pairs of two groups are one task's cell.
CELL = 1_000


def _prefixes(held: np.ndarray, tau: float, bucket: int):
    """For mapInArrow: rows with hashes to the different hashes of their prefix and a bitmap of parities, as wide as their bucket asks for."""

    def run(batches):
        for b in batches:
            n, lists = b.column("n").to_numpy(), b.column("hashes")
            size = np.asarray(lists.value_lengths())
            h, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), size)
            wide = 1 << np.clip(np.ceil(np.log2((n // bucket + 1) * bucket)), 7, 15).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(wide)])
            bits = np.bincount(start[row] + ((h >> 16) & (wide[row] - 1)), minlength=start[-1]) & 1
            h = h[np.lexsort((h, held[h & (SLOTS - 1)], row))]
            at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            take = (at < (n - np.ceil(tau * n - 1e-6) + 1)[row]) & ((at == 0) | (h != np.roll(h, 1)))
            firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[take], minlength=len(n)))]), pa.int32()), pa.array(h[take]))
            bitmap = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(np.packbits(bits.astype(np.uint8)))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n", "mark")), firsts, bitmap], ["id", "n", "mark", "firsts", "bits"])

    return run


def _possible(tau: float):
    """For mapInArrow: pairs whose bitmaps differ in no more bits than multisets of similarity tau may."""

    def run(batches):
        for b in batches:
            limit = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) * (1 - tau) / (1 + tau) + 1e-6
            x = ((int.from_bytes(p) ^ int.from_bytes(q)).bit_count() for p, q in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()))
            yield b.filter(pa.array(np.fromiter(x, np.int64, len(limit)) <= limit)).select(["a", "b", "n_a", "n_b"])

    return run


def _shared(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """For the pairs and rows of a cell: the tokens that pairs share, repeats included. Tokens become numbers once a row, not once a pair."""
    code, sets = defaultdict(itertools.count().__next__), {}
    for i, n, tokens in zip(rows.column("id").to_pylist(), rows.column("n").to_pylist(), rows.column("tokens").to_pylist()):
        seen = Counter(tokens)
        sets[i, n] = {code[t, k] for t, c in seen.items() for k in range(c)}
    ends = [pairs.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b")]
    x = [len(sets[a, n] & sets[b, m]) for a, b, n, m in zip(*ends)]
    return pa.table([*(pairs.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(x, pa.int64())], names=["a", "b", "n_a", "n_b", "shared"])


def near_dups(df: DataFrame, id: str, tokens: str, tau: float = 0.85, bucket: int = 10, cap: int | None = 50, once: str | None = None) -> DataFrame:
    """K7: pairs a < b within one size bucket whose multiset Jaccard, sum of minima over sum of maxima, is tau or more. Buckets of more than `cap` rows are skipped, as the reference does; with cap=None none is.
    With `once`, rows whose value there occurs twice or more are left out.

    Tokens are ordered by how often their slot is held, repeats included. Two rows of similarity tau share one
    of their first n - ceil(tau * n) + 1 at least, so pairs meet through those only. Of pairs that meet, bitmaps rule
    out those that differ too much; the rest are verified over all tokens. Hashes only let more pairs meet.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id).alias("id"), F.filter(tokens, lambda t: t.isNotNull()).alias("tokens"), F.size(tokens).cast("long").alias("n"), *([F.col(once).alias("mark")] if once else [F.lit(None).cast("string").alias("mark")])).where("n > 0")
    hashed = rows.select("id", "n", "mark", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    held = np.zeros(SLOTS, np.int64)
    for slot, n in rows.select(F.explode("tokens").alias("t")).groupBy(F.xxhash64("t").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count("*")).collect():
        held[slot] = n
    kind = {f.name: f.dataType.simpleString() for f in hashed.schema.fields}
    table = hashed.mapInArrow(_prefixes(held, tau, bucket), f"id {kind['id']}, n long, mark {kind['mark']}, firsts array<long>, bits binary")
    table = checkpointed(table.withColumn("bucket", F.floor(F.col("n") / bucket)))
    if once:
        table = table.join(table.groupBy("mark").agg(F.count("*").alias("_rows")).where("_rows = 1").select("mark"), "mark", "left_semi")
    if cap is not None:
        table = table.join(table.groupBy("bucket").agg(F.count("*").alias("_rows")).where(F.col("_rows").between(2, cap)).select("bucket"), "bucket", "left_semi")
    first = table.select("bucket", "id", "n", F.explode("firsts").alias("h"))
    a, b = (first.select("bucket", "h", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = a.join(b, ["bucket", "h"]).where("a < b").where(F.least("n_a", "n_b") >= tau * F.greatest("n_a", "n_b") - 1e-6).select("a", "b", "n_a", "n_b").distinct()
    a, b = (table.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    pair = f"a {kind['id']}, b {kind['id']}, n_a long, n_b long"
    near = checkpointed(met.join(a, ["a", "n_a"]).join(b, ["b", "n_b"]).mapInArrow(_possible(tau), pair).distinct())
    at = {x: F.pmod(F.xxhash64(x), F.greatest(F.lit(1), F.ceil(F.col("of") / CELL))) for x in "ab"}
    of = near.groupBy(F.floor(F.col("n_a") / bucket).alias("bucket")).agg(F.count_distinct("a").alias("of"))
    celled = checkpointed(near.withColumn("bucket", F.floor(F.col("n_a") / bucket)).join(of, "bucket").select("a", "b", "n_a", "n_b", F.struct("bucket", at["a"].alias("i"), at["b"].alias("j")).alias("cell")))
    ends = celled.select(F.col("a").alias("id"), F.col("n_a").alias("n"), "cell").union(celled.select("b", "n_b", "cell")).distinct().groupBy("id", "n").agg(F.collect_list("cell").alias("cells"))
    ends = F.broadcast(ends) if near.count() <= ENDS else ends
    whole = rows.select("id", "n", "tokens").join(ends, ["id", "n"]).select("id", "n", "tokens", F.explode("cells").alias("cell"))
    both = celled.groupBy("cell").cogroup(whole.groupBy("cell")).applyInArrow(_shared, f"{pair}, shared long")
    sim = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= tau)


def fragments(rows: DataFrame, seq: str, ord: str, value: str, size: str | None = None, window: int = 3, min_size: int = 0, cap: int | None = 50) -> DataFrame:
    """K8: maximal shared runs of rows between two sequences: seq_a < seq_b, start_a, start_b, rows.

    Windows of `window` rows are keyed by the SHA-256 of their rows' own, so no row's text is shuffled; groups of 2 to `cap`
    windows make pairs across sequences, as in the reference; with cap=None groups of any size do. The result
    has a row for each pair of sequences, so it grows with the square of a group. Matches merge where each follows the other directly in (a, b) order. With `size`, runs whose rows of a sum to less are left out.
    """
    w = Window.partitionBy("seq").orderBy("ord")
    own = F.coalesce(F.unhex(F.sha2(F.col(value).cast("string").cast("binary"), 256)), F.lit(b""))
    x = rows.select(F.col(seq).alias("seq"), F.col(ord).alias("ord"), own.alias("own"), (F.col(size) if size else F.lit(1)).alias("size"))
    x = x.withColumn("at", F.row_number().over(w))
    spans = x.withColumn("rows", F.collect_list("own").over(w.rowsBetween(0, window - 1))).where(F.size("rows") == window)
    joined = F.concat(*(F.concat(F.lit(b"."), F.get("rows", F.lit(k))) for k in range(window)))
    out = window_runs(spans.select("seq", "at", F.xxhash64("rows").alias("h"), F.unhex(F.sha2(joined, 256)).alias("values")), window, cap)
    if not min_size:
        return out
    upto = x.withColumn("upto", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    upto = upto.groupBy(F.col("seq").alias("seq_a")).agg(F.sort_array(F.collect_list(F.struct("at", "upto"))).getField("upto").alias("upto"))
    last, before = F.get("upto", (F.col("start_a") + F.col("rows") - 2).cast("int")), F.coalesce(F.get("upto", F.col("start_a") - 2), F.lit(0))
    return out.join(upto, "seq_a").where(last - before >= min_size).drop("upto")


def window_runs(x: DataFrame, window: int, cap: int | None = 50) -> DataFrame:
    """K8 from the windows on: seq, at, h and values of each; equal ones in two sequences merge to runs where each follows the other directly."""
    g = x.groupBy("h", "values").agg(F.count("*").alias("n")).where(F.col("n") >= 2 if cap is None else F.col("n").between(2, cap)).select("h", "values")
    x = x.join(g, ["h", "values"], "left_semi")
    a, b = (x.select("h", "values", F.col("seq").alias(f"seq_{k}"), F.col("at").alias(f"at_{k}")) for k in "ab")
    pairs = a.join(b, ["h", "values"]).where("seq_a < seq_b").select("seq_a", "seq_b", "at_a", "at_b")
    o = Window.partitionBy("seq_a", "seq_b").orderBy("at_a", "at_b")
    follows = (F.col("at_a") - F.lag("at_a").over(o) == 1) & (F.col("at_b") - F.lag("at_b").over(o) == 1)
    runs = pairs.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(o))
    return runs.groupBy("seq_a", "seq_b", "_run").agg(F.min("at_a").alias("start_a"), F.min("at_b").alias("start_b"), (F.count("*") + window - 1).alias("rows")).drop("_run")
