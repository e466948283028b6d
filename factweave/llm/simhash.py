"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees in shards.

Fingerprints: shingle hashes are built from built-in expressions; an Arrow function adds up bits.
Links: two fingerprints within r bits agree on all but r of B blocks, so each fingerprint goes to one
shard per choice of r blocks to leave out, keyed by the bits that stay; at the first level by so many of
them only that a shard holds about TREE fingerprints. A shard is a set of distinct
fingerprints; its BK-tree (children keyed by Hamming distance to the parent, leaves of a few
fingerprints) is searched along edges within the radius only. Shards over `shard_rows` aren't
searched: their members go to the next level, which keeps more bits, and at the last level 48 of the
64 bits agree, so a shard holds 65,536 fingerprints at most. No shard, however hot, is unbounded, and
none is dropped.

A tree over the fingerprints of all documents would grow with the corpus, so trees meet the
fingerprints that can match them by the shard's key and aren't broadcast to every task.

A shard returns each of its classes as a star (smallest fingerprint, member), never all pairs. Stars
become components by alternating star rounds on checkpointed tables.

Defined results: a null or empty text has fingerprint 0 and links like any other. Documents with
equal fingerprints are linked. Null ids are allowed; they are never a component's name unless
all ids in it are null. Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factweave.functions.session import checkpointed
from factweave.llm.common import free_name, load, lower_ascii, words_of
from factweave.operators.graph import components as graph_components

SHINGLE, RADIUS, SHARD_ROWS, TREE, LEAF = 3, 3, 8192, 2048, 24


def with_shingle_hashes(df: DataFrame, text: Column, out: str, width: int = SHINGLE) -> DataFrame:
    """XXH64 (seed 42) of each word shingle of the lower-cased text, repeats included; fewer words make one shingle."""
    w, n = F.col("_w"), F.size("_w")
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))))
    whole = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_w", words_of(lower_ascii(text))).withColumn(out, F.when(n >= width, each).otherwise(whole)).drop("_w")


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        block = np.ascontiguousarray(h[at : at + (1 << 16)], dtype="<i8")
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _majority(hashes: pd.Series) -> pd.Series:
    return hashes.map(majority)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """docs' columns and a fingerprint (signed 64-bit)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    df = with_shingle_hashes(docs.select(row, F.col(f"`{text}`").alias("t")), F.col("t"), "hs", width)
    return df.select("row", _majority("hs").alias("fp")).select("row.*", F.col("fp").alias(free_name(docs, out)))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose 64-bit words are the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _wide(fps: np.ndarray) -> np.ndarray:
    return fps[:, None] if fps.ndim == 1 else fps


class BKTree:
    """Over an array of distinct unsigned fingerprints, of one or more words of 64 bits. A node is (root, {distance: child}); small sets stay as leaves."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps, self.leaf, self.branches = fps, leaf, 0
        fps = self.fps = _wide(fps)
        self.top = None if not len(fps) else [np.arange(len(fps)), None]
        todo = [self.top] if self.top else []
        while todo:
            node = todo.pop()
            members = node[0]
            if len(members) <= leaf:
                continue
            root, rest = members[0], members[1:]
            d = _near(fps[rest], fps[root])
            order = np.argsort(d, kind="stable")
            cuts = np.flatnonzero(np.diff(d[order])) + 1
            children = {int(d[part[0]]): [rest[part], None] for part in np.split(order, cuts) if len(part)}
            node[0], node[1] = root, children
            self.branches += 1
            todo += children.values()

    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(fingerprint's index, indices of queries within the radius), by edges within the radius only."""
        queries = _wide(queries)
        todo = [(self.top, np.arange(len(queries)))] if self.top else []
        while todo:
            (at, children), q = todo.pop()
            if children is None:
                near = _near(self.fps[at][:, None], queries[q][None]) <= radius
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    yield int(at[i]), q[near[i]]
                continue
            d = _near(queries[q], self.fps[at])
            near = q[d <= radius]
            if len(near):
                yield int(at), near
            for k, child in children.items():
                if (go := np.abs(d - k) <= radius).any():
                    todo.append((child, q[go]))


def classes(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of a shard's distinct fingerprints the index of its class' first member."""
    label = np.arange(len(fps))
    for i, near in BKTree(fps).matches(fps, radius):
        got = label[near]
        if (got != label[i]).any():
            old = np.unique(np.append(got, label[i]))
            label[np.isin(label, old)] = old[0]
    return label


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by (part, kept bits); a shard may go on in the next batch."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def stars(part: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(bits) != 0)) + 1
            ends = np.append(cuts, len(fp))
            a, b = [], []
            for lo, hi in zip(np.append(0, cuts), ends, strict=True):
                if hi - lo < 2:
                    continue
                own = np.unique(fp[lo:hi])
                label = classes(own.view(np.uint64), radius)
                if (hang := np.flatnonzero(label != np.arange(len(own)))).size:
                    a.append(own[label[hang]])
                    b.append(own[hang])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], ["a", "b"])

        for batch in batches:
            now = tuple(np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield stars(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if len(held[0]):
            yield stars(*held)

    return run


def levels(radius: int, bits: int = 64) -> list[list[int]]:
    """Masks of the bits that stay, by level: blocks are 64 bits cut in ever more parts, and each choice of `radius` parts is left out once. At the first level only the first `bits` of them stay, which parts no pair."""
    out = []
    for parts in (radius + 1, 2 * radius, 2 * radius + 2, 4 * radius):
        edges = [64 * i // parts for i in range(parts + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        out.append([sum(blocks[i] for i in range(parts) if i not in skip) for skip in combinations(range(parts), radius)])
    out[0] = sorted({_lowest(m, bits) for m in out[0]})
    return out


def _lowest(mask: int, bits: int) -> int:
    """The lowest set bits of a mask, so many of them."""
    out = 0
    for _ in range(min(bits, mask.bit_count())):
        out |= mask & -mask
        mask &= mask - 1
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, *keys: str, by: int | None = None) -> DataFrame:
    """Rows sorted by keys, those of equal keys (of the first `by`) in one task. They are dealt by a hash of the keys: an exchange by the keys themselves would be dropped behind a join by them, whose own may then be read locally (map output by map output), which tears shards apart."""
    return rows.repartition(F.xxhash64(*keys[:by])).sortWithinPartitions(*keys)


def links(fps: DataFrame, fp: str = "fingerprint", radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree: int = TREE) -> DataFrame:
    """Stars (a, b) that connect distinct fingerprints exactly as all pairs within the radius would."""
    left = checkpointed(fps.select(F.col(fp).alias("fp")).distinct())
    found, steps = None, levels(radius, max(0, (left.count() // tree).bit_length()))
    for n, masks in enumerate(steps):
        parts = F.array(*(F.struct(F.lit(i).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)))
        keyed = left.select("fp", F.explode(parts).alias("x")).select("x.part", "x.bits", "fp")
        size = keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1")
        if n + 1 < len(steps):
            hot = checkpointed(keyed.join(size.where(F.col("n") > shard_rows), ["part", "bits"], "left_semi").select("fp").distinct())
            more = not hot.isEmpty()
        else:
            more = False
        cold = keyed.join(size.where(F.col("n") <= shard_rows) if more else size, ["part", "bits"], "left_semi")
        shards = dealt(cold, "part", "bits").select("part", "bits", "fp")
        got = shards.mapInArrow(_search(radius), "a long, b long")
        found = got if found is None else found.union(got)
        if not more:
            break
        left = hot
    return checkpointed(found.distinct())


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (signed 64-bit) and component_id, the smallest doc_id reachable; one row per row of docs."""
    fps = checkpointed(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width=width).select("doc_id", "fingerprint"))
    return fps.join(component_names(fps, radius), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def component_names(fps: DataFrame, radius: int) -> DataFrame:
    """fingerprint, component_id for a table (doc_id, fingerprint)."""
    low = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    linked = graph_components(links(fps, radius=radius)).withColumnsRenamed({"node": "fingerprint"})
    named = low.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    name = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return named.join(name, "component").select("fingerprint", "component_id")


def query(spark, sf_dir):
    c = components(load(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
