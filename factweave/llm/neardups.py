"""Near-duplicate removal: documents whose sets of word shingles have a Jaccard similarity of `similarity` or more, found by SimHash and BK-trees.

At a similarity of 0.8 two 64-bit fingerprints differ in ten bits or so, where most pairs of a corpus of size
begin to look alike. So fingerprints have WORDS times 64 bits, which estimate the angle closely enough for a
radius, and trees stand over shards: the documents that share a shingle that comes first among theirs in one of a
few fixed orders. A pair shares it in each order with the probability of its similarity, so four orders miss
0.2 % of the pairs at 0.8. A shard's BK-tree (children keyed by Hamming distance to the parent) is searched along
edges within the radius. Each document then names its nearest ones and, of those that the tree connects, the one
with most near ones: a few candidates each, however large a group is, never all pairs. Candidates are verified by
the exact similarity of their shingles (32-bit hashes, from a table that is read for them only). Sets are several times
as large as anything else here, so a pair first compares bitmaps of the parity of its shingles, about a bit or two each:
they differ in no more bits than the sets do in shingles, so pairs that differ in too many are dropped without their sets.

Shards over `shard_rows` go to the next level, where documents share more shingles at once; at the last level any
size is searched, since those share four shingles in one of eight ways.

What these steps leave out (other than the nearest ones, pairs outside the radius or without a common first shingle, large
shards' members at deeper levels) is found exactly: sets of that similarity share a shingle of their prefixes, so pairs
that share one and stand in different components so far are verified too, if enough of both sets comes after it.

Links become components; of each component the document with the smallest id stays.

Defined results: documents of equal words (ASCII letters lower-cased) are duplicates, those without words (null,
empty) of each other too; fewer words than a shingle make one shingle. Null ids come first. Rows repeated in all
columns, or in id and text, are reduced to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed, shared_dir
from factweave.llm.common import lower_ascii, text_key
from factweave.llm.simhash import BKTree, _near, dealt
from factweave.llm.substring import M1, mix, rolled, split, word_hashes
from factweave.llm.tokens import slices
from factweave.operators.graph import components as graph_components

SHINGLE, SIMILARITY, WORDS, NEAREST, SHARD_ROWS = 5, 0.8, 4, 3, 2048
#: Three standard deviations over the 39 of 256 bits that differ at a similarity of 0.8 on average.
RADIUS = 56
#: Orders whose first shingle a document must share, by level.
LEVELS = (((0,), (1,), (2,), (3,)), ((0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7)), ((0, 1, 2, 3), (4, 5, 6, 7), (0, 2, 4, 6), (1, 3, 5, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 3, 5, 6), (1, 2, 4, 7)))
ORDERS = 8


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * M1 + np.uint64(salt))


def shingles(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, from those of its words."""
    return np.unique(rolled(h, min(width, len(h)), M1)) if len(h) else np.zeros(0, np.uint64)


def signature(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of so many words of 64 bits: a bit is set where it is in over half of the shingles' hashes."""
    out = np.zeros((words, 64), np.int64)
    seeds = _seeds(words, 11)
    for at in range(0, len(own), 1 << 14):
        block = mix(own[at : at + (1 << 14), None] ^ seeds[None, :]).astype("<u8")
        out += np.unpackbits(block.view(np.uint8).reshape(len(block), words, 8), axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * out > len(own), axis=1, bitorder="little").view("<u8")[:, 0]


def anchors(own: np.ndarray, n: int = ORDERS) -> np.ndarray:
    """The first shingle in each of n fixed orders."""
    return np.array([mix(own ^ s).min() for s in _seeds(n, 77)], np.uint64) if len(own) else np.zeros(n, np.uint64)


def parity(own: np.ndarray) -> np.ndarray:
    """Bitmap of a set of 32-bit hashes: which of its places, a power of two and one per member at least, an odd number of members falls on."""
    places = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount(own & np.uint32(places - 1), minlength=places) & 1, bitorder="little")


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, at the size of the smaller one: the sets differ in so many members at least."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tkey and lower-cased text to doc_id, tkey, key (of the words), signature, anchors, shingles (32-bit hashes), their number and their bitmap."""
    for whole in batches:
        for batch in slices(whole, 2):
            words, count = split(batch.column(2))
            h, ends = word_hashes(words), np.cumsum(count)
            keys, sigs, firsts, sets, sizes, bits = [], [], [], [], [], []
            for lo, hi in zip((ends - count).tolist(), ends.tolist(), strict=True):
                own = shingles(h[lo:hi])
                keys.append(xxhash.xxh3_128_digest(h[lo:hi].tobytes()))
                sigs.append(signature(own).view(np.int64).tolist())
                firsts.append(anchors(own).view(np.int64).tolist())
                short = np.unique((own >> np.uint64(32)).astype("<u4"))
                sets.append(short.tobytes())
                sizes.append(len(short))
                bits.append(parity(short).tobytes())
            lists, binary = pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, binary), pa.array(sigs, lists), pa.array(firsts, lists), pa.array(sets, binary), pa.array(sizes, pa.int32()), pa.array(bits, binary)], ["doc_id", "tkey", "key", "sig", "firsts", "shingles", "n", "bits"])


def candidates(fps: np.ndarray, radius: int, nearest: int = NEAREST) -> list[tuple[int, int]]:
    """For each member of a shard its nearest ones within the radius, and the member of its class with most near ones."""
    n = len(fps)
    label, degree, out = np.arange(n), np.zeros(n, np.int64), set()
    for i, near in BKTree(fps).matches(fps, radius):
        near = near[near != i]
        if not len(near):
            continue
        degree[i] = len(near)
        d = _near(fps[near], fps[i])
        for j in near[np.argsort(d, kind="stable")[:nearest]].tolist():
            out.add((min(i, j), max(i, j)))
        got = label[near]
        if (got != label[i]).any():
            old = np.unique(np.append(got, label[i]))
            label[np.isin(label, old)] = old[0]
    order = np.lexsort((-degree, label))
    hubs = {int(label[k]): int(k) for k in order[::-1]}
    for i in np.flatnonzero(degree).tolist():
        hub = hubs[int(label[i])]
        if hub != i:
            out.add((min(i, hub), max(i, hub)))
    return sorted(out)


def _shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by shard and key, so that a shard's candidates are the same in every run; a shard may go on in the next batch."""
        held: list[pa.RecordBatch] = []

        def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shard = np.array(rows.column("shard").to_pylist(), object)
            cuts = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
            keys, sig, a, b, lo = rows.column("key").to_pylist(), np.array(rows.column("sig").to_pylist(), np.int64).view(np.uint64), [], [], 0
            for hi in cuts.tolist():
                if hi - lo > 1:
                    for i, j in candidates(np.ascontiguousarray(sig[lo:hi]), radius):
                        x, y = sorted((keys[lo + i], keys[lo + j]))
                        a.append(x)
                        b.append(y)
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            last = rows.column("shard")[-1].as_py()
            first = rows.num_rows
            shards = batch.column(0).to_pylist()
            k = batch.num_rows
            while k and shards[k - 1] == last:
                k -= 1
            if k:  # whole shards end within this batch
                first = rows.num_rows - batch.num_rows + k
                yield from search(rows.slice(0, first))
                held = [batch.slice(k)]
        if held:
            yield from search(pa.Table.from_batches(held))

    return run


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose bitmaps don't rule the similarity out: sets of n and m members that are as similar differ in (n + m) * (1 - s) / (1 + s) at most."""
        for batch in batches:
            most = (batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            bits = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            d = np.array([differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in bits], np.int64)
            yield batch.select([0, 1]).filter(pa.array(d <= most))

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def links(table: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Verified pairs (a, b) of keys, for a table of key, sig, firsts, shingles, n and bits."""
    left = checkpointed(table.groupBy("key").agg(F.first("sig").alias("sig"), F.first("firsts").alias("firsts")))
    found = None
    for n, ways in enumerate(LEVELS):
        at = F.array(*(F.xxhash64(F.lit(n * 100 + k), *(F.col("firsts")[i] for i in way)) for k, way in enumerate(ways)))
        keyed = left.select("key", "sig", F.explode(at).alias("shard"))
        size = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        if n + 1 < len(LEVELS):
            hot = checkpointed(left.join(keyed.join(size.where(F.col("n") > shard_rows), "shard", "left_semi").select("key").distinct(), "key", "left_semi"))
            size = size.where(F.col("n") <= shard_rows)
        rows = keyed.join(size, "shard", "left_semi").select("shard", "key", "sig")
        got = checkpointed(dealt(rows, "shard", "key", by=1).mapInArrow(_shards(radius), "a binary, b binary").distinct())
        found = got if found is None else found.union(got)
        if n + 1 < len(LEVELS):
            if hot.isEmpty():
                break
            left = hot
    first = verified(found.distinct(), table, similarity)
    return checkpointed(first.union(verified(rest(table, first, similarity), table, similarity)).distinct())


def _with_ends(pairs: DataFrame, table: DataFrame, *columns: str, few: int = 500_000) -> DataFrame:
    """Pairs (a, b) with the columns of both ends, as a_<column> and b_<column>. Only the rows of ends are shuffled, unless there are more than `few`."""
    ends = checkpointed(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    own = table.select("key", *columns).join(F.broadcast(ends) if ends.count() <= few else ends, "key", "left_semi")
    own = own.groupBy("key").agg(*(F.first(c).alias(c) for c in columns))
    for k in "ab":
        pairs = pairs.join(own.select(F.col("key").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns)), k)
    return pairs.select("a", "b", *(f"{k}_{c}" for c in columns for k in "ab"))


def verified(found: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingles are as similar. Sets are read and sent only for pairs that their bitmaps leave."""
    some = checkpointed(_with_ends(found, table, "n", "bits").mapInArrow(_possible(similarity), "a binary, b binary"))
    return checkpointed(_with_ends(some, table, "shingles").mapInArrow(_verify(similarity), "a binary, b binary"))


def prefix(own: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY, order: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set, so many that similar sets share one of them: those not in `common` by their hashes, then the common ones from the last to the first. order: that of `common` by value, where it is known."""
    n = len(own)
    k = n - int(np.ceil(similarity * n - 1e-6)) + 1 if n else 0
    order = np.argsort(common, kind="stable") if order is None else order
    at = order[np.minimum(np.searchsorted(common, own, sorter=order), len(common) - 1)] if len(common) else np.zeros(n, np.int64)
    rank = np.where(common[at] == own, len(common) - at, 0) if len(common) else at
    return own[np.lexsort((own, rank))[:k]]


def _prefixes(common: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(common, kind="stable")
        for batch in batches:
            own = [prefix(np.frombuffer(x, "<u4"), common, similarity, order) for x in batch.column(2).to_pylist()]
            flat, ends = np.concatenate([*own, np.zeros(0, "<u4")]).view("<i4"), np.cumsum([0, *map(len, own)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "n", "prefix"])

    return run


def _across(similarity: float):
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of keys of one shingle that no links join yet and whose sets can be as similar if this is the first shingle they share: no
        more than what comes after it is common to both. Rows are sorted by shingle and key; a shingle may go on in the next batch."""
        held: list[pa.RecordBatch] = []

        def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shard, n, at = (rows.column(k).to_numpy() for k in (0, 3, 4))
            edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            many = np.flatnonzero(np.diff(edges) > 1)
            if not len(many):
                return
            n, alone = n.astype(np.int64), rows.column(2).is_null().to_numpy()
            label, after = np.unique(rows.column(2).fill_null(0).to_numpy(), return_inverse=True)[1], n - at
            label = np.where(alone, -1 - np.arange(len(n)), label)
            keys, a, b, size = pa.array(rows.column(1).to_pylist(), pa.binary()), [], [], 0
            both = lambda: pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])
            for lo, hi in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
                for i in range(lo, hi - 1):
                    r = slice(i + 1, hi)
                    j = np.flatnonzero((label[r] != label[i]) & (np.minimum(after[r], after[i]) >= share * (n[r] + n[i]) - 1e-6)) + i + 1
                    if len(j):
                        a.append(np.full(len(j), i))
                        b.append(j)
                        size += len(j)
                        if size >= 1 << 16:
                            yield both()
                            a, b, size = [], [], 0
            if size:
                yield both()

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            k = int(np.searchsorted(shard, shard[-1])) if shard[0] != shard[-1] else 0
            if k or (held and held[0].column(0)[0].as_py() != shard[0]):
                yield from search(pa.Table.from_batches([*held, batch.slice(0, k)]))
                held = []
            held.append(batch.slice(k))
        if held:
            yield from search(pa.Table.from_batches(held))

    return run


def rest(table: DataFrame, linked: DataFrame, similarity: float, sample: int = 20_000, most: int = 200_000) -> DataFrame:
    """The exact way for what trees, nearest ones and deeper levels leave out: pairs (a, b) of keys that share a shingle of their prefixes
    and aren't in one component of `linked`. Sets of that similarity always share one, whatever the order of shingles; the order takes
    the `most` commonest shingles of about `sample` rows last, which only keeps groups small. Prefixes are joined and sent, whole sets aren't."""
    some = table.select("shingles").sample(min(1.0, sample / max(1, table.count())), seed=7)
    some = some.mapInArrow(_each_shingle, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 2")
    common = np.array([r.s for r in some.orderBy(F.desc("n"), "s").limit(most).collect()], "<i4").view("<u4")
    names = graph_components(linked).select(F.col("node").alias("key"), F.xxhash64("component").alias("component"))
    heads = table.select("key", "n", "shingles").mapInArrow(_prefixes(common, similarity), "key binary, n int, prefix array<int>")
    heads = heads.groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).join(names, "key", "left")
    rows = heads.select("key", "component", "n", F.posexplode("prefix").alias("at", "shard")).select("shard", "key", "component", "n", "at")
    return checkpointed(dealt(rows, "shard", "key", by=1).mapInArrow(_across(similarity), "a binary, b binary").distinct())


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a batch of sets with their number of sets."""
    for batch in batches:
        s, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], ["s", "n"])


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey (of the text), key (of the words), sig, firsts, shingles, n and bits of every row: computed once, written to the shared folder and read by columns."""
    spark, t = docs.sparkSession, F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(t).alias("tkey"), lower_ascii(t).alias("t"))
    kind = own.schema["doc_id"].dataType.simpleString()
    out = f"{shared_dir(spark)}/near-dups/{uuid.uuid4().hex}"
    own.mapInArrow(_table, f"doc_id {kind}, tkey binary, key binary, sig array<long>, firsts array<long>, shingles binary, n int, bits binary").write.parquet(out)
    return spark.read.parquet(out)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component: the one with the smallest id, then of the smallest text key. Same columns as docs."""
    table = prepared(docs, doc_id, text)
    names = graph_components(links(table, similarity)).withColumnsRenamed({"node": "key"})
    rows = table.select("doc_id", "tkey", "key").join(names, "key", "left").select(F.coalesce("component", "key").alias("component"), "doc_id", "tkey")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "tkey")).alias("x")).select(F.col("x.doc_id").alias("_doc"), F.col("x.tkey").alias("_text"))
    again = table.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    t, i = text_key(F.col(f"`{text}`")), F.col(f"`{doc_id}`")
    mine = lambda b: docs.join(b, t.eqNullSafe(b["_text"]) & i.eqNullSafe(b["_doc"]), "left_semi")
    best, again = checkpointed(best), checkpointed(again)
    if again.isEmpty():
        return mine(best)
    same = best["_text"].eqNullSafe(again["_key"]) & best["_doc"].eqNullSafe(again["_id"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    least = mine(best.join(again, same, "left_semi")).select(t.alias("k"), i.alias("i"), row).groupBy("k", "i").agg(F.min("row").alias("row")).select("row.*")
    return mine(best.join(again, same, "left_anti")).unionByName(least)
