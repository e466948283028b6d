"""Exact substring dedup over words, by prefix-partitioned suffix trees.

A window is `window` words of one document; each word covered by a window that also starts elsewhere
goes. Suffixes (window starts) are split into groups by prefix, each group small enough for a task's
memory, and each group's tree is built down to the window's depth:

1. Prefix: the 8-word gram with the smallest hash inside a window. Equal windows share it, neighbours
   mostly do too, so a group takes runs of neighbouring suffixes as one segment of text.
2. Prefix counts, partially aggregated, tell which groups have one run only; no suffix in those repeats.
   The others are set in a bitmap of fixed size, the only thing that is broadcast. Where the
   corpus outgrows it, it lets more runs pass and changes no result.
3. Variable length: a prefix with more runs than a group may hold (`group_runs`, the same at every size) is
   lengthened to the whole run, and where that occurs once, to the whole window. Such a group is
   a single deep node that needs a count and no tree, so its leaves are counted with partial aggregation
   by 128-bit hashes and never meet in a task. Long prefixes are told by a second bitmap of the same size; prefixes
   that share a bit with one are lengthened too, all their runs alike, which changes no result.
4. Trees: segments of a group become word numbers, each with an end of its own; suffixes are ordered by ranks of doubled
   length, and the prefixes that neighbours share are the tree's inner nodes, of any depth. Nodes at the window's depth or
   deeper that no longer repeat holds are maximal repeats.

Results are keyed by a 128-bit hash of the whole text, so documents of equal text share ranges, and
nothing depends on row numbers.

Defined results: null, empty and short texts lose nothing. Equal documents of a window or more lose all
their words. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed
from factweave.llm.common import load, text_key
from factweave.llm.tokens import slices

WINDOW, GRAM, RUN = 35, 8, 64
BITS, GROUP_RUNS = 27, 10_000
TREE_WORDS = 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts in one row, and each text's number of words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    count = pc.list_value_length(parts).to_numpy().astype(np.int64)
    if not full.all():
        sums = np.append(0, np.cumsum(full))
        ends = np.cumsum(count)
        count = sums[ends] - sums[ends - count]
        flat = flat.filter(pa.array(full))
    return flat.dictionary_encode(), count


def word_hashes(words: pa.DictionaryArray, seed: int = 0) -> np.ndarray:
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in pc.cast(words.dictionary, pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
    return own[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def rolled(h: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """Hash of the string of so many words from each place; at least `width` words follow."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * by + h[k : k + n]
    return mix(out)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` values from each place, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = np.minimum(x[: len(x) - step], x[step:]), done + step
    return x


def runs(h: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, first window and number of windows of each run of neighbouring windows with one prefix. Windows are places in the row of all words."""
    gram = min(GRAM, window)
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = least(rolled(h, gram, M1), window - gram + 1)
    ends = np.cumsum(count)
    starts = ends - count
    number = np.maximum(count - window + 1, 0)
    before = np.cumsum(number) - number
    at = np.repeat(starts - before, number) + np.arange(number.sum())
    a = prefix[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (a[1:] != a[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= place % RUN == 0
    first = np.flatnonzero(new)
    return a[first], at[first], np.diff(np.append(first, len(at)))


def occurrences(h: np.ndarray, a: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """How often a run's prefix stands in it: twice or more where its text repeats within itself."""
    if not len(a):
        return np.zeros(0, np.int64)
    gram = min(GRAM, window)
    size = n + window - gram
    starts = np.cumsum(size) - size
    same = rolled(h, gram, M1)[np.repeat(first - starts, size) + np.arange(size.sum())] == np.repeat(a, size)
    return np.add.reduceat(same, starts, dtype=np.int64)


def _prefixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                words, count = split(batch.column(0))
                h = word_hashes(words)
                a, first, n = runs(h, count, window)
                a, which = np.unique(a, return_inverse=True)
                n = np.bincount(which, occurrences(h, a[which], first, n, window), len(a)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["prefix", "n"])

    return run


def set_bits(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places; words of 64 bits are joined by OR before they come to the driver, at most 2^(bits - 6) of them."""
    at = F.col("prefix").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(prefix & 63 as int))")
    table = repeated.select(F.shiftright(at, 6).alias("i"), one.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("i").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out


def _candidates(window: int, bits: int, shared, hot_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        mask = np.uint64((1 << bits) - 1)
        for whole in batches:
            for batch in slices(whole, 1):
                words, count = split(batch.column(1))
                h = word_hashes(words)
                a, first, n = runs(h, count, window)
                at, bit = ((a & mask) >> np.uint64(6)).astype(np.int64), a & np.uint64(63)
                is_repeated, is_hot = ((b[at] >> bit) & np.uint64(1) == 1 for b in (bitmap, hot))
                go = is_repeated & (is_hot == hot_only)
                a, first, n = a[go], first[go], n[go]
                ends = np.cumsum(count)
                doc = np.searchsorted(ends, first, "right")
                place = first - (ends - count)[doc]
                if hot_only:
                    h2 = word_hashes(words, 1)
                    each = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    nodes = [rolled(x, window, m)[each] if len(each) else np.zeros(0, np.uint64) for x, m in ((h, M1), (h2, M2))]
                    offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                    whole_run = [xxhash.xxh3_128_digest(np.stack([h[i:j], h2[i:j]]).tobytes()) for i, j in zip(first.tolist(), (first + n + window - 1).tolist(), strict=True)]
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in nodes]
                    yield pa.RecordBatch.from_arrays([pa.array(whole_run, pa.binary()), batch.column(0).take(pa.array(doc)), pa.array(place), *lists], ["run", "key", "first", "h1", "h2"])
                else:
                    segments = pa.Array.from_buffers(pa.large_list(pa.large_string()), 0, [None, pa.py_buffer(np.zeros(1, np.int64))], children=[pa.array([], pa.large_string())])
                    if len(a):
                        size = n + window - 1
                        offsets = np.append(0, np.cumsum(size))
                        at = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
                        segments = pa.LargeListArray.from_arrays(pa.array(offsets), words.dictionary.take(words.indices.take(pa.array(at))))
                    text = pc.binary_join(segments, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(place), text], ["prefix", "key", "first", "segment"])

    return run


def depths(codes: np.ndarray) -> np.ndarray:
    """Depth of the deepest inner node above each place's leaf in the tree of all suffixes: the longest string from there that also starts elsewhere.

    Ranks of strings of 1, 2, 4, ... words order the suffixes; a leaf's deepest inner node is the longer of
    the two prefixes it shares with its neighbours in that order.
    """
    n = len(codes)
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.uint64)]
    while n and int(levels[-1].max()) < n - 1:
        step = 1 << (len(levels) - 1)
        pair = levels[-1] * np.uint64(n + 1)
        pair[: max(0, n - step)] += levels[-1][step:] + np.uint64(1)
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
    order = np.argsort(levels[-1])
    left, right, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in reversed(range(len(levels))):
        inside = np.maximum(left, right) < n
        same = inside.copy()
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        step = same.astype(np.int64) << k
        left, right, shared = left + step, right + step, shared + step
    depth = np.zeros(n, np.int64)
    depth[order[1:]] = shared
    depth[order[:-1]] = np.maximum(depth[order[:-1]], shared)
    return depth


def _tree(keys: list, first: np.ndarray, segments: pa.Array, window: int) -> pa.RecordBatch:
    """Maximal repeats of a subtree: inner nodes at the window's depth or deeper, without those that a longer repeat holds; overlapping ones merge."""
    words, count = split(segments)
    starts = np.cumsum(count + 1) - count - 1
    codes = np.empty(int(count.sum()) + len(count), np.int64)
    is_end = np.zeros(len(codes), bool)
    is_end[starts + count] = True
    codes[~is_end] = words.indices.to_numpy()
    codes[is_end] = len(words.dictionary) + np.arange(len(count))  # no string goes past a segment
    depth = depths(codes)
    deep = depth >= window
    deep[1:] &= depth[:-1] != depth[1:] + 1
    lo = np.flatnonzero(deep)
    hi = np.maximum.accumulate(lo + depth[lo])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    hi = hi[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)] if len(lo) else hi
    lo = lo[new]
    seg = np.searchsorted(starts, lo, "right") - 1
    by = first[seg] - starts[seg]
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in seg.tolist()], pa.binary()), pa.array(lo + by), pa.array(hi + by)], ["key", "lo", "hi"])


def _trees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by prefix; whole groups gather to some megabytes before their trees are built at once."""
        held: list[pa.RecordBatch] = []
        size = 0

        def build(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            prefix = rows.column("prefix").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(prefix)) + 1, len(prefix))
            words = np.cumsum(pc.binary_length(rows.column("segment")).to_numpy()) // 6
            lo = 0
            while lo < len(prefix):
                fit = cuts[(cuts > lo) & (words[cuts - 1] - (words[lo - 1] if lo else 0) <= TREE_WORDS)]
                hi = int(fit[-1]) if len(fit) else int(cuts[cuts > lo][0])
                part = rows.slice(lo, hi - lo)
                yield _tree(part.column("key").to_pylist(), part.column("first").to_numpy(), part.column("segment").combine_chunks(), window)
                lo = hi

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < 16 << 20:
                continue
            rows = pa.Table.from_batches(held)
            prefix = rows.column("prefix").to_numpy()
            other = np.flatnonzero(prefix != prefix[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from build(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from build(pa.Table.from_batches(held))

    return run


def _counted(rows: DataFrame, window: int) -> DataFrame:
    """Ranges in runs of long prefixes. Equal texts count as one row with their number; runs that occur twice repeat as a whole; only the windows of distinct runs are counted one by one, those of a repeated run twice."""
    own = checkpointed(rows.groupBy("run", "key", "first").agg(F.count("*").alias("c"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    runs = checkpointed(own.groupBy("run").agg(F.sum("c").alias("c"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min(F.struct("key", "first")).alias("at")))
    whole = own.join(runs.where("c > 1").select("run"), "run", "left_semi").select("key", F.col("first").alias("lo"), (F.col("first") + F.size("h1") + window - 1).alias("hi"))
    nodes = runs.select("at", F.least("c", F.lit(2)).alias("c"), F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select("at", "c", "i", "h.h1", "h.h2")
    twice = nodes.groupBy("h1", "h2").agg(F.sum("c").alias("n")).where("n > 1")
    single = nodes.where("c = 1").join(twice, ["h1", "h2"], "left_semi").select("at.key", (F.col("at.first") + F.col("i")).alias("lo"), (F.col("at.first") + F.col("i") + window).alias("hi"))
    return whole.union(single)


def ranges(docs: DataFrame, text: str = "text", window: int = WINDOW, group_runs: int = GROUP_RUNS, bits: int = BITS) -> DataFrame:
    """key (of the text), lo, hi: words [lo, hi) that repeated windows cover; ranges of a text may touch or overlap."""
    t = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    counts = t.mapInArrow(_prefixes(window), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1")
    counts = checkpointed(counts)
    hot = set_bits(counts.where(F.col("n") > group_runs), bits)
    shared = docs.sparkSession.sparkContext.broadcast((set_bits(counts, bits), hot))
    keyed = t.select(text_key(F.col("t")).alias("key"), "t")
    cold = keyed.mapInArrow(_candidates(window, bits, shared, False), "prefix long, key binary, first long, segment string")
    found = cold.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(window), "key binary, lo long, hi long")
    if hot.any():
        found = found.union(_counted(keyed.mapInArrow(_candidates(window, bits, shared, True), "run binary, key binary, first long, h1 array<long>, h2 array<long>"), window))
    return found


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            n_words, n_removed, kept = [], [], []
            for t, los, his in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = (t or "").encode().split()
                n_words.append(len(words))
                if los:
                    keep = np.zeros(len(words) + 1, np.int64)
                    np.add.at(keep, los, 1)
                    np.add.at(keep, his, -1)
                    words = [w for w, x in zip(words, np.cumsum(keep).tolist(), strict=False) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_removed), pa.array(kept)], ["row", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _keep(iter([whole])):
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["row", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, text: str, keep: list[str], window: int, **more) -> DataFrame:
    got = ranges(docs, text, window, **more).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    left = docs.select(row, t.alias("t"), text_key(t).alias("key"))
    return left.join(got, "key", "left").select("row", "t", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """docs' columns, the text with repeated words gone where there are any (kept words joined by one space)."""
    df = _joined(docs, text, docs.columns, window, **more)
    out = df.mapInArrow(_keep, f"row {df.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.`{text}`"))
    return out.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame, window: int = WINDOW, **more) -> DataFrame:
    df = _joined(docs, "text", ["doc_id"], window, **more)
    out = df.mapInArrow(_digest, f"row {df.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def query(spark, sf_dir):
    return digest(load(spark, sf_dir, "documents"))
