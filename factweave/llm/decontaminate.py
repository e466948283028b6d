"""Benchmark decontamination: windows of benchmark words as a broadcast hash set, scanned by the windows of every document.

Each text becomes words (ASCII letters lower-cased; everything in ASCII but digits and letters
separates). Window hashes come from chained hashes of 1, 2, 4 and 8 words, so a window costs a few
64-bit hashes and no string. One pass gives a row per place with a hash for each width, and it meets the hash set
in a broadcast join inside the same stage; the join condition compares the words themselves, so a hash collision
can't make a hit. Only hits leave the stage. They are gathered under a 128-bit key of the text, with partial
aggregation: a passage that a third of all documents share costs one group per distinct text.

The benchmark side is broadcast only while it holds at most `broadcast_windows` windows and
`broadcast_bytes` bytes (both counted first). Beyond that, places and hashes alone meet it in a shuffled
join, which adaptive execution splits where a hash is hot; what matches goes back to its document, which
compares the words.

Defined results: null texts have no words; an item with no words has no window; an item with a null
id marks words but is not counted among the items. Documents with the same text get the same
result, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed
from factweave.llm.common import kept_column, load, lower_ascii, text_key, uncovered, with_running, words_of

WINDOW = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS, BROADCAST_BYTES = 2_000_000, 128 << 20


def bench_words(text: Column) -> Column:
    return words_of(lower_ascii(text), SEPARATORS)


def with_window_hashes(df: DataFrame, words: str, width: int, out: str) -> DataFrame:
    """df with the hash of every window of so many words, by doubling: h(2k) from h(k) here and k words later. Each level is a column of its own, so it is computed once."""
    df, done = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w))), 1
    while done < width:
        step = min(done, width - done)
        h = F.col(f"_h{done}")
        n = F.greatest(F.size(h) - step, F.lit(0))
        zipped = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"_h{done + step}", zipped).drop(f"_h{done}")
        done += step
    return df.withColumnRenamed(f"_h{done}", out)


def bench_windows(bench: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """width, words and the sorted ids of the items that hold the window; one row per distinct window."""
    b = bench.select(F.col(f"`{item_id}`").cast("string").alias("item"), bench_words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    b = b.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, F.lit(window)).alias("words"))
    b = b.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return b.withColumn("width", F.size("words"))


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key (of the text), places (sorted array of start and width of each hit), items (sorted ids): one row per distinct text with a hit."""
    wins = checkpointed(bench_windows(bench, window, text="text"))
    held = F.length(F.concat_ws("", "words")) * 2 + F.length(F.concat_ws("", "items")) + 32 * (F.size("words") + F.size("items") + 2)
    sizes = wins.groupBy("width").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()  # at most `window` rows
    small = sum(r["n"] for r in sizes) <= broadcast_windows and sum(r["bytes"] for r in sizes) <= broadcast_bytes
    widths = sorted(r["width"] for r in sizes) or [window]
    side = None
    for width in widths:
        one = with_window_hashes(wins.where(F.col("width") == width), "words", width, "hs").select(F.element_at("hs", 1).alias("h"), "width", "words", "items")
        side = one if side is None else side.unionByName(one)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(text_key(t).alias("key"), bench_words(t).alias("w"))
    each = base
    for width in widths:
        each = with_window_hashes(each, "w", width, f"h{width}")
    each = each.select("key", "w", F.posexplode_outer(F.arrays_zip(*(f"h{width}" for width in widths))).alias("p", "x"))
    each = each.select("key", "w", "p", F.explode(F.array(*(F.struct(F.lit(width).alias("k"), F.col(f"x.h{width}").alias("h")) for width in widths))).alias("x")).select("key", "w", "p", "x.k", "x.h").where("h is not null")
    place = F.struct(F.col("p").alias("start"), F.col("k").alias("width"))
    if small:
        here = F.slice(each["w"], each["p"] + 1, each["k"])
        same = F.least(here, side["words"]) == F.greatest(here, side["words"])  # equality, in a form that stays a condition beside the key h
        found = each.join(F.broadcast(side), (each["h"] == side["h"]) & (each["k"] == side["width"]) & same).select("key", place.alias("place"), "items")
    else:
        may = each.select("key", "p", "k", "h").join(side.withColumnRenamed("width", "k"), ["h", "k"]).groupBy("key").agg(F.collect_set(F.struct("p", "k", "words", "items")).alias("may"))
        sure = F.filter("may", lambda x: F.slice("w", x["p"] + 1, x["k"]) == x["words"])
        found = base.join(may, "key").select("key", F.explode(sure).alias("x")).select("key", F.struct(F.col("x.p").alias("start"), F.col("x.k").alias("width")).alias("place"), "x.items")
    return found.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"), F.collect_set("items").alias("items")).withColumn("items", F.sort_array(F.array_distinct(F.flatten("items"))))


def covered(places: Column) -> Column:
    """Words inside any hit: each hit adds what lies beyond the furthest end so far."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["start"] + x["width"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + F.greatest(end - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(places, start, step, lambda s: s["n"])


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = 2, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """row (struct of docs' columns, or of those to keep), n_words, n_hit, places, items, contaminated (hits of min_items items or more)."""
    found = hits(docs, bench, window, text, broadcast_windows, broadcast_bytes)
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), text_key(F.col(f"`{text}`")).alias("key"), F.size(bench_words(F.col(f"`{text}`"))).cast("long").alias("n_words"))
    return left.join(found, "key", "left").select(
        "row", "n_words", F.coalesce(covered(F.col("places")), F.lit(0)).cast("long").alias("n_hit"), "places", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce(F.size("items"), F.lit(0)) >= min_items).alias("contaminated"),
    )


def with_cut(df: DataFrame, text: str, places: str, out: str) -> DataFrame:
    """df with the text without the words that hits cover, each with the separators after it. Words between hits are taken as slices, so time is linear."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    hit = F.size(F.coalesce(F.col(places), F.array().cast("array<struct<start:int,width:int>>"))) > 0
    df = df.withColumn("_s", F.when(hit, F.transform(places, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["width"]).alias("end")))))
    df = df.withColumn("_e", F.transform("_s", lambda x: x["end"]))
    df = with_running(df, "_e", "_r", most=True).withColumn("_u", uncovered("_s", "_r"))
    df = df.withColumn("_p", F.when(hit, F.regexp_extract_all(text, F.lit(f"[^{gap[1:-1]}]+{gap}*"), F.lit(0))))
    between = F.transform("_u", lambda x: F.array_join(F.slice("_p", x["from"] + 1, x["span"]["start"] - x["from"]), ""))
    tail = F.array_join(F.slice("_p", F.array_max("_e") + 1, F.greatest(F.size("_p"), F.lit(1))), "")
    cut = F.concat(F.regexp_extract(text, f"^{gap}+", 0), F.array_join(kept_column("_p", between), ""), tail)
    return df.withColumn(out, F.when(hit, cut).otherwise(F.col(text))).drop("_s", "_e", "_r", "_u", "_p")


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = 2, text: str = "text") -> DataFrame:
    """docs without contaminated documents; in the others, words inside a hit are cut. Same columns."""
    s = scan(docs, bench, window, min_items, text).where(~F.col("contaminated"))
    s = with_cut(s.withColumn("_t", F.col(f"row.`{text}`")), "_t", "places", "_c")
    return s.select(*((F.col("_c") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    s = scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return s.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
