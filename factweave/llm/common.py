"""Expressions and helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column, separator: str = f"{SPACE}+") -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays, unlike with lower()."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text. Equal texts share a key, so results by key hold for each of them and no row number has to survive a retry."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input doesn't use, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def adjacent_sum(positions: Column, span: int) -> Column:
    """How many places the intervals [p, p + span) cover, for a sorted array of distinct p."""
    nexts = F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0)))
    gaps = F.zip_with(positions, nexts, lambda p, q: F.least(F.coalesce(q - p, F.lit(span)), F.lit(span)))
    return F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))


#: Length of the blocks that running values are summed up by.
BLOCK = 128


def kept_column(name: str, value: Column) -> Column:
    """value, which reads the array column `name` inside a lambda. The second reference keeps the optimiser from merging the two projections, which would compute the column anew for every element; a test for null would be no reference where the column can't be null."""
    return F.when(F.size(name) >= 0, value)


def with_running(df: DataFrame, values: str, out: str, start: int = 0, most: bool = False) -> DataFrame:
    """df with, for an array of integers, the sum (or maximum) of `start` and the values before each place: by blocks, so that work stays near n * BLOCK."""
    one = (lambda s, x: F.greatest(s, x)) if most else (lambda s, x: s + x)
    over = lambda a: F.aggregate(a, F.lit(start), one)
    v = F.col(values)
    starts = F.sequence(F.lit(0), F.greatest((F.coalesce(F.size(v), F.lit(0)) - 1) / BLOCK, F.lit(0)).cast("int"))
    df = df.withColumn("_blocks", kept_column(values, F.transform(starts, lambda b: over(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))))
    df = df.withColumn("_before", kept_column("_blocks", F.transform("_blocks", lambda _, b: over(F.slice("_blocks", F.lit(1), b)))))
    each = F.transform(v, lambda _, i: one(F.get("_before", (i / BLOCK).cast("int")), over(F.slice(v, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))
    return df.withColumn(out, kept_column("_before", each)).drop("_blocks", "_before")


def uncovered(spans: str, reached: str) -> Column:
    """Of sorted spans (start, end, ...) those that begin where no earlier one reaches, as (from, span): from is where the gap before the span begins. reached: running maximum of the ends."""
    each = F.zip_with(spans, reached, lambda s, r: F.struct(r.alias("from"), s.alias("span")))
    return F.filter(each, lambda x: x["span"]["start"] >= x["from"])


def cut(blocks: str, start: Column, end: Column, size: int) -> Column:
    """Characters [start, end) of a text given as blocks of `size` characters: the price is a block and the piece, wherever it stands."""
    a, b = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    head = F.substring(F.get(blocks, a), start - a * size + 1, F.least(end, (a + 1) * size) - start)
    rest = F.concat(F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(blocks, b), F.lit(1), end - b * size), F.lit("")))
    return F.concat(F.coalesce(head, F.lit("")), F.when(b > a, rest).otherwise(F.lit("")))
