"""Suppression markers in source lines, as tables.

Grammar, by trimmed line: `// qual:allow` with optional dimensions in brackets and a reason, the older
`// iosp:allow`, and the plain markers api, test_helper, recursive, allow(unsafe) and inverse(name).
Dimensions that don't exist are left out, and an empty list covers all dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.lines import lines

#: Fixed values of the format: spellings of dimensions.
DIMENSIONS = {"iosp": "iosp", "complexity": "complexity", "dry": "dry", "srp": "srp", "coupling": "coupling", "architecture": "architecture", "test_quality": "test_quality", "tq": "test_quality", "test": "test_quality"}
PLAIN = {"api": "qual:api", "test_helper": "qual:test_helper", "recursive": "qual:recursive", "unsafe": r"qual:allow\(unsafe\)"}


def source_lines(files: DataFrame) -> DataFrame:
    """path, line, text and block_end: the last line of the run of comment lines that holds the line, else the line."""
    x = lines(files)
    comment = F.ltrim("text").startswith("//")
    x = x.withColumn("_c", comment).withColumn("_i", F.col("line") - F.row_number().over(Window.partitionBy("path", "_c").orderBy("line")))
    end = F.max("line").over(Window.partitionBy("path", "_c", "_i"))
    return x.withColumn("block_end", F.when(F.col("_c"), end).otherwise(F.col("line"))).drop("_c", "_i")


def _reason(text: Column) -> Column:
    t = F.trim(text)
    given = F.trim(F.regexp_extract(t, r"^reason:(.*)$", 1))
    unquoted = F.when(given.rlike(r'^".*"$'), F.regexp_extract(given, r'^"(.*)"$', 1)).otherwise(given)
    out = F.when(t.startswith("reason:"), unquoted).otherwise(t)
    return F.when(t != "", out)


def suppressions(files: DataFrame) -> DataFrame:
    """file, line (the end of the comment block), dims (empty: all) and reason."""
    x = source_lines(files).withColumn("t", F.trim("text"))
    x = x.where(~F.col("t").rlike(r"^// qual:(allow\(unsafe\)|test_helper)( |$)"))
    rest = F.trim(F.regexp_extract("t", r"^// qual:allow(.*)$", 1))
    names = F.split(F.regexp_extract(rest, r"^\(([^)]*)", 1), ",")
    spelled = F.create_map(*(F.lit(v) for kv in DIMENSIONS.items() for v in kv))
    dims = F.filter(F.transform(names, lambda n: spelled[F.lower(F.trim(n))]), lambda d: d.isNotNull())
    none = F.array().cast("array<string>")
    new = x.where(F.col("t").startswith("// qual:allow")).select("path", "block_end", F.when(rest.startswith("("), dims).otherwise(none).alias("dims"), _reason(F.when(rest.startswith("("), F.regexp_extract(rest, r"^\([^)]*\)(.*)$", 1)).otherwise(rest)).alias("reason"))
    old = x.where(F.col("t").rlike("^// iosp:allow( |$)")).select("path", "block_end", F.array(F.lit("iosp")).alias("dims"), F.when(F.col("t").startswith("// iosp:allow "), F.regexp_extract("t", "^// iosp:allow (.*)$", 1)).alias("reason"))
    return new.unionByName(old).select(F.col("path").alias("file"), F.col("block_end").alias("line"), "dims", "reason")


def plain_markers(files: DataFrame, kind: str) -> DataFrame:
    """file, line of api and test_helper (moved to the block's end), recursive and unsafe (their own line) markers."""
    x = source_lines(files).where(F.trim("text").rlike(rf"^// {PLAIN[kind]}( |$)"))
    return x.select(F.col("path").alias("file"), (F.col("block_end") if kind in ("api", "test_helper") else F.col("line")).alias("line")).distinct()


def inverse_markers(files: DataFrame) -> DataFrame:
    """file, line and target of inverse markers, on their own line; empty targets are none."""
    x = source_lines(files).withColumn("target", F.trim(F.regexp_extract(F.trim("text"), r"^// qual:inverse\((.*)\)$", 1)))
    return x.where("target <> ''").select(F.col("path").alias("file"), "line", "target")
