"""Line kernels: scans, markers, run ends, band semi-joins and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, suffix: str = ".rs", exclude: tuple[str, ...] = ()) -> DataFrame:
    """K1: (path, content) of files under root by suffix; paths through `target` or a folder whose name starts with a dot, and excluded globs, are left out."""
    from factweave.functions.text import glob_regex

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    base = root.rstrip("/").removeprefix("file://") + "/"
    df = files.select(full.alias("full"), F.col("value").alias("content")).withColumn("path", F.expr("substring(full, {})".format(len(base) + 1)))
    df = df.where(~F.col("path").rlike(r"(^|/)(target|\.[^/]+)/"))
    for g in exclude:
        df = df.where(~F.col("path").rlike(glob_regex(g)))
    return df.select("path", "content")


def lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """K2: key, line (from 1) and text of every line; a null content has none."""
    return files.select(key, F.posexplode(F.split(F.col(content), "\n")).alias("p", "text")).select(key, (F.col("p") + 1).cast("long").alias("line"), "text")


def markers(df: DataFrame, pattern: str, payload: int = 1, text: str = "text") -> DataFrame:
    """K2: rows whose trimmed text matches, with a captured group as payload."""
    t = F.trim(F.col(text))
    return df.where(t.rlike(pattern)).withColumn("payload", F.regexp_extract(t, pattern, payload))


def run_ends(df: DataFrame, matches: Column, key: str = "path", line: str = "line") -> DataFrame:
    """K3: rows that match, each with the last line of its maximal run of consecutive matching lines."""
    w = Window.partitionBy(key).orderBy(line)
    kept = df.where(matches).withColumn("_island", F.col(line) - F.row_number().over(w))
    return kept.withColumn("run_end", F.max(line).over(Window.partitionBy(key, "_island"))).drop("_island")


def _spread(markers: DataFrame, by: list[str], at: str, n: int) -> DataFrame:
    """Each marker at every place it reaches, so that a band becomes an equality and no range join is planned."""
    return markers.select(*by, F.explode(F.sequence(F.col(at), F.col(at) + n)).alias(at)).distinct()


def band_mark(targets: DataFrame, markers: DataFrame, n: int, by: list[str], at: str = "line") -> DataFrame:
    """K4: targets with a marker at most n rows above (or on their own row)."""
    return targets.join(_spread(markers, by, at, n), [*by, at], "left_semi")


def band_unmarked(targets: DataFrame, markers: DataFrame, n: int, by: list[str], at: str = "line") -> DataFrame:
    return targets.join(_spread(markers, by, at, n), [*by, at], "left_anti")


def orphans(markers: DataFrame, positions: DataFrame, n: int, by: list[str], at: str = "line", whole_file: DataFrame | None = None) -> DataFrame:
    """Markers that reach no position: none within n rows below, and, where whole_file lists keys that match anywhere, not one of those."""
    back = positions.select(*by, F.explode(F.sequence(F.col(at) - n, F.col(at))).alias(at)).distinct()
    left = markers.join(back, [*by, at], "left_anti")
    return left if whole_file is None else left.join(whole_file.select(*by).distinct(), by, "left_anti")
