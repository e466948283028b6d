"""Coverage files: hits by function and by line.

Lines SF, FNDA, DA and end_of_record; numbers that can't be read are skipped; a missing last
end_of_record is tolerated; of two records for one source file the later one counts. The record of a
line is a running count of SF lines, so parsing is a window per coverage file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.lines import lines


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, content. Returns (file, fn, hits) and (file, line, hits)."""
    x = lines(files).withColumn("t", F.trim("text"))
    w = Window.partitionBy("path").orderBy("line")
    x = x.withColumn("rec", F.sum(F.col("t").startswith("SF:").cast("int")).over(w)).withColumn("ended", F.sum((F.col("t") == "end_of_record").cast("int")).over(Window.partitionBy("path", "rec").orderBy("line")))
    x = x.withColumn("file", F.max(F.when(F.col("t").startswith("SF:"), F.expr("substring(t, 4)"))).over(Window.partitionBy("path", "rec"))).where("file is not null and ended = 0")
    last = x.groupBy("path", "file").agg(F.max("rec").alias("rec"))
    x = x.join(last, ["path", "file", "rec"])
    fn = x.select("file", F.regexp_extract("t", r"^FNDA:([0-9]+),(.*)$", 2).alias("fn"), F.expr("try_cast(regexp_extract(t, '^FNDA:([0-9]+),(.*)$', 1) as bigint)").alias("hits"), "line").where("hits is not null")
    at = x.select("file", F.expr("try_cast(regexp_extract(t, '^DA:([0-9]+),([0-9]+)', 1) as bigint)").alias("at"), F.expr("try_cast(regexp_extract(t, '^DA:([0-9]+),([0-9]+)', 2) as bigint)").alias("hits"), "line").where("at is not null and hits is not null")
    return fn.groupBy("file", "fn").agg(F.max_by("hits", "line").alias("hits")), at.groupBy("file", F.col("at").alias("line")).agg(F.max_by("hits", at["line"]).alias("hits"))
