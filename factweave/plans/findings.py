"""Findings: one shape for all rules, suppression, orphan markers, counters, score and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import scoring

#: Columns of every finding. Project-wide ones have file '' and line 0.
COLUMNS = ("file", "line", "column", "dimension", "rule_id", "message", "severity", "suppressed")
#: How far below a marker a finding may be, by dimension; None: anywhere in the file.
WINDOWS = {"iosp": 3, "complexity": 3, "dry": 3, "srp": 5, "coupling": 5, "test_quality": 5, "architecture": None}
#: Weights of the overall score, by dimension.
WEIGHTS = {"iosp": 0.22, "complexity": 0.18, "dry": 0.13, "srp": 0.18, "coupling": 0.09, "test_quality": 0.1, "architecture": 0.1}


def finding(df: DataFrame, dimension: str, rule_id: str, message, severity: str = "medium", file="file", line="line", column=None) -> DataFrame:
    """Rows of a rule in the shape of findings; file and line are columns or values."""
    col = lambda x: F.col(x) if isinstance(x, str) and x in df.columns else x if not isinstance(x, (str, int)) else F.lit(x)
    return df.select(
        col(file).cast("string").alias("file"), col(line).cast("long").alias("line"), (F.col(column).cast("long") if column else F.lit(0).cast("long")).alias("column"),
        F.lit(dimension).alias("dimension"), F.lit(rule_id).alias("rule_id"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(False).alias("suppressed"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _reach(markers: DataFrame) -> DataFrame:
    """Each marker by dimension it covers, at each line it reaches; line null for the whole file."""
    dims = F.when(F.size("dims") == 0, F.array(*map(F.lit, WINDOWS))).otherwise(F.col("dims"))
    m = markers.select("file", "line", F.explode(dims).alias("dimension"))
    near = F.coalesce(*(F.when(F.col("dimension") == d, F.lit(n)) for d, n in WINDOWS.items() if n is not None))
    at = F.when(near.isNotNull(), F.sequence(F.col("line"), F.col("line") + near)).otherwise(F.array(F.lit(None).cast("long")))
    return m.select("file", F.col("line").alias("marker"), "dimension", F.explode(at).alias("at"))


def suppress(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """findings with suppressed set where a marker covers the dimension and reaches the line."""
    at = F.when(F.col("dimension").isin([d for d, n in WINDOWS.items() if n is None]), F.lit(None).cast("long")).otherwise(F.col("line"))
    r = _reach(markers).select("file", "dimension", F.coalesce("at", F.lit(-1)).alias("_at")).distinct().withColumn("_hit", F.lit(True))
    f = findings.withColumn("_at", F.coalesce(at, F.lit(-1)))
    return f.join(r, ["file", "dimension", "_at"], "left").withColumn("suppressed", F.col("suppressed") | F.coalesce("_hit", F.lit(False))).select(*COLUMNS)


def orphan_markers(markers: DataFrame, findings: DataFrame) -> DataFrame:
    """Markers that no finding needs, suppressed ones included. A marker for coupling alone is only judged in files with a coupling finding on a line."""
    r = _reach(markers)
    pos = findings.where("file <> ''").select("file", "dimension", "line")
    whole = [d for d, n in WINDOWS.items() if n is None]
    used = r.join(pos.select("file", "dimension", F.when(F.col("dimension").isin(whole), F.lit(-1)).otherwise(F.col("line")).alias("_at")).distinct(), (r["file"] == pos["file"]) & (r["dimension"] == pos["dimension"]) & (F.coalesce(r["at"], F.lit(-1)) == F.col("_at")), "left_semi")
    left = markers.join(used.select("file", F.col("marker").alias("line")).distinct(), ["file", "line"], "left_anti")
    only = F.forall("dims", lambda d: d == "coupling") & (F.size("dims") > 0)
    judged = pos.where("dimension = 'coupling' and line > 0").select("file").distinct()
    return left.where(~only).unionByName(left.where(only).join(judged, "file", "left_semi"))


def counters(findings: DataFrame) -> DataFrame:
    """dimension, rule_id, n of findings that aren't suppressed."""
    return findings.where("not suppressed").groupBy("dimension", "rule_id").agg(F.count("*").alias("n"))


#: Rules whose findings count for a dimension's score; a cycle counts twice there.
TWICE = ("CP-001",)


def counted(findings: DataFrame) -> DataFrame:
    """dimension, rule_id, n as the summary counts: CX-001 and CX-002 of one function are one."""
    f = findings.where("not suppressed")
    pair = F.col("rule_id").isin("CX-001", "CX-002")
    one = f.where(pair).select("dimension", F.lit("CX-001").alias("rule_id"), "file", "line").distinct().drop("file", "line")
    return f.where(~pair).select("dimension", "rule_id").unionByName(one.select("dimension", "rule_id")).groupBy("dimension", "rule_id").agg(F.count("*").alias("n"))


def scores(findings: DataFrame, functions: int, classes: dict[str, int] | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row: a score per dimension, quality_score and total_findings. classes: integration, operation, violation counts for the first dimension."""
    c = classes or {}
    sound = c.get("integration", 0) + c.get("operation", 0)
    every = sound + c.get("violation", 0)
    worth = F.col("n") * F.when(F.col("rule_id").isin(*TWICE), 2).otherwise(1)
    per = counted(findings).agg(*(F.coalesce(F.sum(F.when(F.col("dimension") == d, worth)), F.lit(0)).alias(d) for d in weights), F.coalesce(F.sum(F.when(F.col("dimension").isin(*weights), F.col("n"))), F.lit(0)).alias("total_findings"))
    first = F.lit(sound / every if every else 1.0)
    each = [first if d == "iosp" and classes else scoring.deficit(F.col(d), F.lit(functions)) for d in weights]
    return per.select(*(s.alias(f"{d}_score") for d, s in zip(weights, each, strict=True)), scoring.weighted(each, list(weights.values())).alias("quality_score"), "total_findings")


def suppression_ratio(markers: DataFrame, files: DataFrame, functions: int, limit: float = 0.05) -> DataFrame:
    """One row: all_suppressions (markers, and allow attributes before the first test module) and whether they are too many for so many functions."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    t = F.trim("text")
    stop = lines.where(F.startswith(t, F.lit("#[cfg(test)]"))).groupBy("path").agg(F.min("i").alias("stop"))
    attrs = lines.where(F.startswith(t, F.lit("#[allow("))).join(stop, "path", "left").where("stop is null or i < stop").agg(F.count("*").alias("a"))
    n = attrs.crossJoin(markers.agg(F.count("*").alias("m"))).select((F.col("a") + F.col("m")).alias("all_suppressions"))
    return n.withColumn("suppression_ratio_exceeded", scoring.over_limit(F.col("all_suppressions"), F.lit(functions), limit))


def gate(summary: DataFrame, fail_on_warnings: bool = False, min_quality: float | None = None, no_fail: bool = False) -> str | None:
    """The first exit gate that fails for a summary of one row, or none."""
    gates = []
    if fail_on_warnings:
        gates.append(("warnings", F.col("suppression_ratio_exceeded")))
    if min_quality is not None:
        gates.append(("min_quality", F.col("quality_score") * 100 < min_quality))
    if not no_fail:
        gates.append(("findings", F.col("total_findings") > 0))
    return summary.select(scoring.first_gate(gates).alias("g")).first().g if gates else None
