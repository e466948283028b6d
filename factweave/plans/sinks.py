"""Report formats over findings. Rows are rendered by built-in expressions; only documents that are one object by nature come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "column", "rule_id", "message")


def text_lines(findings: DataFrame) -> DataFrame:
    """file:line rule message, one line a finding."""
    return findings.select(F.format_string("%s:%d [%s] %s", "file", "line", "rule_id", "message").alias("value"))


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotations; project-wide findings have no place."""
    level = F.coalesce(*(F.when(F.lower("severity") == s, F.lit({"note": "notice"}.get(v, v))) for s, v in LEVELS.items()), F.lit("warning"))
    at = F.when(F.col("file") != "", F.format_string(" file=%s,line=%d", "file", "line")).otherwise(F.lit(""))
    return findings.where("not suppressed").select(F.concat(F.lit("::"), level, at, F.lit("::"), F.regexp_replace("message", r"[\r\n]+", " ")).alias("value"))


def sarif(findings: DataFrame, tool: str = "factweave") -> str:
    """A SARIF document. Findings of a report, not of a corpus, are what it holds, so it is made on the driver."""
    rows = [r.asDict() for r in ordered(findings.where("not suppressed")).toLocalIterator()]
    results = [
        {"ruleId": r["rule_id"], "level": LEVELS.get(r["severity"].lower(), "warning"), "message": {"text": r["message"]}}
        | ({"locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": max(1, r["line"])}}}]} if r["file"] else {})
        for r in rows
    ]
    rules = [{"id": i} for i in sorted({r["rule_id"] for r in rows})]
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=2)


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a graph file. nodes: name, label, color; edges: src, dst."""
    esc = lambda c: F.regexp_replace(F.col(c), r'(["\\])', r"\\$1")
    n = nodes.select(F.lit(1).alias("k"), F.concat(F.lit('  "'), esc("name"), F.lit('" [label="'), esc("label"), F.lit('", color="'), F.col("color"), F.lit('"];')).alias("value"))
    e = edges.select(F.lit(2).alias("k"), F.concat(F.lit('  "'), esc("src"), F.lit('" -> "'), esc("dst"), F.lit('";')).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph facts {"), (3, "}")], "k int, value string")
    return ends.union(n).union(e).orderBy("k", "value").select("value")


def grouped(findings: DataFrame) -> DataFrame:
    """By file, for assistants: file ('<project>' without one) and its findings in order."""
    row = F.struct("line", "rule_id", "dimension", "message")
    return findings.where("not suppressed").groupBy(F.when(F.col("file") == "", F.lit("<project>")).otherwise(F.col("file")).alias("file")).agg(F.sort_array(F.collect_list(row)).alias("findings"), F.count("*").alias("n"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def save_baseline(summary: DataFrame, path: str) -> None:
    """A snapshot of one row, with the format's version."""
    summary.withColumn("version", F.lit(2)).coalesce(1).write.mode("overwrite").json(path)


def regressed(base: DataFrame, current: DataFrame) -> bool:
    """Whether the score fell: the overall one where the snapshot has it, else the first dimension's."""
    old, new = base.first().asDict(), current.first().asDict()
    key = "quality_score" if old.get("quality_score") is not None else "iosp_score"
    return new[key] < old[key]
