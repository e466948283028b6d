"""Test quality: tests that assert nothing or reach no production code, code that tests don't reach or cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import graph, sets
from factweave.plans import duplicates
from factweave.plans.config import Config
from factweave.plans.findings import finding, union
from factweave.plans.functions import ignored, scopes


def call_graph(functions: DataFrame) -> DataFrame:
    """Names (src, dst): what a function of a name calls or refers to."""
    return functions.where("has_body").select(F.col("name").alias("src"), F.explode("body.refs").alias("dst")).distinct()


def silent(functions: DataFrame, config: Config = Config()) -> DataFrame:
    """TQ-001: tests without an assertion, a call, or the panic they expect."""
    t = functions.where("test_attr and owner = '' and has_body")
    says = F.col("body.asserts") | F.arrays_overlap("body.macros", F.array(*map(F.lit, config.test_quality.extra_assertion_macros)).cast("array<string>"))
    return finding(t.where(~says & ~(F.col("should_panic") & F.array_contains("body.macros", "panic")) & ~F.col("body.any_call")), "test_quality", "TQ-001", F.concat("name", F.lit(" asserts nothing")))


def aimless(functions: DataFrame, types: DataFrame) -> DataFrame:
    """TQ-002: tests that call no production function, no method or type of the project, and nothing that reaches one."""
    s = scopes(functions, types)
    declared = functions.where("has_body or owner <> 'trait'").where("not is_test").select(F.col("name").alias("node")).distinct()
    g = call_graph(functions).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = graph.closure(g, declared).union(s["functions"].select("name")).union(s["methods"].select("name")).distinct()
    t = functions.where("test_attr and owner = '' and has_body")
    hit = t.select("id", F.explode("body.called").alias("name")).join(known.select(F.col("node").alias("name")), "name", "left_semi").select("id")
    typed = t.select("id", F.explode("body.type_refs").alias("name")).join(s["types"], "name", "left_semi").select("id")
    return finding(t.join(hit.union(typed).distinct(), "id", "left_anti"), "test_quality", "TQ-002", F.concat("name", F.lit(" reaches no production code")))


def untested(functions: DataFrame, imports: DataFrame, config: Config = Config()) -> DataFrame:
    """TQ-003: functions that production calls and no test reaches. functions: with_markers."""
    prod, test = duplicates.called(functions, imports)
    free = functions.where(ignored(config, F.col("name"))).select("name")
    reached = graph.closure(call_graph(functions), test.union(free).select(F.col("name").alias("node")))
    dead = duplicates.uncalled(functions, imports, config).select("name").distinct()
    skip = F.col("is_test") | (F.col("name") == "main") & (F.col("owner") == "") | F.col("allow_dead") | F.col("is_api") | F.col("is_helper") | F.col("is_trait_impl") | (F.col("owner") == "trait") | ignored(config, F.col("name"))
    f = functions.where(~skip).join(dead, "name", "left_anti").join(prod, "name", "left_semi")
    return finding(sets.outside(f, reached, ["name"], "node"), "test_quality", "TQ-003", F.concat("name", F.lit(" is reached by no test")))


def uncovered(classified: DataFrame, function_hits: DataFrame, line_hits: DataFrame) -> DataFrame:
    """TQ-004 and TQ-005: functions that never ran, logic on lines that never ran (one finding a function)."""
    f = classified.where("not is_test")
    idle = sets.uncovered(f.where("not startswith(name, 'test_')"), function_hits, ["file", "name"])
    logic = f.select("id", "file", "name", F.col("line").alias("at"), F.explode("body.logic").alias("x")).select("id", "file", "name", "at", "x.*")
    places = sets.uncovered(logic, line_hits, ["file", "line"]).groupBy("id", "file", "name", F.col("at").alias("line_")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "kind", "line"))), ", ").alias("which"))
    return union([
        finding(idle, "test_quality", "TQ-004", F.concat("name", F.lit(" never ran"))),
        finding(places, "test_quality", "TQ-005", F.concat(F.lit("logic of "), "name", F.lit(" never ran: "), "which"), line="line_"),
    ])
