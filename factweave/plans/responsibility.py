"""Responsibility: structs of many unrelated methods, files that are long or hold unrelated groups of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import graph, scoring
from factweave.plans.config import Config
from factweave.plans.findings import finding


def cohesion(functions: DataFrame, types: DataFrame, config: Config = Config()) -> DataFrame:
    """struct_id, file, line, name, lcom4, fields, methods, fan_out and score of structs with named fields and two methods or more.

    Methods meet structs by bare type name. A constructor touches all fields; a call of an own method touches that one's
    fields, one step far. Methods that share a field are one component.
    """
    c = config.srp
    s = types.where("kind = 'struct' and size(fields) > 0").select(F.xxhash64("file", "line", "name").alias("struct_id"), "file", "line", "name", F.col("fields").alias("own"))
    m = functions.where("owner = 'impl' and not is_trait_impl and has_body and (has_self or gives_self)")
    m = m.select("id", F.col("parent_type").alias("name"), F.col("name").alias("method"), "has_self", "body.fields", "body.self_calls", "body.fan")
    x = s.join(m, "name")
    size = x.groupBy("struct_id", "file", "line", "name").agg(F.count("*").alias("methods"), F.first(F.size("own")).alias("n_fields")).where("methods >= 2")
    fan = x.select("struct_id", F.explode("fan").alias("t")).distinct().groupBy("struct_id").agg(F.count("*").alias("fan_out"))
    # of methods of one name the last in file order answers, as a later entry replaces an earlier one
    direct = m.groupBy("name", "method").agg(F.max_by("fields", "id").alias("reached"))
    called = x.select("struct_id", "id", "own", "name", F.explode("self_calls").alias("method")).join(direct, ["name", "method"]).select("struct_id", "id", "own", F.explode("reached").alias("field"))
    touched = x.select("struct_id", "id", "own", F.explode(F.when(F.col("has_self"), F.col("fields")).otherwise(F.col("own"))).alias("field")).unionByName(called)
    links = touched.where(F.array_contains("own", F.col("field"))).select(F.concat_ws("|", F.lit("m"), "struct_id", "id").alias("a"), F.concat_ws("|", F.lit("f"), "struct_id", "field").alias("b"))
    comp = graph.components(links)
    every = x.select("struct_id", F.concat_ws("|", F.lit("m"), "struct_id", "id").alias("node")).join(comp, "node", "left").groupBy("struct_id").agg(F.count_distinct(F.coalesce("component", "node")).alias("lcom4"))
    y = size.join(every, "struct_id").join(fan, "struct_id", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))
    spread = max(c.lcom4_threshold, 1) - 1
    excess = F.col("lcom4") - 1
    apart = F.when(excess <= 0, F.lit(0.0)).otherwise(F.least(excess / spread, F.lit(1.0)) if spread else F.lit(1.0))
    w = c.weights
    score = F.lit(w[0]) * apart + scoring.composite([(w[1], F.col("n_fields"), c.max_fields), (w[2], F.col("methods"), c.max_methods), (w[3], F.col("fan_out"), c.max_fan_out)])
    return y.select("struct_id", "file", "line", "name", "lcom4", F.col("n_fields").alias("fields"), "methods", "fan_out", score.alias("score"))


def structs(functions: DataFrame, types: DataFrame, config: Config = Config()) -> DataFrame:
    """SRP-001."""
    bad = cohesion(functions, types, config).where(F.col("score") >= config.srp.smell_threshold)
    return finding(bad, "srp", "SRP-001", F.format_string("%s has %d unrelated groups of %d methods over %d fields (%.2f)", "name", "lcom4", "methods", "fields", "score"))


def clusters(functions: DataFrame, classified: DataFrame, config: Config = Config()) -> DataFrame:
    """file, clusters: groups of private free functions of some size, joined where one function calls several or is one of them."""
    own = functions.where((F.col("owner") == "") & (F.size("module") == 0) & (F.col("public") == "") & F.col("has_body") & (F.col("body.statements") >= config.srp.min_cluster_statements))
    own = own.select("file", F.col("name").alias("label")).distinct().withColumn("node", F.concat_ws("|", F.lit("f"), "file", "label"))
    calls = classified.select("file", F.concat_ws("|", F.lit("c"), "id").alias("a"), "name", F.explode("own_calls").alias("label"))
    links = calls.join(own, ["file", "label"]).select("file", "a", F.col("node").alias("b"), "name")
    me = links.select("file", "a", F.col("name").alias("label")).distinct().join(own, ["file", "label"]).select("a", F.col("node").alias("b"))
    comp = graph.components(links.select("a", "b").union(me))
    return own.join(comp, "node", "left").groupBy("file").agg(F.count_distinct(F.coalesce("component", "node")).alias("clusters"))


def modules(sources: DataFrame, functions: DataFrame, classified: DataFrame, tests: DataFrame, config: Config = Config()) -> DataFrame:
    """SRP-002: files of many production lines or of unrelated groups of functions; test files don't count."""
    c = config.srp
    f = sources.join(tests.select("file").distinct(), "file", "left_anti").join(clusters(functions, classified, config), "file", "left")
    f = f.withColumn("clusters", F.coalesce("clusters", F.lit(0))).withColumn("score", scoring.ramp(F.col("production_lines").cast("double"), c.file_length_baseline, c.file_length_ceiling))
    bad = f.where((F.col("score") > 0) | (F.col("clusters") > c.max_independent_clusters))
    return finding(bad, "srp", "SRP-002", F.format_string("%s: %d lines (%.2f), %d groups of functions", "file", "production_lines", "score", "clusters"), line=1)
