"""Rules over code facts: coupling, wildcards, sizes. Each gives findings in the shared shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import graph
from factweave.plans.findings import finding, union

#: Default limits.
MAX_INSTABILITY, MAX_FAN_IN, MAX_FAN_OUT, MAX_PARAMETERS, MAX_LINES = 0.8, 15, 12, 5, 60


def module_of(path: Column) -> Column:
    """Top-level module of a file: its first folder under src, or its own stem."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^src/", "")
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.regexp_replace(p, r"\.rs$", ""))


def module_graph(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules (node) and edges (src, dst) by top-level imports from the own crate."""
    nodes = files.select(module_of(F.col("path")).alias("node")).distinct()
    own = imports.where((F.size("module") == 0) & (F.get("segments", F.lit(0)) == "crate") & (F.size("segments") >= 2))
    e = own.select(module_of(F.col("file")).alias("src"), F.get("segments", F.lit(1)).alias("dst")).where("src <> dst").distinct()
    return nodes, e.join(nodes, e["dst"] == nodes["node"], "left_semi")


def coupling(files: DataFrame, imports: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Fan limits, instability, cycles and edges to less stable modules. suppressed (node): modules with a coupling marker, which the limits and edges skip and cycles don't."""
    nodes, edges = module_graph(files, imports)
    d = graph.degrees(nodes, edges)
    open_ = d if suppressed is None else d.join(suppressed, "node", "left_anti")
    over = open_.where(((F.col("fan_in") > 0) & (F.col("instability") > MAX_INSTABILITY)) | (F.col("fan_in") > MAX_FAN_IN) | (F.col("fan_out") > MAX_FAN_OUT))
    limits = finding(over, "coupling", "CP-000", F.format_string("module %s: in %d, out %d, instability %.2f", "node", "fan_in", "fan_out", "instability"), file=F.lit(""), line=0)
    members = graph.scc(edges).groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("m"))
    cycles = finding(members, "coupling", "CP-001", F.concat(F.lit("cycle of modules "), F.array_join("m", ", ")), "high", file=F.lit(""), line=0)
    steps = graph.gradient(edges, d)
    if suppressed is not None:
        steps = steps.join(suppressed.withColumnRenamed("node", "src"), "src", "left_anti").join(suppressed.withColumnRenamed("node", "dst"), "dst", "left_anti")
    sdp = finding(steps, "coupling", "CP-002", F.format_string("%s (%.2f) depends on less stable %s (%.2f)", "src", "src_metric", "dst", "dst_metric"), file=F.lit(""), line=0)
    return union([limits, cycles, sdp])


def wildcards(imports: DataFrame) -> DataFrame:
    """Private glob imports, but for super in test modules, files in tests folders, and preludes."""
    g = imports.where((F.col("kind") == "glob") & (F.col("public") == ""))
    g = g.where(~(F.col("in_test") & (F.array_join("segments", "::") == "super")))
    g = g.where(~F.regexp_replace("file", r"\\", "/").rlike("(^|/)tests/") & ~F.array_contains("segments", "prelude"))
    at = F.concat_ws("::", F.concat("segments", F.array(F.lit("*"))))
    return finding(g.withColumn("_m", at), "dry", "DRY-004", F.concat(F.lit("wildcard import "), F.col("_m")), "low", line="use_line")


def signatures(functions: DataFrame, most: int = MAX_PARAMETERS) -> DataFrame:
    """Too many parameters; trait impls are exempt."""
    wide = functions.where((F.col("parameter_count") > most) & ~F.col("is_trait_impl"))
    return finding(wide, "srp", "SRP-003", F.format_string("%s has %d parameters", "name", "parameter_count"))


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """Fact tables of sources (path, content) by kind; functions have an id in file order and know whether they are tests."""
    from factweave.frontend.items import SCHEMAS, facts, of_kind
    from factweave.functions.session import checkpointed, ship
    from factweave.plans.functions import test_files, with_tests

    ship(files.sparkSession)
    f = checkpointed(facts(files))
    out = {k: of_kind(f, k) for k in SCHEMAS}
    out["tests"] = test_files(files, out["module"])
    key = F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 9, "0"), "name")
    out["function"] = checkpointed(with_tests(out["function"].withColumn("id", key), out["tests"]))
    return out


def analyse(files: DataFrame, config=None, coverage: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All findings for a table of sources (path, content), with markers applied. coverage: hits by function and by line."""
    from factweave.plans import boilerplate, duplicates, functions, responsibility, structure, testing
    from factweave.plans.config import Config
    from factweave.plans.findings import suppress
    from factweave.sources.markers import plain_markers, suppressions

    config = config or Config()
    t = tables(files)
    imports, f = t["import"], duplicates.with_markers(t["function"], plain_markers(files, "api"), plain_markers(files, "test_helper"))
    marks = suppressions(files)
    covered = marks.where((F.size("dims") == 0) | F.array_contains("dims", "coupling")).select(module_of(F.col("file")).alias("node")).distinct()
    classified = functions.classify(f, t["type"], config, plain_markers(files, "recursive"))
    found = [functions.violations(classified), functions.complexity(classified, config, plain_markers(files, "unsafe"))]
    if config.coupling.enabled:
        found.append(coupling(files, imports, covered))
    if config.duplicates.enabled:
        found += [duplicates.duplicates(f, config), duplicates.fragments(f, config)]
        found += [wildcards(imports)] if config.duplicates.detect_wildcard_imports else []
        found += [duplicates.dead_code(f, imports, config)] if config.duplicates.detect_dead_code else []
        found += [boilerplate.repeated_matches(f, config)] if config.duplicates.detect_repeated_matches else []
    if config.boilerplate.enabled:
        found.append(boilerplate.boilerplate(f, config))
    if config.srp.enabled:
        found += [responsibility.structs(f, t["type"], config), responsibility.modules(t["source"], f, classified, t["tests"], config), signatures(f, config.srp.max_parameters)]
    if config.structural.enabled:
        found.append(structure.checks(f, t["type"], t["impl"], config))
    if config.test_quality.enabled:
        found += [testing.silent(f, config), testing.aimless(f, t["type"]), testing.untested(f, imports, config)]
        found += [testing.uncovered(classified, *coverage)] if coverage else []
    return suppress(union(found), marks)
