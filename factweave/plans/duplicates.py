"""Repetition: equal and near-equal functions, shared fragments, functions that nothing or only tests call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import sets, similar
from factweave.plans.config import Config
from factweave.plans.findings import finding, union
from factweave.plans.functions import ignored


def _judged(functions: DataFrame, config: Config, by_path: bool = True) -> DataFrame:
    """Functions that the rules compare: no tests, no trait impls, as the settings say."""
    d = config.duplicates
    f = functions.where("has_body")
    if d.ignore_tests:
        tests = F.col("in_test") | F.col("test_attr")
        f = f.where(~(tests | F.contains(F.col("file"), F.lit("/tests/")) if by_path else tests))
    return f.where("not is_trait_impl and owner <> 'trait'") if d.ignore_trait_impls else f


def duplicate_groups(functions: DataFrame, config: Config = Config(), cap: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """(id, group_size, group_id) of functions with equal tokens, and pairs (a, b, similarity) among the others."""
    d = config.duplicates
    f = _judged(functions, config).where((F.size("body.tokens") >= d.min_tokens) & (F.col("body.body_lines") >= d.min_lines))
    f = f.select("id", F.col("body.tokens").alias("tokens"))
    same, rest = sets.exact_groups(f, "tokens", "id")
    return same, similar.near_dups(rest, "id", "tokens", d.similarity_threshold, cap=cap)


def duplicates(functions: DataFrame, config: Config = Config(), cap: int | None = 50) -> DataFrame:
    """DRY-001: one finding for each function of a group or pair."""
    same, near = duplicate_groups(functions, config, cap)
    at = functions.select("id", "file", "line", F.concat_ws("::", "parent_type", "name").alias("qualified"))
    first = at.select(F.col("id").alias("group_id"), F.col("qualified").alias("other"))
    exact = same.join(at, "id").join(first, "group_id")
    pairs = near.select("a", "b", "similarity")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("group_id"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("group_id"), "similarity")).join(at, "id").join(first, "group_id")
    return union([
        finding(exact, "dry", "DRY-001", F.format_string("%s is one of %d equal functions", "qualified", "group_size")),
        finding(both, "dry", "DRY-001", F.format_string("%s is like %s (%.2f)", "qualified", "other", "similarity")),
    ])


def fragments(functions: DataFrame, config: Config = Config(), cap: int | None = 50) -> DataFrame:
    """DRY-003: runs of statements that two functions share, a finding in each; windows are compared as their own tokens say."""
    d = config.duplicates
    f = _judged(functions, config, by_path=False)
    w = f.select(F.col("id").alias("seq"), F.explode("body.windows").alias("w")).where(F.size("w.tokens") >= d.min_tokens)
    x = w.select("seq", F.col("w.at").alias("at"), F.xxhash64("w.tokens").alias("h"), F.col("w.tokens").alias("values"))
    runs = similar.window_runs(x, d.min_statements, cap)
    place = w.select(F.col("seq").alias("id"), F.col("w.at").alias("start"), F.col("w.line").alias("line"))
    at = functions.select("id", "file", F.concat_ws("::", "parent_type", "name").alias("qualified"))
    each = runs.select(F.col("seq_a").alias("id"), F.col("start_a").alias("start"), F.col("seq_b").alias("other_id"), "rows").unionByName(runs.select(F.col("seq_b").alias("id"), F.col("start_b").alias("start"), F.col("seq_a").alias("other_id"), "rows"))
    other = at.select(F.col("id").alias("other_id"), F.col("qualified").alias("other"))
    return finding(each.join(place, ["id", "start"]).join(at, "id").join(other, "other_id"), "dry", "DRY-003", F.format_string("%s shares %d statements with %s", "qualified", "rows", "other"))


def called(functions: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (name) that production code and tests refer to: calls, functions as arguments or fields, public re-exports."""
    test = F.col("in_test") | (F.col("test_attr") & (F.col("owner") == "")) | F.col("test_file")
    each = functions.select(test.alias("test"), F.explode("body.targets").alias("name"))
    out = imports.where("public <> '' and kind <> 'glob'").select(F.col("in_test").alias("test"), F.element_at("segments", -1).alias("name"))
    every = each.union(out)
    return every.where("not test").select("name").distinct(), every.where("test").select("name").distinct()


def with_markers(functions: DataFrame, api: DataFrame, helpers: DataFrame) -> DataFrame:
    """functions with is_api and is_helper: a marker at most three lines above."""
    from factweave.plans.functions import _near

    return _near(_near(functions, api, "is_api"), helpers, "is_helper")


def uncalled(functions: DataFrame, imports: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows of functions that no code calls (kind uncalled) or only tests do (test_only). functions: with_markers."""
    prod, test = called(functions, imports)
    skip = (F.col("name") == "main") & (F.col("owner") == "") | F.col("is_test") | F.col("is_trait_impl") | (F.col("owner") == "trait") | F.col("allow_dead") | F.col("is_api") | ignored(config, F.col("name"))
    f = functions.where(~skip).withColumn("qualified", F.concat_ws("::", "parent_type", "name"))
    keys = ["name", "qualified"]
    free = sets.outside(f, prod.withColumnRenamed("name", "n"), keys, "n")
    none = sets.outside(free, test.withColumnRenamed("name", "n"), keys, "n").withColumn("why", F.lit("uncalled"))
    only = sets.inside(free.where("not is_helper"), test.withColumnRenamed("name", "n"), keys, "n").withColumn("why", F.lit("test_only"))
    return none.unionByName(only)


def dead_code(functions: DataFrame, imports: DataFrame, config: Config = Config()) -> DataFrame:
    """DRY-002."""
    u = uncalled(functions, imports, config)
    return finding(u, "dry", "DRY-002", F.when(F.col("why") == "uncalled", F.concat("qualified", F.lit(" is never called"))).otherwise(F.concat("qualified", F.lit(" is called by tests only"))), "low")
