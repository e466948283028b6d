"""Code that a derive or a helper would replace: ten patterns, each a filter or a count over facts of functions and impl blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import sets
from factweave.plans.config import Config
from factweave.plans.findings import finding, union

#: Limits of the patterns, and names of conversions that may map variants.
ACCESSORS, BUILDERS, ARMS, CONVERSIONS, CLONES, FIELDS, OVERLAP, REPEATS, FORMAT_BYTES, MATCHES = 3, 3, 4, 3, 3, 3, 0.5, 3, 5, 3
CONVERSION_NAMES = ("from_str", "from_str_opt", "from", "try_from", "fmt")


def _has(shape: str) -> Column:
    return F.array_contains("body.shapes", shape)


def _first(values: str, least: int) -> Column:
    """The first of a body's numbers that reaches a limit, else null."""
    return F.get(F.filter(f"body.{values}", lambda x: x >= least), F.lit(0))


def _sole(methods: DataFrame, trait: str, name: str) -> DataFrame:
    """Impls of a trait with a single method of that name."""
    m = methods.where(F.col("trait_name") == trait)
    one = m.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("name").alias("name")).where((F.col("n") == 1) & (F.col("name") == name))
    return m.join(one.select("file", "block"), ["file", "block"], "left_semi")


def boilerplate(functions: DataFrame, config: Config = Config()) -> DataFrame:
    """BP-001 to BP-010; settings may name the patterns that count. Only a file's own items are seen, inline modules aren't, but for formats."""
    top = functions.where((F.size("module") == 0) & F.col("has_body") & (F.col("owner") != "trait"))
    methods = top.where("owner = 'impl'")
    inherent, block = methods.where("trait_name is null"), ["file", "block", "block_line", "parent_type"]
    say = lambda text: F.format_string(text, F.coalesce("parent_type", F.lit("?")))

    inputs = F.col("parameter_count") + F.col("has_self").cast("int")
    access = inherent.where((_has("reads_field") & (inputs == 1)) | (_has("sets_field") & (inputs == 2)))
    many = access.groupBy("file", "block").count().where(F.col("count") >= ACCESSORS)
    builders = inherent.where(_has("sets_and_returns") & F.col("result_self")).groupBy(*block).count().where(F.col("count") >= BUILDERS)
    froms = _sole(methods, "From", "from")
    errors = froms.where(_has("one_value") & F.col("parent_type").isNotNull()).groupBy("file", "parent_type").agg(F.count("*").alias("n"), F.min(F.struct("block", "block_line")).alias("at")).where(F.col("n") >= CONVERSIONS)

    key = F.concat_ws("\0", F.col("id"), F.col("b.type"))
    built = top.select("id", F.posexplode("body.built").alias("pos", "b")).where(F.size("b.fields") >= FIELDS).select("id", key.alias("key"), "pos", F.col("b.fields").alias("fields"))
    alike = sets.overlap(built, "key", "pos", "fields").where(F.col("ratio") >= OVERLAP).join(built.select("key", "id").distinct(), "key").select("id").distinct()
    formats = functions.where("has_body").select("file", F.explode("body.formats").alias("f")).where(F.octet_length("f.value") >= FORMAT_BYTES)
    formats = formats.groupBy("file", F.col("f.value").alias("value")).agg(F.count("*").alias("n"), F.min("f.line").alias("line")).where(F.col("n") >= REPEATS)

    found = {
        "BP-001": (froms.where(_has("wraps")), say("From for %s only wraps a value"), "block_line"),
        "BP-002": (_sole(methods, "Display", "fmt").where(_has("writes")), say("Display for %s is a single write"), "block_line"),
        "BP-003": (access.join(many, ["file", "block"], "left_semi"), F.concat_ws("::", "parent_type", "name"), "line"),
        "BP-004": (builders, F.format_string("%d methods set a field and return self", "count"), "block_line"),
        "BP-005": (_sole(methods, "Default", "default").where(_has("defaults")), say("Default for %s gives defaults only"), "block_line"),
        "BP-006": (top.where(~F.col("name").isin(*CONVERSION_NAMES)).withColumn("n", _first("mapped_arms", ARMS)).where("n is not null"), F.format_string("%d arms map variants", "n"), "line"),
        "BP-007": (errors.withColumn("line", F.col("at.block_line")), F.format_string("%d conversions into %s", "n", "parent_type"), "line"),
        "BP-008": (top.withColumn("n", _first("clones", CLONES)).where("n is not null"), F.format_string("%d fields are cloned", "n"), "line"),
        "BP-009": (top.join(alike, "id", "left_semi"), F.lit("a type is built twice with like fields"), "line"),
        "BP-010": (formats, F.format_string("format %s stands %d times", "value", "n"), "line"),
    }
    chosen = config.boilerplate.patterns or tuple(found)
    parts = [finding(df, "dry", rule, message, "low", line=line) for rule, (df, message, line) in found.items() if rule in chosen]
    return union(parts) if parts else finding(formats.limit(0), "dry", "BP-010", F.lit(""))


def repeated_matches(functions: DataFrame, config: Config = Config()) -> DataFrame:
    """DRY-005: matches of three arms or more whose normalised text stands three times or more, a finding for each."""
    f = functions.where("has_body and owner <> 'trait'")
    if config.duplicates.ignore_tests:
        f = f.where("not in_test and not test_attr")
    m = f.select("file", F.explode("body.matches").alias("m")).select("file", "m.line", "m.arms", "m.enum", F.sha2(F.concat_ws("\0", "m.tokens"), 256).alias("h"))
    groups = m.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= MATCHES)
    return finding(m.join(groups, "h"), "dry", "DRY-005", F.format_string("match on %s with %d arms stands %d times", "enum", "arms", "n"))
