"""Functions: which calls are one's own, integration or operation, severity, effort and complexity limits.

Scopes (own functions, methods, types) are distinct tables that calls meet in joins; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed
from factweave.functions.text import glob_regex
from factweave.plans.config import Config
from factweave.plans.findings import finding, union

NEAR = 3


def ignored(config: Config, name: Column) -> Column:
    return reduce(lambda a, b: a | b, (name.rlike(glob_regex(g)) for g in config.ignore_functions), F.lit(False))


def test_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """file: those under tests/, those that declare themselves test code or are declared so, and what they declare in turn."""
    from factweave.operators.graph import closure

    f = F.regexp_replace("file", r"\\", "/")
    stem, folder = F.regexp_extract(f, r"([^/]*)\.rs$", 1), F.regexp_extract(f, r"^(.*/)?[^/]*$", 1)
    base = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.concat(folder, stem, F.lit("/")))
    named = modules.where("not inline and size(module) = 1").select(f.alias("src"), "in_test", F.concat(base, F.col("module")[0]).alias("at"))
    known = files.select(F.regexp_replace("path", r"\\", "/").alias("dst")).distinct()
    both = named.select("src", "in_test", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat("at", F.lit(".rs")).alias("dst")), F.struct(F.lit(1).alias("o"), F.concat("at", F.lit("/mod.rs")).alias("dst")))).alias("x"), "at").select("src", "in_test", "at", "x.o", "x.dst")
    edges = both.join(known, "dst").groupBy("src", "in_test", "at").agg(F.min(F.struct("o", "dst")).alias("x")).select("src", "in_test", "x.dst")
    seeds = edges.where("in_test").select(F.col("dst").alias("node"))
    seeds = seeds.union(modules.where("inline and size(module) = 0 and in_test").select(f.alias("node"))).union(known.where("dst like 'tests/%'"))
    return closure(edges, seeds).select(F.col("node").alias("file"))


def with_tests(functions: DataFrame, tests: DataFrame) -> DataFrame:
    """functions, those of test files marked as tests too."""
    t = tests.select("file").distinct().withColumn("_test", F.lit(True))
    return functions.join(t, "file", "left").withColumn("is_test", F.col("is_test") | F.coalesce("_test", F.lit(False))).withColumn("test_file", F.coalesce("_test", F.lit(False))).drop("_test")


def scopes(functions: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """Distinct names: functions, methods, method_of (type, name), types, trivial (accessors only), trait_only."""
    names = lambda df: df.select("name").where("name is not null").distinct()
    impls, traits = functions.where("owner = 'impl'"), functions.where("owner = 'trait'")
    plain = F.col("has_self") & (F.col("parameter_count") == 0) & F.coalesce(F.col("body.accessor"), F.lit(False))
    own = names(impls.where("not is_trait_impl"))
    return {
        "functions": names(functions.where("owner = ''")),
        "methods": names(impls.unionByName(traits)),
        "method_of": impls.select(F.col("parent_type").alias("type"), "name").where("type is not null").distinct(),
        "types": names(types.where("kind <> 'union'").select("name").union(impls.select("parent_type"))),
        "trivial": names(impls.where(plain)).join(names(impls.where(~plain)), "name", "left_anti"),
        "trait_only": names(impls.where("is_trait_impl").unionByName(traits)).join(own, "name", "left_anti"),
    }


def _mark(df: DataFrame, names: DataFrame, on: dict[str, Column], out: str) -> DataFrame:
    """df with whether its values stand in a table of distinct keys."""
    n = names.select(*(F.col(k).alias(f"_{k}") for k in on)).withColumn(out, F.lit(True))
    match = reduce(lambda a, b: a & b, (v == n[f"_{k}"] for k, v in on.items()))
    return df.join(n, match, "left").drop(*(f"_{k}" for k in on)).withColumn(out, F.coalesce(out, F.lit(False)))


def own_calls(functions: DataFrame, types: DataFrame, config: Config = Config()) -> DataFrame:
    """id, pos, label and line of each call of a function or method of the project."""
    s = scopes(functions, types)
    c = functions.select("id", F.col("name").alias("caller"), F.posexplode("body.calls").alias("pos", "c")).select("id", "caller", "pos", "c.*")
    two = F.instr("name", "::") > 0
    c = c.withColumn("prefix", F.when((F.col("form") == "path") & two, F.substring_index("name", "::", 1)))
    c = c.withColumn("rest", F.when(F.col("prefix").isNotNull(), F.expr("substring(name, length(prefix) + 3)")).otherwise(F.col("name")))
    for out, on in (("functions", "name"), ("methods", "rest"), ("trivial", "name"), ("trait_only", "rest")):
        c = _mark(c, s[out], {"name": F.col(on)}, f"in_{out}")
    c = _mark(c, s["types"], {"name": F.col("prefix")}, "in_types")
    c = _mark(c, s["method_of"], {"type": F.col("receiver"), "name": F.col("name")}, "in_method_of")
    path = F.when(F.col("prefix").isNull(), F.col("in_functions")).when(F.col("prefix") == "Self", F.col("in_methods") & ~F.col("in_trait_only")).otherwise(F.col("in_types") & ~F.col("rest").rlike(r"^\p{Lu}") & ~F.col("in_trait_only"))
    method = F.when(F.col("receiver").isNotNull(), F.col("in_method_of")).otherwise(F.col("in_methods")) & ~F.col("in_trivial") & ~F.col("in_trait_only")
    c = c.where(F.when(F.col("form") == "path", path).otherwise(method))
    if config.allow_recursion:
        c = c.where((F.col("name") != F.col("caller")) & ~F.endswith(F.col("name"), F.concat(F.lit("::"), "caller")))
    return c.select("id", "pos", F.when(F.col("form") == "path", F.col("name")).otherwise(F.concat(F.lit("."), "name", F.lit("()"))).alias("label"), "line")


def _near(df: DataFrame, marks: DataFrame, out: str, n: int = NEAR) -> DataFrame:
    """df (file, line) with whether a marker stands on the line or at most n above it."""
    at = marks.select("file", F.explode(F.sequence(F.col("line"), F.col("line") + n)).alias("line")).distinct().withColumn(out, F.lit(True))
    return df.join(at, ["file", "line"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def classify(functions: DataFrame, types: DataFrame, config: Config = Config(), recursive: DataFrame | None = None) -> DataFrame:
    """A row per function with a body: id, class (integration, operation, trivial, violation), own_calls, metrics, severity, effort. Trivial functions have no metrics.

    Violations whose calls all lead to functions that are none become operations, again and again until none does; a
    call counts by its label, which several functions may answer to.
    """
    f = functions.where("has_body").where(~ignored(config, F.col("name")))
    calls = checkpointed(own_calls(functions.where("has_body"), types, config).join(f.select("id"), "id", "left_semi"))
    first = calls.groupBy("id", "label").agg(F.min("pos").alias("pos"))
    per = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("own_calls"))
    count = calls.groupBy("id").agg(F.count("*").alias("call_count"))
    f = f.join(per, "id", "left").join(count, "id", "left").withColumn("own_calls", F.coalesce("own_calls", F.array().cast("array<string>"))).withColumn("call_count", F.coalesce("call_count", F.lit(0)))
    logic, own = F.size("body.logic") > 0, F.size("own_calls") > 0
    kind = F.when(F.col("body.statements") == 0, "trivial").when(logic & own, "violation").when(own, "integration").when(logic, "operation").otherwise("trivial")
    f = f.withColumn("qualified", F.concat_ws("::", "parent_type", "name")).withColumn("class", kind)
    f = f.withColumn("class", F.when(F.col("is_test") & (F.col("class") == "violation"), "trivial").otherwise(F.col("class")))
    if recursive is not None:
        f = _near(f, recursive, "_r").withColumn("own_calls", F.when(F.col("_r"), F.filter("own_calls", lambda c: (c != F.col("name")) & (c != F.col("qualified")))).otherwise(F.col("own_calls"))).drop("_r")
    f = checkpointed(f)
    still = _settled(f)
    f = f.join(still.withColumn("_still", F.lit(True)), "id", "left")
    turned = (F.col("class") == "violation") & F.col("_still").isNull()
    total = F.size("body.logic") + F.size("own_calls")
    f = f.withColumn("own_calls", F.when(turned, F.array().cast("array<string>")).otherwise(F.col("own_calls"))).withColumn("class", F.when(turned, "operation").otherwise(F.col("class"))).drop("_still")
    bad = F.col("class") == "violation"
    f = f.withColumn("severity", F.when(bad, F.when(total > 5, "high").when(total > 2, "medium").otherwise("low")))
    f = f.withColumn("effort", F.when(bad, F.size("body.logic") * 1.0 + F.size("own_calls") * 1.5 + F.col("body.max_nesting") * 2.0))
    return f.withColumn("measured", F.col("class") != "trivial")


def _settled(f: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """id of the violations that stay."""
    labels = f.select("id", F.explode(F.array("name", "qualified", F.concat(F.lit("."), "name", F.lit("()")))).alias("label"))
    still = checkpointed(f.where("class = 'violation'").select("id"))
    needs = f.where("class = 'violation'").select("id", F.explode("own_calls").alias("label"))
    n = still.count()
    for _ in range(max_rounds):
        if not n:
            return still
        safe = labels.join(still, "id", "left_anti").select("label").distinct()
        held = needs.join(still, "id", "left_semi").join(safe, "label", "left_anti").select("id").distinct()
        still = checkpointed(held)
        now = still.count()
        if now == n:
            return still
        n = now
    raise RuntimeError("classification did not settle")


def complexity(classified: DataFrame, config: Config = Config(), unsafe: DataFrame | None = None) -> DataFrame:
    """CX-001 to CX-006 and error handling, over functions that aren't trivial. Length, magic numbers and error handling don't judge tests."""
    c = config.complexity
    f = classified.where("measured")
    b = lambda x: F.col(f"body.{x}")
    over = lambda rule, value, most, df: finding(df.where(value > most).withColumn("_v", value), "complexity", rule, F.format_string(f"%s has {rule} %d over {most}", "qualified", "_v"))
    prod = f.where("not is_test")
    out = [over("CX-001", b("cognitive"), c.max_cognitive, f), over("CX-002", b("cyclomatic"), c.max_cyclomatic, f), over("CX-004", b("body_lines"), c.max_function_lines, prod), over("CX-005", b("max_nesting"), c.max_nesting_depth, f)]
    if c.detect_magic_numbers:
        each = prod.select("file", "qualified", F.explode("body.numbers").alias("x")).select("file", "qualified", "x.*").where(~F.col("value").isin(list(c.allowed_magic_numbers)))
        out.append(finding(each, "complexity", "CX-003", F.concat(F.lit("magic number "), "value", F.lit(" in "), "qualified"), "low"))
    if c.detect_unsafe:
        open_ = f if unsafe is None else _near(f, unsafe, "_u").where(~F.col("_u")).drop("_u")
        out.append(over("CX-006", b("n_unsafe"), 0, open_))
    if c.detect_error_handling:
        n = b("n_unwrap") + b("n_panic") + b("n_todo") + (F.lit(0) if c.allow_expect else F.least(b("n_expect"), F.lit(1)))
        out.append(over("A20", n, 0, prod))
    return union(out) if c.enabled else union(out).limit(0)


def violations(classified: DataFrame) -> DataFrame:
    """Functions that mix logic and calls of their own."""
    return finding(classified.where("class = 'violation'"), "iosp", "IOSP", F.format_string("%s has %d logic places and calls %s", "qualified", F.size("body.logic"), F.array_join("own_calls", ", ")))
