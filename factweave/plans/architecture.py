"""Architecture: layers of files, forbidden edges between them, and scopes of pattern rules.

Layers and rules are small lists that become expressions; files and imports are tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import glob_regex
from factweave.operators import sets
from factweave.plans.findings import finding, union


@dataclass(frozen=True)
class Layers:
    """Names by rank, the innermost first; globs of files for each; external crates by name or glob, and names that stand for no crate."""

    order: tuple[str, ...]
    paths: dict[str, tuple[str, ...]]
    external: dict[str, str] | None = None
    unmatched: str = "composition_root"


def layer_of_files(files: DataFrame, layers: Layers) -> DataFrame:
    """path, layer: the first layer in rank order one of whose globs matches."""
    patterns = [(name, g) for name in layers.order for g in layers.paths.get(name, ())]
    return sets.classify(files.select("path"), "path", patterns)


def import_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports from the own crate with the file that their second segment stands for (src/x.rs, else src/x/mod.rs)."""
    own = imports.where((F.get("segments", F.lit(0)) == "crate") & (F.size("segments") >= 2)).select("file", "segments", "line", "use_line", F.col("segments")[1].alias("s"))
    known = files.select(F.regexp_replace("path", r"\\", "/").alias("target")).distinct()
    probe = own.select("*", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat(F.lit("src/"), "s", F.lit(".rs")).alias("target")), F.struct(F.lit(1).alias("o"), F.concat(F.lit("src/"), "s", F.lit("/mod.rs")).alias("target")))).alias("x")).select("file", "segments", "line", "use_line", "x.o", "x.target")
    return probe.join(known, "target").groupBy("file", "segments", "line", "use_line").agg(F.min(F.struct("o", "target")).alias("x")).select("file", "segments", "line", "use_line", "x.target")


def layer_violations(files: DataFrame, imports: DataFrame, layers: Layers) -> DataFrame:
    """Imports from an inner layer into an outer one; external crates count by their own layer where they have one."""
    at = layer_of_files(files, layers)
    rank = lambda c: F.array_position(F.array(*map(F.lit, layers.order)), c)
    src = at.select(F.col("path").alias("file"), F.col("layer").alias("src"))
    own = import_targets(files, imports).join(at.select(F.col("path").alias("target"), F.col("layer").alias("dst")), "target").join(src, "file")
    parts = [own.select("file", "use_line", F.array_join("segments", "::").alias("what"), "src", "dst")]
    if layers.external:
        crate = F.get("segments", F.lit(0))
        exact = F.coalesce(*(F.when(crate == name, F.lit(layer)) for name, layer in layers.external.items()), *(F.when(crate.rlike(glob_regex(name)), F.lit(layer)) for name, layer in layers.external.items()))
        ext = imports.where(~crate.isin("crate", "self", "super", "std", "core", "alloc")).select("file", "use_line", F.array_join("segments", "::").alias("what"), exact.alias("dst"))
        parts.append(ext.where("dst is not null").join(src, "file").select("file", "use_line", "what", "src", "dst"))
    every = union(parts).where("src is not null and dst is not null")
    bad = every.where(rank(F.col("dst")) > rank(F.col("src")))
    return finding(bad, "architecture", "ARCH-LAYER", F.format_string("%s imports %s of %s", "src", "what", "dst"), "high", line="use_line")


def resolved(imports: DataFrame) -> DataFrame:
    """Imports with their segments from the crate's root: self and super walk from the importing module."""
    mods = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\\", "/"), "^src/", ""), r"\.rs$", ""), "/"), lambda x: x != "")
    here = F.when((F.size(mods) == 1) & mods[0].isin("lib", "main"), F.slice(mods, 1, 0)).when(F.element_at(mods, -1) == "mod", F.slice(mods, F.lit(1), F.size(mods) - 1)).otherwise(mods)
    here = F.concat(here, "module")
    ups = F.size(F.filter("segments", lambda s: s == "super"))
    first = F.get("segments", F.lit(0))
    rest = F.filter("segments", lambda s: ~s.isin("super", "self", "crate"))
    path = F.when(first == "crate", F.slice("segments", F.lit(2), F.size("segments"))).when(first == "self", F.concat(here, rest)).when(first == "super", F.concat(F.slice(here, F.lit(1), F.greatest(F.size(here) - ups, F.lit(0))), rest))
    return imports.withColumn("path", path).where("path is not null")


def forbidden(imports: DataFrame, sources: str, to: str, exceptions: tuple[str, ...] = (), reason: str = "") -> DataFrame:
    """Imports of files that match `sources` whose target, or a module above it, is a file that matches `to`, unless one is an exception."""
    i = resolved(imports.where(F.col("file").rlike(glob_regex(sources))))
    n = F.size("path")
    steps = F.when(n > 0, F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array(F.concat(F.lit("src/"), F.array_join(F.slice("path", F.lit(1), k), "/"), F.lit(".rs")), F.concat(F.lit("src/"), F.array_join(F.slice("path", F.lit(1), k), "/"), F.lit("/mod.rs")))))).otherwise(F.array().cast("array<string>"))
    hit = lambda glob: F.exists(steps, lambda x: x.rlike(glob_regex(glob)))
    bad = i.where(hit(to))
    for e in exceptions:
        bad = bad.where(~hit(e))
    return finding(bad, "architecture", "ARCH-FORBIDDEN", F.concat(F.array_join("segments", "::"), F.lit(f" is forbidden here{': ' + reason if reason else ''}")), "high", line="use_line")


def glob_imports(imports: DataFrame, name: str, allow: list[str] | None = None, forbid: list[str] | None = None, exceptions: list[str] = ()) -> DataFrame:
    """Pattern rule on glob imports, in the files its scope covers."""
    bad = imports.where("kind = 'glob'").where(sets.scope(F.col("file"), allow, forbid, exceptions))
    return finding(bad, "architecture", f"ARCH-{name}", F.concat(F.lit("glob import of "), F.array_join("segments", "::")), line="use_line")


def macro_calls(functions: DataFrame, macros: list[str], name: str, allow: list[str] | None = None, forbid: list[str] | None = None, exceptions: list[str] = ()) -> DataFrame:
    """Pattern rule on macros, by the last segment of their path."""
    f = functions.where("has_body").where(sets.scope(F.col("file"), allow, forbid, exceptions)).select("file", "line", F.explode(F.array_intersect("body.macros", F.array(*map(F.lit, macros)))).alias("macro"))
    return finding(f, "architecture", f"ARCH-{name}", F.concat("macro", F.lit("! is not for here")))


def calls(functions: DataFrame, form: str, names: list[str], name: str, allow: list[str] | None = None, forbid: list[str] | None = None, exceptions: list[str] = ()) -> DataFrame:
    """Pattern rule on calls: form path (the whole path as written) or method (by name, or the tail of a path of two segments or more)."""
    c = functions.where("has_body").where(sets.scope(F.col("file"), allow, forbid, exceptions)).select("file", F.explode("body.calls").alias("c")).select("file", "c.*")
    same = F.col("name").isin(names)
    tail = (F.col("form") == "path") & (F.instr("name", "::") > 0) & F.element_at(F.split("name", "::"), -1).isin(names)
    hit = same & (F.col("form") == "path") if form == "path" else same & (F.col("form") == "method") | tail
    return finding(c.where(hit), "architecture", f"ARCH-{name}", F.concat("name", F.lit(" is not for here")))
