"""Set, grouping and classification kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import ancestors, glob_regex


def outside(df: DataFrame, names: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """K5: rows whose value isn't in the set under any of the keys. A null key is in no set."""
    s = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    for k in keys:
        df = df.join(s, df[k] == s["_name"], "left_anti")
    return df


def inside(df: DataFrame, names: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """K5: rows whose value is in the set under one of the keys, each row once."""
    s = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    parts, rest = [], df
    for k in keys:
        parts.append(rest.join(s, rest[k] == s["_name"], "left_semi"))
        rest = rest.join(s, rest[k] == s["_name"], "left_anti")
    return reduce(DataFrame.unionByName, parts)


def exact_groups(df: DataFrame, seq: str, id: str) -> tuple[DataFrame, DataFrame]:
    """K6: (id, group_size, group_id) of rows whose sequence occurs twice or more, and the rest. The hash only deals rows out; the sequence is part of the key. group_id is the smallest id."""
    g = df.groupBy(F.xxhash64(seq).alias("_h"), F.col(seq)).agg(F.count("*").alias("group_size"), F.min(id).alias("group_id"))
    both = df.withColumn("_h", F.xxhash64(seq)).join(g, ["_h", seq])
    return both.where("group_size > 1").select(id, "group_size", "group_id"), both.where("group_size = 1").drop("_h", "group_size", "group_id")


def flags(df: DataFrame, rules: list[tuple[str, Column, float]], keep: list[str]) -> DataFrame:
    """One row per exceeded limit: kept columns, rule_id, value, limit."""
    each = [F.when(v > limit, F.struct(F.lit(r).alias("rule_id"), v.cast("double").alias("value"), F.lit(float(limit)).alias("limit"))) for r, v, limit in rules]
    hits = F.filter(F.array(*each), lambda x: x.isNotNull())
    return df.select(*keep, F.inline(hits))


def having_count(df: DataFrame, by: list[str], least: int, most: int | None = None, distinct: str | None = None) -> DataFrame:
    """Groups with so many rows, or distinct values of a column."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    g = df.groupBy(*by).agg(n.alias("n")).where(F.col("n") >= least)
    return g if most is None else g.where(F.col("n") <= most)


def first_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a total order; one struct minimum, so partial sums go before the shuffle and no window holds a hot key's rows."""
    rest = [c for c in df.columns if c not in {*by, *order}]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*(c if c in by else f"x.{c}" for c in df.columns))


def overlap(df: DataFrame, by: str, order: str, values: str) -> DataFrame:
    """Of the first two sets of each group, |A & B| / min(|A|, |B|); groups of one set have none."""
    w = Window.partitionBy(by).orderBy(order)
    two = df.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    s = two.groupBy(by).agg(F.max(F.when(F.col("_n") == 1, F.col(values))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col(values))).alias("_b")).where("_b is not null")
    least = F.least(F.size(F.array_distinct("_a")), F.size(F.array_distinct("_b")))
    return s.select(by, F.when(least > 0, F.size(F.array_intersect("_a", "_b")) / least).otherwise(F.lit(0.0)).alias("ratio"))


def classify(df: DataFrame, column: str, patterns: list[tuple[str, str]], out: str = "layer") -> DataFrame:
    """The first pattern (a glob) that matches, in declared order; null where none does."""
    c = F.coalesce(*(F.when(F.col(column).rlike(glob_regex(g)), F.lit(name)) for name, g in patterns))
    return df.withColumn(out, c)


def rank_violations(edges: DataFrame, ranked: DataFrame, ranks: list[str], node: str = "node", layer: str = "layer") -> DataFrame:
    """Edges from a layer to one that is declared later. Unranked ends don't count."""
    at = F.array_position(F.array(*map(F.lit, ranks)), F.col(layer))
    r = ranked.select(F.col(node).alias("_n"), at.alias("_r"), F.col(layer).alias("_l")).where("_r > 0")
    a, b = (r.select(F.col("_n").alias(k), F.col("_r").alias(f"{k}_rank"), F.col("_l").alias(f"{k}_layer")) for k in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("dst_rank > src_rank").select("src", "dst", "src_layer", "dst_layer")


def scope(path: Column, allow: list[str] | None = None, forbid: list[str] | None = None, exceptions: list[str] = ()) -> Column | None:
    """Whether a rule applies to a path: outside the allow-list, or inside the forbid-list and in no exception. With both or neither list a rule doesn't apply anywhere."""
    if (allow is None) == (forbid is None):
        return F.lit(False)
    hit = lambda globs: reduce(lambda a, b: a | b, (path.rlike(glob_regex(g)) for g in globs), F.lit(False))
    return ~hit(allow) if allow is not None else hit(forbid) & ~hit(exceptions)


def candidate_hits(df: DataFrame, segments: str, to: str, exceptions: list[str] = ()) -> DataFrame:
    """Rows of whose path's ancestors one matches `to` and none matches an exception."""
    c = ancestors(F.col(segments))
    bad = reduce(lambda a, b: a | b, (_any(c, g) for g in exceptions), F.lit(False))
    return df.where(_any(c, to) & ~bad)


def _any(candidates: Column, glob: str) -> Column:
    return F.exists(candidates, lambda x: x.rlike(glob_regex(glob)))


def uncovered(rows: DataFrame, hits: DataFrame, keys: list[str], hit: str = "hits") -> DataFrame:
    """Rows whose key has hits of 0; a key without hits gives nothing."""
    return rows.join(hits.where(F.col(hit) == 0).select(*keys).distinct(), keys, "left_semi")
