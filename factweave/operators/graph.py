"""Graph kernels over edge tables: degrees, gradients, components, cycles, reach and closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """K9: distinct in- and out-degree, neighbour lists and instability out / (in + out), 0 for an isolated node. Self edges and null ends don't count."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s <> _d")
    out = e.groupBy("_s").agg(F.sort_array(F.collect_set("_d")).alias("targets"))
    into = e.groupBy("_d").agg(F.sort_array(F.collect_set("_s")).alias("sources"))
    df = nodes.select(F.col(node).alias("node")).distinct().join(out, F.col("node") == F.col("_s"), "left").join(into, F.col("node") == F.col("_d"), "left")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    df = df.select("node", size("sources").alias("fan_in"), size("targets").alias("fan_out"), "sources", "targets")
    total = F.col("fan_in") + F.col("fan_out")
    return df.withColumn("instability", F.when(total > 0, F.col("fan_out") / total).otherwise(F.lit(0.0)))


def gradient(edges: DataFrame, metrics: DataFrame, node: str = "node", metric: str = "instability", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that lead from a lower to a strictly higher metric."""
    m = metrics.select(F.col(node).alias("_n"), F.col(metric).alias("_m"))
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    a, b = m.select(F.col("_n").alias("src"), F.col("_m").alias("src_metric")), m.select(F.col("_n").alias("dst"), F.col("_m").alias("dst_metric"))
    return e.join(a, "src").join(b, "dst").where("src_metric < dst_metric").select("src", "dst", "src_metric", "dst_metric")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each connected component; nodes are those of links.

    Alternates large-star and small-star rounds, which hang every node under smaller and smaller
    neighbours until stars remain. A round is two minima by key and joins; rows never exceed the
    links, no neighbour list is gathered, and each round is checkpointed.
    """
    x = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = x.select(F.col("u").alias("node")).union(x.select("v")).distinct()
    e = checkpointed(x.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def closure(edges: DataFrame, seeds: DataFrame, seed: str = "node", src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """Every node that seeds reach, seeds included, whether in the graph or not. A frontier moves on until it is empty; visited nodes never return, so cycles end."""
    e = checkpointed(_edges(edges, src, dst))
    seen = front = checkpointed(seeds.select(F.col(seed).alias("node")).where("node is not null").distinct())
    for _ in range(max_rounds):
        found = e.join(front, e["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(found.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.union(front))
    raise RuntimeError("closure did not end")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, start: str = "start", node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Start, node, hops: nodes within `depth` hops of each start, itself excluded. seeds (start, node) are hop 1. The depth unrolls into joins; nodes seen at fewer hops don't come back."""
    e = _edges(edges, src, dst)
    front = seeds.select(F.col(start).alias("start"), F.col(node).alias("node")).where("start <> node").distinct().withColumn("hops", F.lit(1))
    seen = front
    for hop in range(2, depth + 1):
        go = front.select("start", F.col("node").alias("src")).join(e, "src").where("dst <> start").select("start", F.col("dst").alias("node")).distinct()
        front = go.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.union(front)
    return seen


def settle(rows: DataFrame, deps: DataFrame, key: str = "node", bad: str = "bad", src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(node, bad) after bad rows turn good whose targets are all good, again and again until none does. A target that isn't a row never is good."""
    r = rows.select(F.col(key).alias("node"), F.col(bad).alias("bad"))
    still = checkpointed(r.where("bad").select("node"))
    e = _edges(deps, src, dst)
    e = checkpointed(e.join(still, e["src"] == still["node"], "left_semi"))
    unknown = e.join(r, e["dst"] == r["node"], "left_anti").select(F.col("src").alias("node"))
    for _ in range(max_rounds):
        held = e.join(still, e["dst"] == still["node"], "left_semi").select(F.col("src").alias("node")).union(unknown).distinct()
        now = checkpointed(still.join(held, "node", "left_semi"))
        if now.count() == still.count():
            break
        still = now
    return r.join(still.withColumn("_still", F.lit(True)), "node", "left").select("node", F.coalesce("_still", F.lit(False)).alias("bad"))


def scc(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(node, component) of strongly connected components with two nodes or more, named by their smallest node.

    Colours: the smallest name flows along edges until it settles; nodes that reach the namesake
    backwards within its colour are its component. They leave, and the rest starts anew. Nodes without
    an edge in or out leave first. State is a row per node and per edge, checkpointed each round.
    """
    e = checkpointed(_edges(edges, src, dst).where("src <> dst"))
    out = None
    for _ in range(max_rounds):
        while True:  # trim
            n = e.count()
            e2 = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            e2 = checkpointed(e2.join(e2.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            e = e2
            if e.count() == n:
                break
        if e.isEmpty():
            break
        colour = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            sent = e.join(colour, e["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            new = checkpointed(colour.join(sent, colour["node"] == sent["dst"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            moved = new.join(colour.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty()
            colour = new
            if moved:
                break
        a, b = (colour.select(F.col("node").alias(k), F.col("c").alias(f"c_{k}")) for k in ("src", "dst"))
        own = checkpointed(e.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("c")))
        back = closure(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = c").select("node"))
        done = checkpointed(colour.join(back, "node", "left_semi").select("node", F.col("c").alias("component")))
        out = done if out is None else out.union(done)
        e = checkpointed(e.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if out is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    big = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(big, "component", "left_semi").select("node", "component")
