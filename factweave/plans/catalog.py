"""Registered queries: each kernel over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.text import ancestors
from factweave.operators import graph, lines, scoring, sets, similar

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LAYERS = [("base", "ECONOMY*"), ("base", "STANDARD*"), ("middle", "{MEDIUM,SMALL}*"), ("top", "*")]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trade(spark: SparkSession, sf: str, least: int = 2) -> DataFrame:
    """Edges (src, dst) between nations that trade dear, discounted, large items at least so often. Nations and suppliers are small; lineitem and orders meet on the order key."""
    li = _t(spark, sf, "lineitem").where("l_quantity >= 49 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    s, c = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = x.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("src", "dst")


def _nodes(spark, sf):
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))


def _degrees(spark, sf, least=2):
    return graph.degrees(_nodes(spark, sf), trade(spark, sf, least))


def _csv(c: str):
    return F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))


def k1_scan(spark, sf):
    parts = [_t(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("table").rlike("^[a-n]"))


def _lines(spark, sf):
    return lines.lines(_t(spark, sf, "documents"), "doc_id", "text")


def k2_markers(spark, sf):
    return lines.markers(_lines(spark, sf), r"^Licensed under (.*)$").select("doc_id", "line", "payload")


def k3_run_ends(spark, sf):
    return lines.run_ends(_lines(spark, sf), F.length("text") >= 40, "doc_id").select("doc_id", "line", "run_end")


def _numbered(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", F.row_number().over(w).cast("long").alias("line"))


def k4_band(spark, sf):
    e = _numbered(spark, sf)
    return lines.band_mark(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), 3, ["user_id"]).select("event_id", "user_id", "line")


def k5_outside(spark, sf):
    names = _t(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("name"))
    return sets.outside(_t(spark, sf, "part").select("p_partkey", "p_name"), names, ["p_partkey"])


def k5_inside(spark, sf):
    names = _t(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("name"))
    return sets.inside(_t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), names, ["c_custkey", "c_nationkey"])


def k6_exact_groups(spark, sf):
    return sets.exact_groups(_t(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")[0]


def k7_near_dups(spark, sf):
    words = F.filter(F.split("text", r"[\t\n\f\r ]+"), lambda w: w != "")  # \s of the SQL, which unlike Java's has no \x0B
    d = _t(spark, sf, "documents").select("doc_id", words.alias("tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("copy"))
    return similar.near_dups(d, "doc_id", "tokens", cap=None, once="copy").select("a", "b", F.round("similarity", 6).alias("similarity"))


def k8_fragments(spark, sf):
    x = _lines(spark, sf).where(F.length("text") > 0).withColumn("size", F.size(F.split("text", " ")))
    return similar.fragments(x, "doc_id", "line", "text", "size", 3, 30, cap=None)


def k9_degrees(spark, sf):
    d = _degrees(spark, sf)
    return d.select("node", "fan_in", "fan_out", F.round("instability", 6).alias("instability"), _csv("sources").alias("sources"), _csv("targets").alias("targets"))


def k10_gradient(spark, sf):
    return graph.gradient(trade(spark, sf), _degrees(spark, sf)).select("src", "dst", F.round("src_metric", 6).alias("src_metric"), F.round("dst_metric", 6).alias("dst_metric"))


def k11_cycles(spark, sf):
    return graph.scc(trade(spark, sf))


def k12_components(spark, sf):
    li = _t(spark, sf, "lineitem").where("l_quantity = 50 and l_discount >= 0.09 and l_tax >= 0.07")
    links = li.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return graph.components(links)


def _region(spark, sf, key):
    return _t(spark, sf, "nation").where(F.col("n_regionkey") == key).select(F.col("n_nationkey").alias("node"))


def k13_reach(spark, sf):
    e = trade(spark, sf)
    return graph.reach(e, e.select(F.col("src").alias("start"), F.col("dst").alias("node")), 3)


def k14_closure(spark, sf):
    return graph.closure(trade(spark, sf), _region(spark, sf, 1))


def k15_settle(spark, sf):
    bad = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("node")).agg((F.avg("c_acctbal") < 4400).alias("bad"))
    return graph.settle(bad, trade(spark, sf))


def k16_flags(spark, sf):
    rules = [("quantity", F.col("l_quantity"), 49), ("price", F.col("l_extendedprice"), 90000), ("discount", F.col("l_discount"), 0.09), ("tax", F.col("l_tax"), 0.07)]
    return sets.flags(_t(spark, sf, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


def _suppliers(spark, sf):
    li = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("items"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"), F.sum((F.col("l_linestatus") == "O").cast("long")).alias("open"), F.max("l_quantity").alias("largest"))
    return li


def k17_composite(spark, sf):
    s = sets_score(_suppliers(spark, sf))
    unlimited = scoring.composite([(1.0, F.col("returned"), 0), (0.5, F.col("items") - F.col("items"), 0)])
    return s.where("score >= 0.5").select("l_suppkey", F.round("score", 6).alias("score"), unlimited.alias("unlimited"))


def sets_score(s: DataFrame) -> DataFrame:
    share = lambda a: scoring.ratio(F.col(a), F.col("items"))
    return s.withColumn("score", scoring.composite([(0.5, share("returned"), 0.4), (0.3, share("open"), 0.6), (0.2, F.col("largest"), 50.0)]))


def k18_ramp(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.round(scoring.ramp(F.col("p_retailprice"), 1000.0, 1800.0), 6).alias("ramp"), scoring.ramp(F.col("p_size").cast("double"), 30.0, 10.0).alias("inverted"))


def k19_single(spark, sf):
    return sets.having_count(_t(spark, sf, "lineitem").where("l_quantity >= 49"), ["l_partkey"], 1, 1, "l_suppkey").select("l_partkey", "n")


def _layers(spark, sf):
    return sets.classify(_t(spark, sf, "part").select("p_partkey", "p_type"), "p_type", LAYERS)


def k20_layers(spark, sf):
    return _layers(spark, sf).groupBy("p_type", "layer").agg(F.count("*").alias("n"))


def k20_rank_violations(spark, sf):
    n = _layers(spark, sf).select(F.col("p_partkey").alias("node"), "layer")
    e = _t(spark, sf, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return sets.rank_violations(e, n, ["top", "middle", "base"])


def k21_scope(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url")
    return p.where(sets.scope(F.col("url"), forbid=["*/en/*"], exceptions=["*blog.*", "*[?]*"]))


def k22_candidates(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.filter(F.split(F.regexp_replace("url", "^https?://", ""), "/"), lambda x: x != "").alias("segments"))
    return sets.candidate_hits(p, "segments", "*example.com*", ["*/de"]).select("page_id", F.element_at(ancestors(F.col("segments")), -1).alias("host"))


def k23_score(spark, sf):
    c = _t(spark, sf, "orders").agg(F.count("*").alias("total"), *(F.sum((F.col("o_orderstatus") == x).cast("long")).alias(x) for x in "FOP"), F.sum((F.col("o_totalprice") > 300000).cast("long")).alias("dear"))
    scores = [scoring.ratio(F.col("F") + F.col("O"), F.col("total")), scoring.deficit(F.col("P"), F.col("total")), scoring.deficit(F.col("dear"), F.col("total"))]
    return c.select(F.round(scoring.weighted(scores, [0.5, 0.3, 0.2]), 6).alias("score"), F.round(scoring.weighted(scores, [0.0, 0.0, 0.0]), 6).alias("unweighted"), *(F.round(s, 6).alias(f"score_{i}") for i, s in enumerate(scores)))


def _snapshot(spark, sf, odd):
    o = _t(spark, sf, "orders").where(F.col("o_orderkey") % 2 == odd)
    return o.agg(F.count("*").alias("orders"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("filled"), F.sum((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("urgent"))


def k24_diff(spark, sf):
    return scoring.diff(_snapshot(spark, sf, 0), _snapshot(spark, sf, 1), ["orders", "filled", "urgent"])


def k25_first(spark, sf):
    return sets.first_by(_t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def k26_uncovered(spark, sf):
    return sets.uncovered(_t(spark, sf, "documents").select("doc_id", "source"), _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("hits")), ["doc_id"])


def k27_orphans(spark, sf):
    e = _numbered(spark, sf)
    return lines.orphans(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), 3, ["user_id"]).select("event_id", "user_id", "line")


def k28_overlap(spark, sf):
    p = _t(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.collect_set("p_type").alias("types"))
    return sets.overlap(p, "p_brand", "p_size", "types").where("ratio >= 0.5").select("p_brand", F.round("ratio", 6).alias("ratio"))


def k29_gates(spark, sf):
    s = _suppliers(spark, sf).withColumn("over", scoring.over_limit(F.col("returned"), F.col("items"), 0.35))
    return s.select("l_suppkey", "over", scoring.first_gate([("returns", F.col("over")), ("open", F.col("open") * 2 > F.col("items")), ("few", F.col("items") < 500)]).alias("gate"))


def k30_calibrate(spark, sf):
    return _t(spark, sf, "part").groupBy("p_brand").agg(scoring.calibrated(F.col("p_retailprice"), 2400).alias("limit"))


def entry_query(spark: SparkSession, sf: str) -> DataFrame:
    return graph.gradient(trade(spark, sf, 1), _degrees(spark, sf, 1)).select("src", "dst", F.round("src_metric", 6).alias("src_metric"), F.round("dst_metric", 6).alias("dst_metric"))


_G = """g AS (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity >= 49 AND l_discount >= 0.09 AND s_nationkey <> c_nationkey GROUP BY 1, 2 HAVING count(*) >= 2)"""
_DEG = """dg AS (SELECT n_nationkey AS node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.l, '') AS sources, coalesce(o.l, '') AS targets,
CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) > 0 THEN coalesce(o.n, 0) / (coalesce(i.n, 0) + coalesce(o.n, 0)) ELSE 0.0 END AS instability
FROM nation LEFT JOIN (SELECT dst, count(*) AS n, string_agg(src, ',' ORDER BY src) AS l FROM g GROUP BY dst) i ON dst = n_nationkey
LEFT JOIN (SELECT src, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS l FROM g GROUP BY src) o ON src = n_nationkey)"""
_L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_E = "e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events)"
_S = "s AS (SELECT l_suppkey, count(*) AS items, sum((l_returnflag = 'R')::INT) AS returned, sum((l_linestatus = 'O')::INT) AS open, max(l_quantity) AS largest FROM lineitem GROUP BY 1)"
_LAYER = "CASE WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE 'STANDARD%' THEN 'base' WHEN p_type LIKE 'MEDIUM%' OR p_type LIKE 'SMALL%' THEN 'middle' ELSE 'top' END"
_RANK = "CASE layer WHEN 'top' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END"

SQL = {
    "k1_scan": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES if t[0] <= "n"),
    "k2_markers": f"WITH {_L} SELECT doc_id, line, regexp_extract(trim(text), '^Licensed under (.*)$', 1) AS payload FROM l WHERE regexp_matches(trim(text), '^Licensed under (.*)$')",
    "k3_run_ends": f"WITH {_L}, k AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM l WHERE length(text) >= 40) SELECT doc_id, line, max(line) OVER (PARTITION BY doc_id, i) AS run_end FROM k",
    "k4_band": f"WITH {_E} SELECT event_id, user_id, line FROM e t WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e m WHERE m.event_type = 'error' AND m.user_id = t.user_id AND m.line <= t.line AND t.line - m.line <= 3)",
    "k5_outside": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)",
    "k5_inside": "WITH n AS (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_custkey IN (FROM n) OR c_nationkey IN (FROM n)",
    "k6_exact_groups": "SELECT doc_id, n AS group_size, g AS group_id FROM documents JOIN (SELECT text, count(*) AS n, min(doc_id) AS g FROM documents GROUP BY text HAVING count(*) > 1) USING (text)",
    "k7_near_dups": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)),
b AS (SELECT doc_id, w, len(w) AS n, floor(len(w) / 10) AS b FROM d WHERE len(w) > 0), k AS (SELECT b FROM b GROUP BY b HAVING count(*) BETWEEN 2 AND 50),
c AS (SELECT b, doc_id, n, t, count(*) AS c FROM (SELECT b, doc_id, n, unnest(w) AS t FROM b WHERE b IN (FROM k)) GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS i, any_value(x.n + y.n) AS n FROM c x JOIN c y ON x.b = y.b AND x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i / (n - i) >= 0.85""",
    "k8_fragments": f"""WITH {_L}, f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos, len(string_split(text, ' ')) AS size FROM l WHERE length(text) > 0),
w AS (SELECT * FROM (SELECT doc_id, pos, [text, lead(text) OVER o, lead(text, 2) OVER o] AS v, lead(pos, 2) OVER o AS z FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE z IS NOT NULL),
k AS (SELECT v FROM w GROUP BY v HAVING count(*) BETWEEN 2 AND 50),
p AS (SELECT x.doc_id AS seq_a, y.doc_id AS seq_b, x.pos AS a, y.pos AS b FROM w x JOIN w y ON x.v = y.v AND x.doc_id < y.doc_id WHERE x.v IN (FROM k)),
r AS (SELECT *, CASE WHEN a - lag(a) OVER o = 1 AND b - lag(b) OVER o = 1 THEN 0 ELSE 1 END AS new FROM p WINDOW o AS (PARTITION BY seq_a, seq_b ORDER BY a, b)),
q AS (SELECT *, sum(new) OVER (PARTITION BY seq_a, seq_b ORDER BY a, b) AS run FROM r),
g AS (SELECT seq_a, seq_b, min(a) AS start_a, min(b) AS start_b, count(*) + 2 AS "rows" FROM q GROUP BY seq_a, seq_b, run)
SELECT g.* FROM g WHERE (SELECT sum(size) FROM f WHERE doc_id = seq_a AND pos BETWEEN start_a AND start_a + "rows" - 1) >= 30""",
    "k9_degrees": f"WITH {_G}, {_DEG} SELECT node, fan_in, fan_out, round(instability, 6) AS instability, sources, targets FROM dg",
    "k10_gradient": f"WITH {_G}, {_DEG} SELECT src, dst, round(a.instability, 6) AS src_metric, round(b.instability, 6) AS dst_metric FROM g JOIN dg a ON a.node = src JOIN dg b ON b.node = dst WHERE a.instability < b.instability",
    "k11_cycles": f"WITH RECURSIVE {_G}, c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src), m AS (SELECT a.src AS node, a.dst AS other FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src) SELECT node, min(least(node, other)) AS component FROM m GROUP BY node HAVING count(DISTINCT other) > 1",
    "k12_components": "WITH RECURSIVE l AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09 AND l_tax >= 0.07), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS node, min(least(a, b)) AS component FROM c GROUP BY a",
    "k13_reach": f"WITH RECURSIVE {_G}, c AS (SELECT src AS start, dst AS node, 1 AS hops FROM g UNION SELECT c.start, g.dst, hops + 1 FROM c JOIN g ON c.node = g.src WHERE hops < 3) SELECT start, node, min(hops) AS hops FROM c WHERE start <> node GROUP BY 1, 2",
    "k14_closure": f"WITH RECURSIVE {_G}, c AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION SELECT dst FROM c JOIN g ON node = src) SELECT node FROM c",
    "k15_settle": f"WITH RECURSIVE {_G}, r AS (SELECT c_nationkey AS node, avg(c_acctbal) < 4400 AS bad FROM customer GROUP BY 1), e AS (SELECT src, dst FROM g JOIN r a ON src = a.node AND a.bad JOIN r b ON dst = b.node AND b.bad), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), o AS (SELECT DISTINCT src AS node FROM c WHERE src = dst), h AS (SELECT node FROM o UNION SELECT c.src FROM c JOIN o ON c.dst = o.node) SELECT node, bad AND node IN (FROM h) AS bad FROM r",
    "k16_flags": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{r}' AS rule_id, {c}::DOUBLE AS value, {m}::DOUBLE AS \"limit\" FROM lineitem WHERE {c} > {m}" for r, c, m in (("quantity", "l_quantity", 49), ("price", "l_extendedprice", 90000), ("discount", "l_discount", 0.09), ("tax", "l_tax", 0.07))),
    "k17_composite": f"WITH {_S}, x AS (SELECT l_suppkey, 0.5::DOUBLE * least(returned / items / 0.4::DOUBLE, 1) + 0.3::DOUBLE * least(open / items / 0.6::DOUBLE, 1) + 0.2::DOUBLE * least(largest / 50, 1) AS score, CASE WHEN returned = 0 THEN 0 ELSE 1 END::DOUBLE AS unlimited FROM s) SELECT l_suppkey, round(score, 6) AS score, unlimited FROM x WHERE score >= 0.5",
    "k18_ramp": "SELECT p_partkey, round(CASE WHEN p_retailprice <= 1000 THEN 0.0 WHEN p_retailprice >= 1800 THEN 1.0 ELSE (p_retailprice - 1000) / 800 END, 6)::DOUBLE AS ramp, 1.0::DOUBLE AS inverted FROM part",
    "k19_single": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
    "k20_layers": f"SELECT p_type, {_LAYER} AS layer, count(*) AS n FROM part GROUP BY 1, 2",
    "k20_rank_violations": f"WITH n AS (SELECT p_partkey, {_LAYER} AS layer FROM part), r AS (SELECT *, {_RANK} AS rank FROM n) SELECT a.p_partkey AS src, b.p_partkey AS dst, a.layer AS src_layer, b.layer AS dst_layer FROM r a JOIN r b ON b.p_partkey = a.p_partkey + 1 WHERE b.rank > a.rank",
    "k21_scope": "SELECT page_id, url FROM pages WHERE contains(url, '/en/') AND NOT contains(url, 'blog.') AND NOT contains(url, '?')",
    "k22_candidates": "WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS s FROM pages), c AS (SELECT page_id, s[1] AS host, unnest(list_transform(range(1, len(s) + 1), lambda k: array_to_string(s[1:k], '/'))) AS x FROM p) SELECT page_id, host FROM c GROUP BY 1, 2 HAVING bool_or(contains(x, 'example.com')) AND NOT bool_or(x LIKE '%/de')",
    "k23_score": "WITH c AS (SELECT count(*) AS total, sum((o_orderstatus IN ('F', 'O'))::INT) AS fo, sum((o_orderstatus = 'P')::INT) AS p, sum((o_totalprice > 300000)::INT) AS dear FROM orders), s AS (SELECT fo / total AS a, 1 - least(p / greatest(total, 1), 1) AS b, 1 - least(dear / greatest(total, 1), 1) AS c FROM c) SELECT round(greatest(0, least(1, 1 - 3 * (1 - (a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE)))), 6)::DOUBLE AS score, greatest(0, least(1, 1 - 1 * (1 - 0)))::DOUBLE AS unweighted, round(a, 6) AS score_0, round(b, 6) AS score_1, round(c, 6) AS score_2 FROM s",
    "k24_diff": "WITH c AS (SELECT o_orderkey % 2 AS odd, unnest(['orders', 'filled', 'urgent']) AS counter, unnest([1, (o_orderstatus = 'F')::INT, (o_orderpriority = '1-URGENT')::INT])::DOUBLE AS v FROM orders), s AS (SELECT counter, sum(CASE WHEN odd = 0 THEN v ELSE 0 END) AS old, sum(CASE WHEN odd = 1 THEN v ELSE 0 END) AS new FROM c GROUP BY 1) SELECT counter, old, new, new - old AS delta FROM s",
    "k25_first": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "k26_uncovered": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "k27_orphans": f"WITH {_E} SELECT event_id, user_id, line FROM e m WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e t WHERE t.event_type = 'purchase' AND m.user_id = t.user_id AND m.line <= t.line AND t.line - m.line <= 3)",
    "k28_overlap": "WITH s AS (SELECT p_brand, p_size, list_distinct(list(p_type)) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part GROUP BY 1, 2) SELECT a.p_brand, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS ratio FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.k = 1 AND b.k = 2 WHERE len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5",
    "k29_gates": f"WITH {_S} SELECT l_suppkey, returned / items > 0.35::DOUBLE AS over, CASE WHEN returned / items > 0.35::DOUBLE THEN 'returns' WHEN open * 2 > items THEN 'open' WHEN items < 500 THEN 'few' END AS gate FROM s",
    "k30_calibrate": "SELECT p_brand, greatest(ceil(max(p_retailprice) * 1.2::DOUBLE), 2400)::DOUBLE AS \"limit\" FROM part GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
