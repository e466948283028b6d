import json

from pyspark.sql import functions as F

from factweave.plans import findings as fd
from factweave.plans import sinks
from factweave.sources import lcov, markers
from factweave.streaming import watch

SOURCE = """fn a() {}
// qual:allow(srp, typo) reason: "why so"
// more words
fn b() {}
  // qual:allow
// qual:allow(unsafe)
// qual:allow(typo) plain reason
// iosp:allow old
// qual:api
// goes on
fn c() {}
// qual:recursive
// qual:inverse(decode)
// qual:inverse( )
//! qual:allow(coupling)
// qual:test_helper x"""


def files(spark):
    return spark.createDataFrame([("f.rs", SOURCE), ("g.rs", None)], "path string, content string")


def test_marker_grammar(spark):
    got = sorted(((r.line, r.dims, r.reason) for r in markers.suppressions(files(spark)).collect()), key=str)
    assert got == sorted([(3, ["srp"], "why so"), (10, [], None), (10, [], "plain reason"), (10, ["iosp"], "old")], key=str)
    plain = lambda k: [r.line for r in markers.plain_markers(files(spark), k).collect()]
    assert plain("api") == [10] and plain("recursive") == [12] and plain("unsafe") == [6] and plain("test_helper") == [16]
    assert [(r.line, r.target) for r in markers.inverse_markers(files(spark)).collect()] == [(13, "decode")]


def all_findings(spark):
    x = spark.createDataFrame([("f.rs", 4), ("f.rs", 9), ("f.rs", 10), ("", 0)], "file string, line long")
    return fd.union([fd.finding(x, "srp", "SRP-001", F.concat(F.lit("at "), "line")), fd.finding(x.limit(1), "architecture", "ARCH", F.lit('say "no"\nplease'), "high")])


def test_suppression_orphans_and_scores(spark):
    m = spark.createDataFrame([("f.rs", 4, ["srp"], None), ("f.rs", 40, [], None), ("f.rs", 50, ["coupling"], None), ("f.rs", 60, ["iosp"], None)], "file string, line long, dims array<string>, reason string")
    f = fd.suppress(all_findings(spark), m)
    assert sorted((r.dimension, r.line, r.suppressed) for r in f.collect()) == [("architecture", 4, True), ("srp", 0, False), ("srp", 4, True), ("srp", 9, True), ("srp", 10, False)]
    assert sorted(r.line for r in fd.orphan_markers(m, f).collect()) == [60]
    assert [tuple(r) for r in fd.counters(f).collect()] == [("srp", "SRP-001", 2)]
    s = fd.scores(f, 10, {"integration": 1, "operation": 1, "violation": 2}).first()
    assert s.iosp_score == 0.5 and s.srp_score == 0.8 and s.dry_score == 1 and abs(s.quality_score - max(0, 1 - 7 * (0.22 * 0.5 + 0.18 * 0.2))) < 1e-9


def test_sinks(spark, tmp_path):
    f = all_findings(spark)
    assert "f.rs:9 [SRP-001] at 9" in [r.value for r in sinks.text_lines(f).collect()]
    assert '::error file=f.rs,line=4::say "no" please' in [r.value for r in sinks.annotations(f).collect()]
    doc = json.loads(sinks.sarif(f))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 5 and {r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]} == {"ARCH", "SRP-001"}
    n = spark.createDataFrame([("a", 'q"x', "red")], "name string, label string, color string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r.value for r in sinks.dot(n, e).collect()] == ["digraph facts {", '  "a" [label="q\\"x", color="red"];', '  "a" -> "b";', "}"]
    assert {r.file: r.n for r in sinks.grouped(f).collect()} == {"f.rs": 4, "<project>": 1}
    assert json.loads(sinks.json_lines(f).first().value)["dimension"] == "srp"
    s = spark.createDataFrame([(0.9, 0.5)], "quality_score double, iosp_score double")
    sinks.save_baseline(s, f"{tmp_path}/base")
    back = spark.read.json(f"{tmp_path}/base")
    assert back.first().version == 2 and not sinks.regressed(back, s) and sinks.regressed(back, s.withColumn("quality_score", F.lit(0.8)))
    assert sinks.regressed(s.withColumn("quality_score", F.lit(None).cast("double")), s.withColumn("iosp_score", F.lit(0.4)))


def test_lcov(spark):
    text = "SF:a.rs\nFNDA:3,f\nFNDA:x,g\nDA:1,0\nDA:2,5\nDA:bad\nend_of_record\nDA:9,9\nSF:b.rs\nFNDA:0,h\nSF:a.rs\nDA:1,7\n"
    fn, at = lcov.parse(spark.createDataFrame([("x.info", text)], "path string, content string"))
    assert sorted(tuple(r) for r in fn.collect()) == [("b.rs", "h", 0)] and sorted(tuple(r) for r in at.collect()) == [("a.rs", 1, 7)]


def test_streams(spark, tmp_path):
    src, seen = tmp_path / "src", []
    src.mkdir()
    (src / "a.rs").write_text("one\ntwo")
    q = watch.watch(spark, str(src), lambda df, n: seen.extend((r.path.rpartition("/")[2], r.content) for r in df.collect()), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        (src / "b.rs").write_text("new")
        (src / "c.txt").write_text("no")
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [("a.rs", "one\ntwo"), ("b.rs", "new")]
    ev = spark.sql("select u as user_id, cast(t as timestamp_ntz) as ts from values (1,'2024-01-01 00:00:00'),(1,'2024-01-01 01:00:00'),(1,'2024-01-03 00:00:00'),(2,'2024-01-01 00:00:00') as v(u,t)")
    assert sorted((r.user_id, r.n) for r in watch.bursts(ev).collect()) == [(1, 1), (1, 2), (2, 1)]
    ev.write.parquet(f"{tmp_path}/ev")
    stream = watch.event_stream(spark, f"{tmp_path}/ev", ev.schema)
    q = watch.bursts(stream).writeStream.format("memory").queryName("bursts_t").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r.user_id, r.n) for r in spark.table("bursts_t").collect()) == [(1, 1), (1, 2), (2, 1)]
    finally:
        q.stop()
