"""Registered queries of the code rules. The driver's tables hold no sources, so each rule runs over a small project of its own.

The SQL lists the rows that the rule's definition gives, worked out by hand from the sources below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans import architecture, boilerplate, code_rules, duplicates, functions, responsibility, structure, testing
from factweave.plans.findings import scores
from factweave.sources.markers import plain_markers

CLASSES = """fn leaf(x: u32) -> u32 { if x > 1 { x + 1 } else { x } }
fn glue() { leaf(1); other(); }
fn other() { leaf(2) }
fn both(x: u32) -> u32 { if x > 1 { tangled(x) } else { leaf(x) } }
fn tangled(x: u32) -> u32 { while x > 0 { both(x); } x }
fn calm(x: u32) -> u32 { if x > 2 { leaf(x) } else { 0 } }
fn chain(x: u32) -> u32 { if x > 3 { calm(x) } else { 1 } }
fn empty() {}
fn hidden(v: Vec<u32>) -> Vec<u32> { v.into_iter().map(|x| if x > 1 { leaf(x) } else { x }).collect() }
fn passes(v: Vec<u32>) { for x in v { leaf(x); } }
struct S { n: u32 }
impl S { fn n(&self) -> u32 { self.n }
    fn twice(&self) -> u32 { self.n() + self.n() }
    fn go(&self, o: &S) -> u32 { match self.twice() { 0 => o.twice(), _ => S::make(1) } }
    fn make(n: u32) -> u32 { n } }
"""
LIMITS = """fn deep(a: u32, b: u32) -> u32 {
    if a > 7 && b > 1 || a == b {
        for i in 0..a {
            while b > i {
                match b {
                    1 => { if a > b { return 9; } }
                    _ => { call(); extra(); }
                }
            }
        }
    }
    unsafe { raw() }
    a.unwrap()
}
// qual:allow(unsafe)
fn careful() { if x() { unsafe { raw() } } }
#[test]
fn t() { if y() { z.unwrap(); } let q = 55; }
"""


def _sum(name: str, last: str) -> str:
    return f"fn {name}(a: u32) -> u32 {{\n    let b = a + 1;\n    let c = b * 2;\n    let d = c - 3;\n    let e = d / 4;\n    let f = e + b;\n    f {last} c\n}}\n"


_SHARED = "".join(f"    let {x} = f1(a, 1) {o} f2(a, 2) {o} f3(a, 3);\n" for x, o in zip("bcde", "+-*/", strict=True))
COPIES = _sum("one", "+") + _sum("two", "+").replace("b", "x") + _sum("three", "-") + _sum("four", "*") + f"fn five(a: u32) -> u32 {{\n{_SHARED}    return a;\n}}\nfn six(a: u32) {{\n    let z = 1;\n{_SHARED}}}\n"
DEAD = """fn main() { used(1); list.map(by_ref); }
fn used(n: u32) -> u32 { n }
fn by_ref(n: u32) -> u32 { n }
fn never() {}
fn only_tests() {}
#[allow(dead_code)] fn kept() {}
// qual:api
pub fn api() {}
#[cfg(test)]
mod tests {
    #[test]
    fn t() { super::only_tests(); assert!(super::used(2) > 1); }
}
"""
SHAPES = """pub struct S { a: u32, b: u32 }
impl S {
    fn selfless(&self) -> u32 { other() }
    fn needless(&mut self) -> u32 { self.a + 1 }
    fn fine(&mut self) { self.a = 2; }
    fn stub(&self) { todo!() }
    fn cast(&self) { self.x.downcast_ref::<u8>(); }
}
trait One { fn go(&self); }
impl One for S { fn go(&self) { unimplemented!() } }
pub trait Two { fn go(&self); }
impl Two for S { fn go(&self) { panic!("not implemented yet") } }
pub fn e1() -> Result<u8, std::io::Error> { x() }
pub fn e2() -> Result<u8, Other> { x() }
"""
TESTS = """pub fn work(n: u32) -> u32 { step(n) }
fn step(n: u32) -> u32 { n }
fn lonely(n: u32) -> u32 { n }
pub fn caller() { lonely(1); }
#[cfg(test)]
mod tests {
    #[test]
    fn silent() { let x = 1; }
    #[test]
    fn aimless() { assert!(1 + 1 == 2); }
    #[test]
    fn good() { assert_eq!(super::work(1), 1); }
    #[test]
    #[should_panic]
    fn panics() { panic!("x") }
}
"""
_LETS = "{ let a = 1; let b = 2; let c = 3; let d = 4; let e = 5; }"
GROUPS = f"""pub struct Big {{ a: u8, b: u8, c: u8 }}
impl Big {{
    fn ga(&self) -> u8 {{ self.a }}
    fn gb(&self) -> u8 {{ self.b }}
    fn gc(&self) -> u8 {{ one(); two(); three(); four(); five(); six(); seven(); eight(); nine(); ten(); self.c }}
}}
fn many(a: u8, b: u8, c: u8, d: u8, e: u8, f: u8) {{}}
fn p1() {_LETS}
fn p2() {_LETS}
fn p3() {_LETS}
fn p4() {_LETS}
fn ties() {{ p1(); p2(); }}
"""
_MATCH = "match x { E::A => 1, E::B(_) => 2, E::C { .. } => 3 }"
PATTERNS = f"""impl From<u8> for Wrap {{ fn from(v: u8) -> Self {{ Wrap(v) }} }}
impl From<u16> for Wrap {{ fn from(v: u16) -> Self {{ Wrap {{ v }} }} }}
impl From<u32> for Wrap {{ fn from(v: u32) -> Self {{ Wrap(v as u8) }} }}
impl fmt::Display for Wrap {{ fn fmt(&self, f: &mut F) -> R {{ write!(f, "{{}}", self.0) }} }}
impl Acc {{
    fn a(&self) -> u8 {{ self.a }}
    fn b(&self) -> &u8 {{ &self.b }}
    fn set(&mut self, v: u8) {{ self.a = v; }}
    fn other(&self) -> u8 {{ self.a + 1 }}
}}
impl Two {{ fn a(&self) -> u8 {{ self.a }} fn b(&self) -> u8 {{ self.b }} }}
impl Build {{
    fn a(mut self, v: u8) -> Self {{ self.a = v; self }}
    fn b(mut self, v: u8) -> Self {{ self.b = v; self }}
    fn c(mut self, v: u8) -> Self {{ self.c = v; self }}
}}
impl Default for Acc {{ fn default() -> Self {{ Acc {{ a: 0, b: None, c: String::new(), d: vec![], e: "" }} }} }}
impl Default for Two {{ fn default() -> Self {{ Two {{ a: 1, b: 0 }} }} }}
fn maps(x: E) -> F {{ match x {{ E::A => F::A, E::B => F::B, E::C(_) => f(), E::D {{ .. }} => F::D }} }}
fn fmt(x: E) -> F {{ match x {{ E::A => F::A, E::B => F::B, E::C => F::C, E::D => F::D }} }}
fn clones(o: &O) -> P {{ P {{ a: o.a.clone(), b: o.b.clone(), c: o.c.clone() }} }}
fn twice() {{ let p = Q {{ a: 1, b: 2, c: 3 }}; let q = Q {{ a: 1, b: 2, d: 4 }}; }}
fn prints() {{ println!("same {{}}", 1); println!("same {{}}", 2); println!("{{}}", 3); println!("{{}}", 4); println!("{{}}", 5); }}
fn more() {{ eprintln!("same {{}}", 3); }}
fn m1(x: E) -> u8 {{ {_MATCH} }}
fn m2(y: E) -> u8 {{ {_MATCH.replace("x", "y")} }}
fn m3(z: E) -> u8 {{ let r = {_MATCH.replace("x", "z")}; r }}
fn m4(x: E) -> u8 {{ match x {{ E::A => 1, _ => 2 }} }}
"""
LAYERED = [
    ("src/domain/x.rs", "use crate::app::run;\nuse serde::Value;\nuse std::fmt;"), ("src/app/mod.rs", "use crate::domain::x::X;"), ("src/domain/mod.rs", "mod x;"),
    ("src/cli/a.rs", "use crate::db::raw::Q;\nuse crate::db::api::Z;\nuse super::super::db::raw::W;\nuse crate::app::*;"), ("src/db/raw.rs", ""), ("src/db/api.rs", ""),
]
CYCLE = [("src/a/mod.rs", "use crate::b::X;"), ("src/b.rs", "use crate::a::Y;\nuse crate::c::*;"), ("src/c.rs", "")]
MODULES = [("src/lib.rs", "mod a;\n#[cfg(test)]\nmod checks;\nmod self_test;"), ("src/a.rs", "mod deep;"), ("src/a/deep.rs", ""), ("src/checks/mod.rs", "mod more;"), ("src/checks/more.rs", ""), ("src/self_test.rs", "#![cfg(test)]"), ("tests/all.rs", "")]


def _files(spark: SparkSession, sources: list | str) -> DataFrame:
    return spark.createDataFrame([("src/a.rs", sources)] if isinstance(sources, str) else sources, "path string, content string")


def _places(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "file", "line")


def r_classification(spark, sf):
    t = code_rules.tables(_files(spark, CLASSES))
    return functions.classify(t["function"], t["type"]).select("name", "class", "severity", "effort")


def r_complexity(spark, sf):
    files = _files(spark, LIMITS)
    t = code_rules.tables(files)
    return _places(functions.complexity(functions.classify(t["function"], t["type"]), unsafe=plain_markers(files, "unsafe")))


def r_duplicates(spark, sf):
    return _places(duplicates.duplicates(code_rules.tables(_files(spark, COPIES))["function"]))


def r_fragments(spark, sf):
    return _places(duplicates.fragments(code_rules.tables(_files(spark, COPIES))["function"]))


def _marked(files, t):
    return duplicates.with_markers(t["function"], plain_markers(files, "api"), plain_markers(files, "test_helper"))


def r_boilerplate(spark, sf):
    return _places(boilerplate.boilerplate(code_rules.tables(_files(spark, PATTERNS))["function"]))


def r_repeated_matches(spark, sf):
    return _places(boilerplate.repeated_matches(code_rules.tables(_files(spark, PATTERNS))["function"]))


def r_dead_code(spark, sf):
    files = _files(spark, DEAD)
    t = code_rules.tables(files)
    return duplicates.uncalled(_marked(files, t), t["import"]).select("name", "line", "why")


def r_structural(spark, sf):
    t = code_rules.tables(_files(spark, [("src/a.rs", SHAPES), ("src/b/mod.rs", "impl crate::a::S { fn far(&self) -> u32 { self.b } }")]))
    return _places(structure.checks(t["function"], t["type"], t["impl"]))


def r_tests(spark, sf):
    files = _files(spark, TESTS)
    t = code_rules.tables(files)
    return _places(testing.silent(t["function"]).unionByName(testing.aimless(t["function"], t["type"])).unionByName(testing.untested(_marked(files, t), t["import"])))


def r_coverage(spark, sf):
    t = code_rules.tables(_files(spark, CLASSES))
    by_function = spark.createDataFrame([("src/a.rs", "leaf", 0), ("src/a.rs", "glue", 2)], "file string, name string, hits long")
    by_line = spark.createDataFrame([("src/a.rs", 5, 0), ("src/a.rs", 6, 3)], "file string, line long, hits long")
    return _places(testing.uncovered(functions.classify(t["function"], t["type"]), by_function, by_line))


def r_cohesion(spark, sf):
    t = code_rules.tables(_files(spark, GROUPS))
    return responsibility.cohesion(t["function"], t["type"]).select("name", "lcom4", "fields", "methods", "fan_out", F.round("score", 6).alias("score"))


def r_responsibility(spark, sf):
    t = code_rules.tables(_files(spark, GROUPS))
    c = functions.classify(t["function"], t["type"])
    return _places(responsibility.structs(t["function"], t["type"]).unionByName(responsibility.modules(t["source"], t["function"], c, t["tests"])).unionByName(code_rules.signatures(t["function"])))


LAYERS = architecture.Layers(("domain", "app"), {"domain": ("src/domain/**",), "app": ("src/app/**",)}, {"serde": "app"})


def r_layers(spark, sf):
    files = _files(spark, LAYERED)
    return _places(architecture.layer_violations(files, code_rules.tables(files)["import"], LAYERS))


def r_forbidden(spark, sf):
    files = _files(spark, LAYERED)
    i = code_rules.tables(files)["import"]
    return _places(architecture.forbidden(i, "src/cli/**", "src/db/*", ("src/db/api*",)))


def r_patterns(spark, sf):
    t = code_rules.tables(_files(spark, [*LAYERED, ("src/app/m.rs", LIMITS)]))
    f = t["function"]
    found = architecture.glob_imports(t["import"], "GLOB", forbid=["src/cli/**"])
    found = found.unionByName(architecture.calls(f, "method", ["unwrap"], "UNWRAP", allow=["src/cli/**"])).unionByName(architecture.calls(f, "path", ["extra"], "EXTRA", forbid=["src/app/**"]))
    return _places(found.unionByName(architecture.calls(f, "path", ["extra"], "OFF", allow=["x"], forbid=["src/app/**"])))


def r_coupling(spark, sf):
    files = _files(spark, CYCLE)
    t = code_rules.tables(files)
    return code_rules.coupling(files, t["import"]).select("rule_id", "message")


def r_test_files(spark, sf):
    files = _files(spark, MODULES)
    return code_rules.tables(files)["tests"]


def r_summary(spark, sf):
    files = _files(spark, LIMITS)
    t = code_rules.tables(files)
    found = functions.complexity(functions.classify(t["function"], t["type"]), unsafe=plain_markers(files, "unsafe"))
    cycles = code_rules.coupling(_files(spark, CYCLE), code_rules.tables(_files(spark, CYCLE))["import"])
    s = scores(found.unionByName(cycles), 40, {"operation": 3, "violation": 1})
    return s.select(*(F.round(c, 6).alias(c) for c in ("iosp_score", "complexity_score", "coupling_score", "quality_score")), "total_findings")


def _values(columns: str, rows: list[tuple]) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else f"{x}::BIGINT"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _found(*rows: tuple[str, int], file: str = "src/a.rs") -> str:
    return _values("rule_id, file, line", [(r, f[0] if f else file, n) for r, n, *f in rows])


SQL = {
    "r_classification": _values("name, class, severity, effort", [
        ("leaf", "operation", None, None), ("glue", "integration", None, None), ("other", "integration", None, None), ("both", "violation", "medium", 7.0), ("tangled", "violation", "medium", 5.5),
        ("calm", "operation", None, None), ("chain", "operation", None, None), ("empty", "trivial", None, None), ("hidden", "trivial", None, None), ("passes", "integration", None, None),
        ("n", "trivial", None, None), ("twice", "operation", None, None), ("go", "integration", None, None), ("make", "trivial", None, None)]),
    "r_complexity": _found(("CX-001", 1), ("CX-005", 1), ("CX-003", 2), ("CX-003", 6), ("CX-006", 1), ("A20", 1)),
    "r_duplicates": _found(("DRY-001", 1), ("DRY-001", 9), ("DRY-001", 17), ("DRY-001", 25)),
    "r_fragments": _found(("DRY-003", 34), ("DRY-003", 42)),
    "r_boilerplate": _found(("BP-001", 1), ("BP-001", 2), ("BP-007", 1), ("BP-002", 4), ("BP-003", 6), ("BP-003", 7), ("BP-003", 8), ("BP-004", 12), ("BP-005", 17), ("BP-006", 19), ("BP-008", 21), ("BP-009", 22), ("BP-010", 23)),
    "r_repeated_matches": _found(("DRY-005", 25), ("DRY-005", 26), ("DRY-005", 27)),
    "r_dead_code": _values("name, line, why", [("never", 4, "uncalled"), ("only_tests", 5, "test_only")]),
    "r_structural": _found(("SLM", 3), ("NMS", 4), ("BTC", 10), ("BTC", 12), ("DEH", 7), ("SIT", 9), ("IET", 1), ("OI", 1, "src/b/mod.rs")),
    "r_tests": _found(("TQ-001", 8), ("TQ-002", 8), ("TQ-002", 10), ("TQ-002", 15), ("TQ-003", 3)),
    "r_coverage": _found(("TQ-004", 1), ("TQ-005", 5)),
    "r_cohesion": _values("name, lcom4, fields, methods, fan_out, score", [("Big", 3, 3, 3, 10, 0.685)]),
    "r_responsibility": _found(("SRP-001", 1), ("SRP-002", 1), ("SRP-003", 7)),
    "r_layers": _found(("ARCH-LAYER", 1, "src/domain/x.rs"), ("ARCH-LAYER", 2, "src/domain/x.rs")),
    "r_forbidden": _found(("ARCH-FORBIDDEN", 1), ("ARCH-FORBIDDEN", 3), file="src/cli/a.rs"),
    "r_patterns": _found(("ARCH-GLOB", 4, "src/cli/a.rs"), ("ARCH-UNWRAP", 13), ("ARCH-UNWRAP", 18), ("ARCH-EXTRA", 7), file="src/app/m.rs"),
    "r_coupling": _values("rule_id, message", [("CP-000", "module a: in 1, out 1, instability 0.50"), ("CP-001", "cycle of modules a, b"), ("CP-002", "a (0.50) depends on less stable b (0.67)")][1:]),
    "r_test_files": _values("file", [("src/checks/mod.rs",), ("src/checks/more.rs",), ("src/self_test.rs",), ("tests/all.rs",)]),
    # six counted findings of 40 functions (CX-001 and CX-005 are two); a cycle counts twice beside one steep edge
    "r_summary": "WITH s AS (SELECT 3 / 4 AS a, 1 - 6 / 40 AS b, 1 - 3 / 40 AS c) SELECT round(a, 6) AS iosp_score, round(b, 6) AS complexity_score, round(c, 6) AS coupling_score, round(greatest(0, 1 - 7 * (1 - (0.22::DOUBLE * a + 0.18::DOUBLE * b + 0.13::DOUBLE + 0.18::DOUBLE + 0.09::DOUBLE * c + 0.1::DOUBLE + 0.1::DOUBLE))), 6)::DOUBLE AS quality_score, 8::BIGINT AS total_findings FROM s",
}

QUERIES = {name: globals()[name] for name in SQL}
