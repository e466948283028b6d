import pytest
from pyspark.sql import functions as F

from factweave.frontend import items, lexer, syntax
from factweave.plans import code_rules, config

CODE = r'''
//! docs
use crate::{a::{self, X as Y}, b::*, r#type};
pub use crate::c::Z;
const N: usize = 3; static S: &str = "fn no() {"; /* fn x() { /* nested */ } */
#[derive(Debug)] pub(crate) struct P<'a> { f: &'a str }
struct T(u8);
impl<'a, T: Into<Vec<u8>>> P<'a> { pub async unsafe fn m(&mut self, a: u8, (b, c): (u8, u8)) -> char { '\'' } }
impl std::fmt::Display for crate::x::Q { fn fmt(&self, f: &mut F<A, B>) -> R { r#"}"# ; Ok(()) } }
trait Tr { fn d(&self); fn e() { } }
macro_rules! mm { ($x:expr) => { fn hidden() {} } }
#[cfg(test)]
mod tests { use super::*; use super::deep::*; #[test] fn t() {} mod inner { fn u() { let x = b'{'; } } }
mod other;
extern "C" fn ext(a: i32) {}
const fn k() -> [u8; 2] { [0; 2] }
'''


def test_items():
    got = list(items.items("src/m.rs", CODE))
    imports = {("::".join(r["segments"]), r["kind"], r["public"]) for k, r in got if k == "import"}
    assert imports == {("crate::a::self", "name", ""), ("crate::a::X", "rename", ""), ("crate::b", "glob", ""), ("crate::type", "name", ""), ("crate::c::Z", "name", "pub"), ("super", "glob", ""), ("super::deep", "glob", "")}
    fns = {r["name"]: r for k, r in got if k == "function"}
    assert set(fns) == {"m", "fmt", "d", "e", "t", "u", "ext", "k"}
    assert (fns["m"]["parent_type"], fns["m"]["parameter_count"], fns["m"]["has_self"], fns["m"]["public"]) == ("P", 2, True, "pub")
    assert (fns["fmt"]["parent_type"], fns["fmt"]["is_trait_impl"], fns["fmt"]["parameter_count"]) == ("Q", True, 1)
    assert fns["t"]["is_test"] and fns["u"]["is_test"] and not fns["d"]["has_body"] and fns["d"]["parent_type"] == "Tr"
    assert [r["module"] for k, r in got if k == "module"] == [["tests"], ["other"], ["tests", "inner"]]


def test_lexer_errors():
    for bad in ("/* x", "fn a() { ", "fn a() ) {"):
        with pytest.raises((lexer.SourceError, RuntimeError, StopIteration)):
            list(items.items("x", bad))
    assert [t.kind for t in lexer.tokens("'a 'b' 1.5e3 1..2 b\"\\\"\" r##\"\"#\"## x")] == ["life", "char", "num", "num", "op", "num", "str", "str", "id"]


def test_findings(spark):
    body = "\n".join("    let a = 1 + 1;" for _ in range(61))
    src = [
        ("src/a/mod.rs", "use crate::b::X;\nfn ok() {}"),
        ("src/b.rs", "use crate::a::Y;\nuse crate::c::*;\nfn w(a: u8, b: u8, c: u8, d: u8, e: u8, f: u8) {}"),
        ("src/c.rs", f"// qual:allow(complexity)\nfn long() {{\n{body}\n}}\nfn long2() {{\n{body}\n}}"),
        ("src/d.rs", "fn broken( {"),
        ("src/e.rs", None),
    ]
    files = spark.createDataFrame(src, "path string, content string").repartition(2)
    f = code_rules.analyse(files)
    got = sorted((r.rule_id, r.file, r.line, r.suppressed) for r in f.where("rule_id in ('CX-004', 'DRY-004', 'SRP-003')").collect())
    assert got == [("CX-004", "src/c.rs", 2, True), ("CX-004", "src/c.rs", 65, False), ("DRY-004", "src/b.rs", 2, False), ("SRP-003", "src/b.rs", 3, False)]
    assert [r.message for r in f.where("rule_id = 'CP-001'").collect()] == ["cycle of modules a, b"]
    assert sorted((r.file, r.line) for r in f.where("rule_id = 'DRY-001'").collect()) == [("src/c.rs", 2), ("src/c.rs", 65)]
    assert sorted(r.line for r in f.where("rule_id = 'DRY-002' and file = 'src/c.rs'").collect()) == [2, 65]
    nodes, edges = code_rules.module_graph(files, items.of_kind(items.facts(files), "import"))
    assert sorted(tuple(r) for r in edges.select("src", "dst").collect()) == [("a", "b"), ("b", "a"), ("b", "c")]
    assert items.of_kind(items.facts(files), "error").select("file").collect() == [("src/d.rs",)]
    assert sorted(r.m for r in spark.createDataFrame([("src/x/y.rs",), ("main.rs",), ("src\\q.rs",)], "p string").select(code_rules.module_of(F.col("p")).alias("m")).collect()) == ["main", "q", "x"]


def tree(source):
    toks = lexer.tokens(source)
    return syntax.body(toks, next(i for i, t in enumerate(toks) if t.text == "{"))


def shape(n):
    own = {"binary": "op", "unary": "op", "method": "name", "field": "name", "lit": "text", "compound": "op"}.get(n.kind)
    head = "::".join(n.path) if n.kind == "path" else n.kind + (f":{n.v[own]}" if own else "")
    return f"{head}({' '.join(map(shape, n.kids))})" if n.kids else head


@pytest.mark.parametrize(
    "source, want",
    [
        ("a + b * c - d", "binary:-(binary:+(a binary:*(b c)) d)"),
        ("a = b && c || !d == e", "assign(a binary:||(binary:&&(b c) binary:==(unary:!(d) e)))"),
        ("x as u32 + 1 << 2", "binary:<<(binary:+(cast(x) lit:1) lit:2)"),
        ("x.f::<Vec<Vec<u8>>>(1).0.1?.await", "await(try(field:1(field:0(method:f(x lit:1)))))"),
        ("|a, (b, _): (u8, u8)| -> u8 { a }", "closure(p_name p_tuple(p_name p_wild) block(expr(a)))"),
        ("S { a, b: 1, ..c() }", "struct(a lit:1 call(c))"),
        ("if let Some(x) = y && z { 1 } else if w { 2 } else { 3 }", "if(binary:&&(cond_let(p_call(p_name) y) z) block(expr(lit:1)) if(w block(expr(lit:2)) block(expr(lit:3))))"),
        ("&mut *p", "ref(unary:*(p))"),
        ("<T as Tr<u8>>::go(-1)", "call(go unary:-(lit:1))"),
        ("'a: loop { break 'a; }", "loop(block(expr(break)))"),
        ("a[i..].len() > 1..2", "range(binary:>(method:len(index(a range(i))) lit:1) lit:2)"),
        ("return", "return"),
    ],
)
def test_expressions(source, want):
    (s,) = tree("{ %s }" % source).kids
    assert shape(s.kids[0]) == want


def test_statements():
    kinds = [s.kind for s in tree("{ let Some(x) = y else { return }; const N: u8 = 7; fn f<T>(a: T) -> u8 { 1 } if a { b } match c { 1 | 2 if d => {} S { x, .. } => e, _ => f!{}, } use z::w; g!(1, 2); ; h }").kids]
    assert kinds == ["let", "item_const", "item_fn", "expr", "expr", "item", "expr", "expr"]
    for bad in ("{ a b }", "{ let = 1; }", "{ match x { 1 } }", "{ f(1 2) }"):
        with pytest.raises(lexer.SourceError):
            tree(bad)


def facts_of(source):
    return {r["name"]: r for k, r in items.items("src/a.rs", source) if k == "function"}


def test_body_facts():
    f = facts_of("impl T { fn m(&self, o: &mut p::Q<u8>, (a, b): (u8, u8), n: u8) -> Result<Self, E> { let x = [0x1F, 1_000, 2.5f32, v[9]]; o.go(); n.x(); async { y.unwrap(); if a {} }; matches!(self, Z) } }")["m"]
    b = f["body"]
    assert [n["value"] for n in b["numbers"]] == ["31", "1000", "2.5"] and b["n_unwrap"] == 1 and b["logic"] == [] and b["cyclomatic"] == 2
    assert [(c["name"], c["receiver"]) for c in b["calls"]] == [("go", "Q"), ("x", "u8")]
    assert f["gives_self"] and f["error_type"] == "E" and f["parameter_count"] == 3 and b["self_used"] and not b["self_seen"]
    t = facts_of("fn t(a: u8) { let mut q = g(a, true, 'c', \"s\")?; q.w -= a::b; p!(1); }")["t"]["body"]["tokens"]
    assert t == ["K=let", "K=mut", "I=0", "O==", "I=1", "I=2", "B=true", "L=char", "L=str", "O=?", "S", "I=0", "F=w", "O=-=", "S", "X=p", "S"]
    assert items.production_lines("a\n\n// c\n/* x\n/* y */ still\n*/ b\n  /* z */\nd // e\n#[cfg(test)]\nf") == 3


def test_types_and_impls():
    got = list(items.items("src/a.rs", "pub struct A { #[x(y)] pub a: Map<u8, u8>, pub(crate) b: u8 } enum B { C { d: u8 } } trait D<T> { fn e(&self); fn f() {} } impl<T> x::D<T> for y::A where T: Z { } impl A {} struct E(u8); union F { g: u8 }"))
    assert [(r["name"], r["kind"], r["fields"], r["methods"]) for k, r in got if k == "type"] == [("A", "struct", ["a", "b"], 0), ("B", "enum", [], 0), ("D", "trait", [], 2), ("E", "struct", [], 0), ("F", "union", ["g"], 0)]
    assert [(r["type_name"], r["trait_name"]) for k, r in got if k == "impl"] == [("A", "D"), ("A", None)]


def test_config(tmp_path):
    c = config.parse("max_suppression_ratio = 1\nignore_functions = ['visit_*']\n[complexity]\nmax_cognitive = 3\n[srp]\nweights = [1, 0, 0, 0]")
    assert c.complexity.max_cognitive == 3 and c.complexity.max_cyclomatic == 10 and c.max_suppression_ratio == 1.0 and c.ignore_functions == ("visit_*",)
    for bad in ("x = 1", "[complexity]\ny = 2", "[weights]\niosp = 0.5", "[complexity]\nmax_cognitive = 'a'", "= 3", "srp = 1"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "f.toml").write_text("fail_on_warnings = true")
    assert config.load(str(tmp_path / "a" / "b"), "f.toml").fail_on_warnings and not config.load("/", "no-such.toml").fail_on_warnings
