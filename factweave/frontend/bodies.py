"""Facts of a function body, from its tree: logic, calls, complexity, literals, tokens, fields and references.

One row a function; rules never see a tree. Names are resolved later, against the facts of all files: a call keeps its
form, its name and the type of its receiver where parameters or `self` tell it.
"""

from __future__ import annotations

import re

from factweave.frontend.lexer import Token
from factweave.frontend.syntax import Node, body

#: Adaptor methods that never count as calls of one's own.
ADAPTORS = frozenset(
    "map filter filter_map flat_map for_each fold reduce any all find find_map position skip take skip_while take_while zip enumerate chain inspect partition scan peekable "
    "sum product count min max min_by max_by min_by_key max_by_key collect iter into_iter iter_mut".split()
)
#: Methods of an accessor's chain that need no argument.
PLAIN_METHODS = frozenset("len is_empty clone as_ref as_mut as_str to_owned to_string borrow borrow_mut".split())
KINDS = {**dict.fromkeys("+ - * / %".split(), "arithmetic"), **dict.fromkeys("&& ||".split(), "boolean_op"), **dict.fromkeys("== != < <= > >=".split(), "comparison"), **dict.fromkeys("& | ^ << >>".split(), "bitwise")}
SIMPLE = frozenset("lit path field call method tuple struct ref unary index cast".split())
STUBS = frozenset("todo unimplemented panic".split())
DEEP = 3
#: Macros whose first argument may be a format, and calls that give an empty value.
FORMATS = frozenset("format println eprintln print write writeln".split())
EMPTY_CALLS = frozenset("Default::default String::new Vec::new HashMap::new HashSet::new BTreeMap::new BTreeSet::new".split())


def number(text: str) -> str:
    """Digits of a number literal without separators, prefix and type, in base ten."""
    t = text.replace("_", "")
    for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if t.startswith(prefix):
            return str(int(re.match(r"[0-9a-fA-F]+" if base == 16 else r"[0-9]+", t[2:])[0], base))
    m = re.match(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", t)
    return m[0] if m else t


def is_self(n: Node) -> bool:
    return n.kind == "path" and n.path == ["self"]


def _only_delegates(todo: list[Node]) -> bool:
    """Whether expressions do nothing but call, pass on and leave."""
    todo = list(todo)
    while todo:
        e = todo.pop()
        if e.kind in ("call", "method", "break", "continue", "path"):
            continue
        if e.kind in ("try", "await", "return", "paren"):
            todo += e.kids
        elif e.kind == "block":
            inner = _plain(e)
            if inner is None:
                return False
            todo += inner
        elif e.kind == "if" and e.kids[0].kind == "cond_let":
            inner = _plain(e.kids[1])
            if inner is None:
                return False
            todo += [e.kids[0].kids[1], *inner, *e.kids[2:]]
        else:
            return False
    return True


def _plain(block: Node) -> list[Node] | None:
    """Expressions and initial values of a block; none where it holds anything else."""
    out = []
    for s in block.kids:
        if s.kind == "expr" and not (s.kids[0].kind == "macro" and (s.semi or s.kids[0].braces)):
            out += s.kids
        elif s.kind == "let":
            out += s.kids[1:2] if s.init else []
        else:
            return None
    return out


def _trivial_arm(arm: Node) -> bool:
    if arm.guard:
        return False
    e = arm.kids[-1]
    if e.kind == "block" and len(e.kids) == 1 and e.kids[0].kind == "expr":
        return e.kids[0].kids[0].kind in SIMPLE
    return e.kind in SIMPLE


class Walk:
    """Logic, calls and complexity. Closures and async blocks hide both from the classification, not from complexity."""

    def __init__(self, name: str, parameters: dict[str, str], parent: str | None):
        self.name, self.parameters, self.parent = name, parameters, parent
        self.logic, self.calls, self.deep, self.numbers = [], [], [], []
        self.hidden = self.closures = self.depth = self.constant = self.indexed = 0
        self.in_head = False
        self.last: str | None = None
        self.n = dict.fromkeys("max_nesting cognitive unsafe unwrap expect panic todo".split(), 0) | {"cyclomatic": 1}

    def mark(self, kind: str, line: int) -> None:
        if not self.hidden and not self.in_head:
            self.logic.append({"kind": kind, "line": line})

    def branch(self, e: Node, paths: int = 1) -> None:
        self.n["cognitive"] += 1 + self.depth
        self.n["cyclomatic"] += paths
        if self.depth >= DEEP:
            self.deep.append({"line": e.line, "depth": self.depth, "construct": e.kind})

    def nested(self, kids: list[Node]) -> None:
        self.depth += 1
        self.n["max_nesting"] = max(self.n["max_nesting"], self.depth)
        for k in kids:
            self.see(k)
        self.depth -= 1

    def literal(self, text: str, line: int) -> None:
        if not self.constant and not self.indexed:
            self.numbers.append({"line": line, "value": text})

    def see(self, e: Node) -> None:
        k = e.kind
        if k in ("let", "expr", "arm", "item_fn") or k.startswith("p_") or k == "item":
            for x in e.kids:
                self.see(x)
            return
        if k == "item_const":
            self.constant += 1
            for x in e.kids:
                self.see(x)
            self.constant -= 1
            return
        if not (k == "binary" and e.op in ("&&", "||")):
            self.last = None
        handler = getattr(self, f"on_{k}", None)
        if handler is None or handler(e) is not True:
            for x in e.kids:
                self.see(x)

    def on_if(self, e: Node) -> bool:
        self.branch(e)
        self.mark("if", e.line)
        self.nested(e.kids)
        return True

    def on_match(self, e: Node) -> bool:
        self.branch(e, max(0, sum(not _trivial_arm(a) for a in e.kids[1:]) - 1))
        if not all(not a.guard and _only_delegates([a.kids[-1]]) for a in e.kids[1:]):
            self.mark("match", e.line)
        self.nested(e.kids)
        return True

    def on_for(self, e: Node) -> bool:
        self.branch(e)
        plain = _plain(e.kids[2])
        if plain is None or not _only_delegates(plain):
            self.mark("for", e.line)
        before, self.in_head = self.in_head, True
        self.see(e.kids[1])
        self.in_head = False
        self.see(e.kids[0])
        self.nested(e.kids[2].kids)
        return True

    def on_while(self, e: Node) -> bool:
        self.branch(e)
        self.mark(e.kind, e.line)
        self.nested(e.kids)
        return True

    on_loop = on_while

    def on_binary(self, e: Node) -> None:
        self.mark(KINDS[e.op], e.at)
        if e.op in ("&&", "||"):
            self.n["cyclomatic"] += 1
            self.n["cognitive"] += self.last is not None and self.last != e.op
            self.last = e.op

    def on_unsafe(self, e: Node) -> None:
        self.n["unsafe"] += 1

    def on_closure(self, e: Node) -> bool:
        self.hidden += 1
        for x in e.kids:
            self.see(x)
        self.hidden -= 1
        return True

    on_async = on_closure

    def on_index(self, e: Node) -> bool:
        self.see(e.kids[0])
        self.indexed += 1
        self.see(e.kids[1])
        self.indexed -= 1
        return True

    def on_lit(self, e: Node) -> None:
        if e.lit == "num":
            self.literal(number(e.text), e.line)

    def on_unary(self, e: Node) -> bool:
        x = e.kids[0]
        if e.op == "-" and x.kind == "lit" and x.lit == "num":
            self.literal(f"-{number(x.text)}", x.line)
            return True
        return False

    def on_macro(self, e: Node) -> None:
        self.n["panic"] += e.name in ("panic", "unreachable")
        self.n["todo"] += e.name == "todo"

    def on_call(self, e: Node) -> None:
        f = e.kids[0]
        if not self.hidden and f.kind == "path":
            self.calls.append({"form": "path", "name": "::".join(f.path), "receiver": None, "line": f.line})

    def on_method(self, e: Node) -> None:
        if e.name in ("unwrap", "expect"):
            self.n[e.name] += 1
        if not self.hidden and e.name not in ADAPTORS:
            r = e.kids[0]
            known = self.parent if is_self(r) else self.parameters.get(r.path[0]) if r.kind == "path" and len(r.path) == 1 else None
            self.calls.append({"form": "method", "name": e.name, "receiver": known, "line": e.at})


#: Words and marks that a kind of node gives before its children, between them and after them.
BEFORE = {"if": "K=if", "while": "K=while", "loop": "K=loop", "return": "K=return", "break": "K=break", "continue": "K=continue", "yield": "K=yield", "tuple": "K=tuple", "array": "K=array", "repeat": "K=array", "closure": "K=closure", "match": "K=match", "p_tuple": "K=tuple", "p_call": "K=tuple", "p_slice": "K=array", "p_rest": "O=..", "p_wild": "K=_"}
AFTER = {"try": "O=?", "await": "K=await", "cast": "K=as"}
LITERALS = {"str": "L=str", "char": "L=char"}


class Tokens:
    """A body without names of variables and values of literals: names by first use, bool values, methods, fields and macros as they are."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.names: dict[str, int] = {}

    def name(self, x: str) -> None:
        self.out.append(f"I={self.names.setdefault(x, len(self.names))}")

    def all(self, nodes: list[Node]) -> None:
        for n in nodes:
            self.see(n)

    def see(self, n: Node) -> None:
        k, out = n.kind, self.out
        if k == "lit":
            out.append(f"B={n.text}" if n.lit == "bool" else LITERALS.get(n.lit) or ("L=char" if n.text.startswith("b'") else "L=float" if "." in n.text or re.search(r"f(32|64)$|^[0-9_]+[eE]", n.text) else "L=int"))
        elif k == "p_lit":
            self.see(n.lit.kids[0] if n.lit.kind == "unary" else n.lit)
        elif k == "path":
            if len(n.path) == 1:
                self.name(n.path[0])
        elif k in ("binary", "assign", "compound"):
            self.see(n.kids[0])
            out.append(f"O={n.op}")
            self.see(n.kids[1])
        elif k in ("unary", "ref", "p_ref"):
            out.append(f"O={n.op if k == 'unary' else '&'}")
            if k != "unary" and n.mut:
                out.append("K=mut")
            self.all(n.kids)
        elif k in ("let", "cond_let"):
            out.append("K=let")
            self.see(n.kids[0])
            if k == "cond_let" or n.init:
                out.append("O==")
                self.see(n.kids[1])
            if k == "let":
                if n.diverge:
                    out.append("K=else")
                    self.see(n.kids[-1])
                out.append("S")
        elif k == "expr":
            self.all(n.kids)
            if n.semi or n.kids[0].kind == "macro" and n.kids[0].braces:
                out.append("S")
        elif k == "macro":
            out.append(f"X={n.name}")
        elif k == "method":
            self.see(n.kids[0])
            out.append(f"M={n.name}")
            self.all(n.kids[1:])
        elif k == "field":
            self.all(n.kids)
            out.append(f"F={n.name}")
        elif k == "index":
            self.see(n.kids[0])
            out.append("O=[]")
            self.see(n.kids[1])
        elif k in ("range", "p_range"):
            first = k == "p_range" or n.start
            self.all(n.kids[:1] if first else [])
            out.append("O=..")
            self.all(n.kids[1:] if first else n.kids)
        elif k == "for":
            out.append("K=for")
            self.see(n.kids[0])
            out.append("K=in")
            self.all(n.kids[1:])
        elif k == "if":
            out.append("K=if")
            self.all(n.kids[:2])
            if n.other:
                out.append("K=else")
                self.see(n.kids[2])
        elif k == "arm":
            self.see(n.kids[0])
            if n.guard:
                out.append("K=if")
                self.see(n.kids[1])
            out.append("O==>")
            self.see(n.kids[-1])
        elif k in ("struct", "p_struct"):
            out.append("K=struct")
            for name, x in zip(n.names, n.kids, strict=False):
                out.append(f"F={name}")
                self.see(x)
            if k == "struct" and n.base:
                out.append("O=..")
                self.see(n.kids[-1])
        elif k == "p_or":
            for i, x in enumerate(n.kids):
                if i:
                    out.append("O=|")
                self.see(x)
        elif k == "p_name":
            if n.mut:
                out.append("K=mut")
            self.name(n.name)
            if n.kids:
                out.append("O=@")
                self.all(n.kids)
        elif k not in ("item", "item_fn", "item_const"):
            if k in BEFORE:
                out.append(BEFORE[k])
            self.all(n.kids)
            if k in AFTER:
                out.append(AFTER[k])


def tokens_of(statements: list[Node]) -> list[str]:
    t = Tokens()
    t.all(statements)
    return t.out


def _with_macros(n: Node):
    """Nodes of a tree, those of macro arguments too."""
    for x in n.walk():
        yield x
        if x.kind == "macro" and x.args:
            for a in x.args:
                yield from _with_macros(a)


def _tails(path: list[str]) -> list[str]:
    return path[-1:] if len(path) < 2 else [path[-1], "::".join(path[-2:])]


def _stub(block: Node, names: frozenset, what: str = "") -> bool:
    if len(block.kids) != 1 or block.kids[0].kind != "expr" or block.kids[0].semi:
        return False
    m = block.kids[0].kids[0]
    return m.kind == "macro" and m.name in names and (m.name != "panic" or not what or re.search(what, m.words) is not None)


def _accessor(block: Node) -> bool:
    """A body that only reads a field, perhaps through borrowing, conversion or a plain method."""
    if len(block.kids) != 1 or block.kids[0].kind != "expr":
        return False
    e = block.kids[0].kids[0]
    while True:
        if e.kind == "field":
            return True
        if e.kind in ("ref", "cast", "unary", "paren"):
            e = e.kids[0]
        elif e.kind == "method" and (len(e.kids) == 1 and e.name in PLAIN_METHODS or len(e.kids) == 2 and e.name == "get" and _plain_argument(e.kids[1])):
            e = e.kids[0]
        else:
            return False


def _plain_argument(a: Node) -> bool:
    while a.kind in ("field", "ref"):
        a = a.kids[0]
    return a.kind == "lit" or is_self(a)


def _self_field(e: Node) -> bool:
    return e.kind == "field" and is_self(e.kids[0])


def _self_place(e: Node) -> bool:
    return _self_field(e) or e.kind == "index" and _self_field(e.kids[0])


def _changes(x: Node) -> bool:
    if x.kind in ("assign", "compound"):
        return _self_place(x.kids[0])
    if x.kind == "method":
        r = x.kids[0]
        return is_self(r) or _self_place(r)
    return x.kind == "ref" and bool(x.mut) and _self_place(x.kids[0])


def _empty_value(e: Node) -> bool:
    """Zero, false, an empty text or collection, None or a default."""
    if e.kind == "lit":
        return e.text in ("false", '""') or e.lit == "num" and float(number(e.text)) == 0
    if e.kind == "path":
        return e.path[-1] == "None"
    if e.kind == "call":
        return e.kids[0].kind == "path" and "::".join(e.kids[0].path) in EMPTY_CALLS
    return e.kind == "macro" and e.name == "vec" and not e.words


def _sets_field(s: Node) -> bool:
    return s.kind == "expr" and s.semi and s.kids[0].kind == "assign" and _self_field(s.kids[0].kids[0])


def shapes(block: Node) -> list[str]:
    """Names of the plain forms that a body has."""
    out, stmts = [], block.kids
    if len(stmts) == 1 and stmts[0].kind == "expr" and not stmts[0].semi:
        e = stmts[0].kids[0]
        out.append("one_value")
        if e.kind == "call" and all(a.kind == "path" for a in e.kids[1:]) or e.kind == "struct" and not e.base and all(x.kind == "path" for x in e.kids):
            out.append("wraps")
        if e.kind == "macro" and e.name in ("write", "writeln"):
            out.append("writes")
        if _self_field(e) or e.kind == "ref" and _self_field(e.kids[0]):
            out.append("reads_field")
        if e.kind == "struct" and not e.base and e.kids and all(map(_empty_value, e.kids)):
            out.append("defaults")
    if len(stmts) == 1 and _sets_field(stmts[0]):
        out.append("sets_field")
    if len(stmts) == 2 and _sets_field(stmts[0]) and stmts[1].kind == "expr" and not stmts[1].semi and is_self(stmts[1].kids[0]):
        out.append("sets_and_returns")
    return out


def _values(block: Node) -> list[Node]:
    """Expressions and initial values of a body's own statements."""
    return [s.kids[0] if s.kind == "expr" else s.kids[1] for s in block.kids if s.kind == "expr" or s.kind == "let" and s.init]


def _maps_variants(m: Node) -> bool:
    arms = m.kids[1:]
    plain = lambda p: p.kind == "p_path" or p.kind == "p_call" and all(x.kind == "p_wild" for x in p.kids) or p.kind == "p_struct" and not p.names
    return m.kids[0].kind != "tuple" and all(not a.guard and plain(a.kids[0]) and a.kids[-1].kind in ("path", "call") for a in arms)


def _clones(e: Node) -> int:
    return sum(x.kind == "method" and x.name == "clone" and len(x.kids) == 1 for x in e.kids[: len(e.names)]) if e.kind == "struct" else 0


def _matched(m: Node) -> dict:
    owners = [a.kids[0].path[-2] for a in m.kids[1:] if a.kids[0].kind in ("p_path", "p_call", "p_struct") and len(a.kids[0].path) > 1]
    return {"line": m.line, "arms": len(m.kids) - 1, "enum": owners[0] if owners else "(unknown)", "tokens": tokens_of([Node("expr", m.line, [m], semi=False)])}


def row(toks: list[Token], open_: int, name: str, parent: str | None, parameters: dict[str, str], window: int = 3) -> dict:
    """The facts of the body whose brace opens at a place."""
    block = body(toks, open_)
    w = Walk(name, parameters, parent)
    for s in block.kids:
        w.see(s)
    plain = list(block.walk())
    every = list(_with_macros(block))
    called = [x.kids[0].path for x in every if x.kind == "call" and x.kids[0].kind == "path"]
    methods = [x for x in every if x.kind == "method"]
    passed = [y.kids[0] if y.kind == "ref" else y for x in every if x.kind in ("call", "method") for y in x.kids[1:]] + [y for x in every if x.kind == "struct" for y in x.kids[: len(x.names)]]
    targets = {t for p in called for t in _tails(p)} | {x.name for x in methods} | {t for y in passed if y.kind == "path" for t in _tails(y.path)}
    macros = {x.name for x in every if x.kind == "macro"}
    paths = [x.path for x in every if x.kind == "path"]
    spans = [(s.line, s.end) for s in block.kids]
    windows = []
    for i in range(len(block.kids) - window + 1):
        t = tokens_of(block.kids[i : i + window])
        windows.append({"at": i, "line": spans[i][0], "end_line": spans[i + window - 1][1], "tokens": t})
    return {
        "statements": len(block.kids), "body_lines": block.end - block.line + 1, "logic": w.logic, "calls": w.calls, "deep": w.deep, "numbers": w.numbers,
        **{f"n_{k}" if k not in ("cognitive", "cyclomatic", "max_nesting") else k: v for k, v in w.n.items()},
        "tokens": tokens_of(block.kids), "windows": windows, "targets": sorted(targets),
        "called": sorted({p[-1] for p in called} | {x.name for x in methods}),
        "refs": sorted({p[-1] for p in [*called, *paths]} | {x.name for x in methods}),
        "type_refs": sorted({p[-2] for p in [*called, *paths] if len(p) > 1} | {x.path[-1] for x in every if x.kind == "struct"}),
        "asserts": any(m.startswith(("assert", "debug_assert")) for m in macros), "macros": sorted(macros), "any_call": any(x.kind in ("call", "method") for x in plain),
        "accessor": _accessor(block), "stub": _stub(block, STUBS), "broken": _stub(block, STUBS, "not (yet )?implemented"),
        "self_used": any(x.kind == "path" and x.path[0] == "self" or x.kind == "macro" and x.name == "matches" and x.words.split(" ")[0] == "self" for x in plain),
        "self_seen": any(is_self(x) for x in plain), "self_changed": any(_changes(x) for x in plain),
        "fields": sorted({x.name for x in every if _self_field(x) and not x.name.isdigit()}), "self_calls": sorted({x.name for x in methods if is_self(x.kids[0])}),
        "fan": sorted({"::".join(p) for p in called} | {x.name for x in methods if not is_self(x.kids[0])}),
        "shapes": shapes(block), "mapped_arms": [len(v.kids) - 1 for v in _values(block) if v.kind == "match" and _maps_variants(v)], "clones": [n for n in map(_clones, _values(block)) if n],
        "built": [{"type": "::".join(x.path), "fields": x.names} for x in plain if x.kind == "struct" and not x.base],
        "formats": [{"line": x.line, "value": x.first} for x in plain if x.kind == "macro" and x.name in FORMATS and x.first.startswith('"')],
        "matches": [_matched(x) for x in plain if x.kind == "match" and len(x.kids) > 3],
        "downcasts": [x.at for x in plain if x.kind == "method" and x.name in ("downcast", "downcast_ref", "downcast_mut")],
    }


LIST, PLACE = "array<string>", "array<struct<line:bigint,value:string>>"
BODY = (
    "statements bigint, body_lines bigint, logic array<struct<kind:string,line:bigint>>, calls array<struct<form:string,name:string,receiver:string,line:bigint>>, "
    f"deep array<struct<line:bigint,depth:bigint,construct:string>>, numbers {PLACE}, max_nesting bigint, cognitive bigint, n_unsafe bigint, n_unwrap bigint, n_expect bigint, n_panic bigint, n_todo bigint, cyclomatic bigint, "
    f"tokens {LIST}, windows array<struct<at:bigint,line:bigint,end_line:bigint,tokens:{LIST}>>, targets {LIST}, called {LIST}, refs {LIST}, type_refs {LIST}, asserts boolean, macros {LIST}, any_call boolean, accessor boolean, "
    f"stub boolean, broken boolean, self_used boolean, self_seen boolean, self_changed boolean, fields {LIST}, self_calls {LIST}, fan {LIST}, shapes {LIST}, mapped_arms array<bigint>, clones array<bigint>, built array<struct<type:string,fields:{LIST}>>, formats {PLACE}, matches array<struct<line:bigint,arms:bigint,enum:string,tokens:{LIST}>>, downcasts array<bigint>"
)
