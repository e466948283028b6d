"""Statements, expressions and patterns of a function body, as a tree of nodes.

A precedence parser over tokens. Types are skipped as balanced token runs; macro arguments are parsed as a list
of expressions where they are one, else dropped. Text that is no body raises SourceError.
"""

from __future__ import annotations

from factweave.frontend.lexer import CLOSES, SourceError, Token, closing

#: How tightly binary operators bind.
BINDS = {"||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
BLOCKS = frozenset("if match for while loop block unsafe const_block".split())
ITEMS = frozenset("fn struct enum union impl trait mod use type extern macro_rules static".split())
#: Words that end an expression where one could start.
STOPS = frozenset("as in else where".split())


class Node:
    """kind, first and last line, children in the order they are written, and what else the kind has."""

    __slots__ = ("end", "kids", "kind", "line", "v")

    def __init__(self, kind: str, line: int, kids: list | None = None, end: int = 0, **v):
        self.kind, self.line, self.kids, self.end, self.v = kind, line, kids or [], end or line, v

    def __getattr__(self, name: str):
        try:
            return self.v[name]
        except KeyError:
            raise AttributeError(name) from None

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.kids)


class Parser:
    def __init__(self, toks: list[Token], at: int, end: int):
        self.toks, self.at, self.end = toks, at, end

    # tokens
    def text(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.toks[k].text if k < self.end else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.toks[k].kind if k < self.end else ""

    def line(self) -> int:
        return self.toks[min(self.at, self.end - 1, len(self.toks) - 1)].line if self.toks else 0

    def last(self) -> int:
        return self.toks[self.at - 1].line

    def take(self, text: str) -> bool:
        if self.text() == text and self.kind() != "str":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SourceError(f"{text} is missing at line {self.line()}")

    def close(self) -> int:
        return closing(self.toks, self.at)

    def inner(self) -> tuple[Parser, int]:
        """A parser of the bracket group here, and the place after it."""
        c = self.close()
        return Parser(self.toks, self.at + 1, c), c + 1

    # types and generics
    def angles(self) -> None:
        """Skips <...>."""
        depth = 0
        while self.at < self.end:
            t = self.text()
            if t in CLOSES and self.kind() == "op":
                self.at = self.close() + 1
                continue
            if t == "<":
                depth += 1
            elif t in (">", ">=", ">>="):
                depth -= 1
            self.at += 1
            if depth <= 0:
                return

    def type(self) -> None:
        bounds = False
        while self.at < self.end:
            t, k = self.text(), self.kind()
            if t in ("&", "&&", "*", "!") or k == "life":
                self.at += 1
                if t == "!":
                    return
                continue
            if t in ("mut", "const", "unsafe", "extern") or k == "str":
                self.at += 1
                continue
            if t in ("dyn", "impl", "for", "?"):
                bounds = bounds or t in ("dyn", "impl")
                self.at += 1
                if t == "for" and self.text() == "<":
                    self.angles()
                continue
            if t in ("(", "["):
                self.at = self.close() + 1
            elif t == "<" or k == "id" or t == "::":
                if t == "<":
                    self.angles()
                elif k == "id":
                    self.at += 1
                    if t in ("fn", "Fn", "FnMut", "FnOnce") and self.text() == "(":
                        self.at = self.close() + 1
                        if self.take("->"):
                            self.type()
                while self.text() in ("::", "<"):
                    if self.take("::"):
                        if self.kind() == "id":
                            self.at += 1
                    else:
                        self.angles()
                if self.text() == "(" and self.toks[self.at - 1].text in ("Fn", "FnMut", "FnOnce"):
                    self.at = self.close() + 1
                    if self.take("->"):
                        self.type()
            else:
                return
            if bounds and self.take("+"):
                continue
            return

    def path(self) -> tuple[list[str], list[Token]]:
        """Segments of a path in an expression, generics skipped."""
        out = []
        self.take("::")
        if self.text() == "<":
            self.angles()
            self.take("::")
        while self.kind() == "id":
            out.append(self.text().removeprefix("r#"))
            self.at += 1
            if self.text() != "::":
                break
            self.at += 1
            if self.text() == "<":
                self.angles()
                if not self.take("::"):
                    break
        return out

    # patterns
    def pattern(self) -> Node:
        line = self.line()
        self.take("|")
        cases = [self.one_pattern()]
        while self.text() == "|":
            self.at += 1
            cases.append(self.one_pattern())
        return cases[0] if len(cases) == 1 else Node("p_or", line, cases)

    def patterns(self) -> list[Node]:
        out = []
        while self.at < self.end:
            self.attributes()
            out.append(self.pattern())
            if not self.take(","):
                break
        return out

    def one_pattern(self) -> Node:
        line, t, k = self.line(), self.text(), self.kind()
        if t == "_":
            self.at += 1
            return Node("p_wild", line)
        if t in ("..", "..="):
            self.at += 1
            if t == "..=" or self.kind() == "num":
                return Node("p_range", line, [self.prefix_literal()])
            return Node("p_rest", line)
        if t in ("&", "&&"):
            self.at += 1
            mut = self.take("mut")
            inner = Node("p_ref", line, [self.one_pattern()], mut=mut)
            return Node("p_ref", line, [inner], mut=False) if t == "&&" else inner
        if t == "(":
            p, self.at = self.inner()
            kids = p.patterns()
            return kids[0] if len(kids) == 1 and p.toks[p.end - 1].text != "," else Node("p_tuple", line, kids)
        if t == "[":
            p, self.at = self.inner()
            return Node("p_slice", line, p.patterns())
        if k in ("num", "str", "char") or t in ("-", "true", "false"):
            lit = self.prefix_literal()
            if self.text() in ("..", "..=", "..."):
                self.at += 1
                more = [self.prefix_literal()] if self.kind() in ("num", "char") or self.text() == "-" else []
                return Node("p_range", line, [lit, *more])
            return Node("p_lit", line, lit=lit)
        ref, mut = self.take("ref"), self.take("mut")
        if t == "box":
            self.at += 1
            return self.one_pattern()
        path = self.path()
        if not path:
            raise SourceError(f"no pattern at line {line}")
        if self.text() == "!":
            self.at += 1
            self.at = self.close() + 1
            return Node("p_macro", line)
        if self.text() == "(":
            p, self.at = self.inner()
            return Node("p_call", line, p.patterns(), path=path)
        if self.text() == "{":
            p, self.at = self.inner()
            names, kids = [], []
            while p.at < p.end:
                p.attributes()
                if p.take(".."):
                    break
                if p.text(1) == ":" and p.text(2) != ":":
                    names.append(p.text())
                    p.at += 2
                    kids.append(p.pattern())
                else:
                    r, m = p.take("ref"), p.take("mut")
                    names.append(p.text())
                    kids.append(Node("p_name", p.line(), name=p.text(), mut=m or r and False))
                    p.at += 1
                p.take(",")
            return Node("p_struct", line, kids, path=path, names=names)
        if self.text() in ("..", "..=", "..."):
            self.at += 1
            more = [self.prefix_literal()] if self.kind() in ("num", "char", "id") or self.text() == "-" else []
            return Node("p_range", line, [Node("path", line, path=path), *more])
        if len(path) == 1 and not (path[0][:1].isupper() and not ref and not mut):
            sub = [self.pattern()] if self.take("@") else []
            return Node("p_name", line, sub, name=path[0], mut=mut)
        return Node("p_name", line, name=path[0], mut=mut) if len(path) == 1 else Node("p_path", line, path=path)

    def prefix_literal(self) -> Node:
        line = self.line()
        if self.take("-"):
            return Node("unary", line, [self.prefix_literal()], op="-")
        t, k = self.text(), self.kind()
        if k == "id" and t not in ("true", "false"):
            return Node("path", line, path=self.path())
        self.at += 1
        return Node("lit", line, text=t, lit="bool" if k == "id" else k)

    # statements
    def attributes(self) -> list[str]:
        out = []
        while self.text() == "#":
            self.at += 1
            self.take("!")
            c = self.close()
            out.append("".join(t.text for t in self.toks[self.at + 1 : c]))
            self.at = c + 1
        return out

    def block(self) -> Node:
        line = self.line()
        p, after = self.inner()
        kids = p.statements()
        self.at = after
        return Node("block", line, kids, self.last())

    def statements(self) -> list[Node]:
        out = []
        while self.at < self.end:
            if self.take(";"):
                continue
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        self.attributes()
        line = self.line()
        if self.text() == "let":
            self.at += 1
            pat = self.pattern()
            if self.take(":"):
                self.type()
            init = [self.expr()] if self.take("=") else []
            other = [self.block()] if self.take("else") else []
            self.take(";")
            return Node("let", line, [pat, *init, *other], self.last(), init=bool(init), diverge=bool(other))
        if item := self.item(line):
            return item
        e = self.expr(statement=True)
        semi = self.take(";")
        if not semi and self.at < self.end and e.kind not in BLOCKS and not (e.kind == "macro" and e.braces):
            raise SourceError(f"statement isn't ended at line {self.line()}")
        return Node("expr", line, [e], self.last(), semi=semi)

    def item(self, line: int) -> Node | None:
        """A nested item: functions and constants keep their expressions."""
        k = 0
        while self.text(k) in ("pub", "async", "unsafe", "default", "const", "extern") or self.kind(k) == "str" and k:
            k += 1
            if self.text(k) == "(" and self.text(k - 1) == "pub":
                k = closing(self.toks, self.at + k) + 1 - self.at
        word = self.text(k)
        if word == "fn" and self.kind(k + 1) == "id":
            self.at += k
            while self.text() not in ("{", ";"):
                self.at = self.close() + 1 if self.text() in ("(", "[") else self.at + 1
            kids = [self.block()] if self.text() == "{" else []
            return Node("item_fn", line, kids, self.last())
        if (self.text(k - 1) if k else "") == "const" and self.kind(k) in ("id",) or word == "static" and self.kind(k + 1) == "id" and self.text(k + 1) != "move":
            if word == "{":
                return None
            self.at += k
            while self.text() not in ("=", ";"):
                self.at = self.close() + 1 if self.text() in CLOSES else self.at + 1
            kids = [self.expr()] if self.take("=") else []
            self.take(";")
            return Node("item_const", line, kids, self.last())
        if word == "macro_rules" and self.text(k + 1) == "!" or word in ITEMS - {"macro_rules", "static", "union"} and (word in ("impl", "use", "extern") or self.kind(k + 1) == "id") or word == "union" and self.kind(k + 1) == "id" and self.text(k + 2) in ("{", "<"):
            while self.at < self.end and self.text() not in (";", "{"):
                self.at = self.close() + 1 if self.text() in ("(", "[") else self.at + 1
            if self.text() == "{":
                self.at = self.close() + 1
                if word == "use":
                    self.take(";")
            else:
                self.take(";")
            return Node("item", line, [], self.last())
        return None

    # expressions
    def operator(self) -> str:
        t = self.text()
        if self.kind() != "op":
            return ""
        if t in "<>" and self.text(1) == t and self.toks[self.at + 1].column == self.toks[self.at].column + 1 and self.toks[self.at + 1].line == self.toks[self.at].line:
            return t * 2
        return t

    def expr(self, least: int = 0, struct: bool = True, statement: bool = False) -> Node:
        line = self.line()
        t = self.text()
        if t in ("..", "..=") and self.kind() == "op":
            self.at += 1
            kids = [self.expr(3, struct)] if self.starts(struct) else []
            left = Node("range", line, kids, start=False)
        else:
            left = self.unary(struct, statement)
            if statement and left.kind in BLOCKS and self.text() not in (".", "?"):
                return left
            if statement and left.kind == "macro" and left.braces and self.text() not in (".", "?"):
                return left
        while self.at < self.end:
            op = self.operator()
            if op == "as" or self.text() == "as" and self.kind() == "id":
                if least > 12:
                    break
                self.at += 1
                self.type()
                left = Node("cast", line, [left])
            elif op in BINDS and BINDS[op] >= least:
                at = self.line()
                self.at += len(op) if op in ("<<", ">>") else 1
                left = Node("binary", line, [left, self.expr(BINDS[op] + 1, struct)], op=op, at=at)
            elif op in ("..", "..=") and least <= 2:
                self.at += 1
                kids = [left] + ([self.expr(3, struct)] if self.starts(struct) else [])
                left = Node("range", line, kids, start=True)
            elif op in ASSIGNS and least <= 1:
                self.at += 1
                right = self.expr(1, struct)
                left = Node("assign" if op == "=" else "compound", line, [left, right], op=op)
            else:
                break
        return left

    def starts(self, struct: bool) -> bool:
        t = self.text()
        return bool(t) and t not in (")", "]", "}", ",", ";", "=>", "=") and t not in STOPS and not (t == "{" and not struct)

    def unary(self, struct: bool, statement: bool = False) -> Node:
        line, t, k = self.line(), self.text(), self.kind()
        if k == "op" and t in ("-", "!", "*"):
            self.at += 1
            return Node("unary", line, [self.unary(struct)], op=t)
        if k == "op" and t in ("&", "&&"):
            self.at += 1
            if self.text() == "raw" and self.text(1) in ("const", "mut"):
                self.at += 1
            mut = self.take("mut") or self.take("const") and False
            e = Node("ref", line, [self.unary(struct)], mut=mut)
            return Node("ref", line, [e], mut=False) if t == "&&" else e
        return self.postfix(self.primary(struct), struct, statement)

    def args(self) -> list[Node]:
        p, self.at = self.inner()
        return p.listed()

    def listed(self) -> list[Node]:
        out = []
        while self.at < self.end:
            self.attributes()
            out.append(self.expr())
            if not self.take(",") and self.at < self.end:
                raise SourceError(f"list at line {self.line()}")
        return out

    def postfix(self, e: Node, struct: bool, statement: bool) -> Node:
        if statement and e.kind in BLOCKS and self.text() not in (".", "?"):
            return e
        while self.at < self.end:
            t, line = self.text(), self.line()
            if self.kind() != "op":
                break
            if t == "?":
                self.at += 1
                e = Node("try", e.line, [e], at=line)
            elif t == ".":
                self.at += 1
                name, line = self.text(), self.line()
                if name == "await":
                    self.at += 1
                    e = Node("await", e.line, [e])
                elif self.kind() == "num":
                    self.at += 1
                    for part in name.split("."):
                        e = Node("field", e.line, [e], name=part)
                else:
                    self.at += 1
                    if self.text() == "::" and self.text(1) == "<":
                        self.at += 1
                        self.angles()
                    if self.text() == "(":
                        e = Node("method", e.line, [e, *self.args()], name=name.removeprefix("r#"), at=line)
                    else:
                        e = Node("field", e.line, [e], name=name.removeprefix("r#"))
            elif t == "(":
                e = Node("call", e.line, [e, *self.args()])
            elif t == "[":
                p, self.at = self.inner()
                e = Node("index", e.line, [e, p.expr()])
            else:
                break
        return e

    def primary(self, struct: bool) -> Node:
        line, t, k = self.line(), self.text(), self.kind()
        if k in ("num", "str", "char"):
            self.at += 1
            return Node("lit", line, text=t, lit=k)
        if k == "life":
            self.at += 1
            if self.take(":"):
                return self.primary(struct)
            raise SourceError(f"label at line {line}")
        if k == "op":
            if t == "(":
                p, self.at = self.inner()
                kids = p.listed()
                if len(kids) == 1 and p.toks[p.end - 1].text != ",":
                    return Node("paren", line, kids)
                return Node("tuple", line, kids)
            if t == "[":
                p, after = self.inner()
                kids = []
                if p.at < p.end:
                    first = p.expr()
                    if p.take(";"):
                        self.at = after
                        return Node("repeat", line, [first, p.expr()])
                    p.take(",")
                    kids = [first, *p.listed()]
                self.at = after
                return Node("array", line, kids)
            if t == "{":
                return self.block()
            if t in ("|", "||"):
                return self.closure(line)
            if t in ("<", "::"):
                return self.named(line, struct)
            raise SourceError(f"no expression at line {line}")
        word = getattr(self, f"_{t}", None) if t in KEYWORDS else None
        if word is not None:
            return word(line, struct)
        if k == "id":
            return self.named(line, struct)
        raise SourceError(f"no expression at line {line}")

    def closure(self, line: int) -> Node:
        pats = []
        if not self.take("||"):
            self.need("|")
            while self.text() != "|":
                pats.append(self.one_pattern())
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    break
            self.need("|")
        if self.take("->"):
            self.type()
            return Node("closure", line, [*pats, self.block()], n=len(pats))
        return Node("closure", line, [*pats, self.expr()], n=len(pats))

    def named(self, line: int, struct: bool) -> Node:
        path = self.path()
        if not path:
            raise SourceError(f"no expression at line {line}")
        if path in (["true"], ["false"]):
            return Node("lit", line, text=path[0], lit="bool")
        if self.text() == "!" and self.text(1) in CLOSES and self.text() != "!=":
            self.at += 1
            braces = self.text() == "{"
            first, (p, after) = self.at + 1, self.inner()
            words = " ".join(x.text for x in self.toks[first : p.end])
            head = self.toks[first].text if first < p.end else ""
            try:
                kids = p.listed()
            except (SourceError, RecursionError):
                kids = None
            self.at = after
            return Node("macro", line, [], name=path[-1], args=kids, braces=braces, words=words, first=head)
        if self.text() == "{" and struct and self.literal_follows(path):
            p, self.at = self.inner()
            names, kids, base = [], [], False
            while p.at < p.end:
                p.attributes()
                if p.take(".."):
                    if p.at < p.end:
                        kids.append(p.expr())
                        base = True
                    break
                names.append(p.text())
                at = p.line()
                p.at += 1
                if p.take(":"):
                    kids.append(p.expr())
                else:
                    kids.append(Node("path", at, path=[names[-1]]))
                p.take(",")
            return Node("struct", line, kids, path=path, names=names, base=base)
        return Node("path", line, path=path)

    def literal_follows(self, path: list[str]) -> bool:
        a, b = self.text(1), self.text(2)
        return a == "}" or a == ".." or a == "#" or self.kind(1) in ("id", "num") and (b in (":", ",", "}")) and (path[-1][:1].isupper() or b == ":")

    def _if(self, line: int, struct: bool) -> Node:
        self.at += 1
        kids, other = [self.expr(struct=False), self.block()], False
        if self.take("else"):
            kids.append(self._if(self.line(), struct) if self.text() == "if" else self.block())
            other = True
        return Node("if", line, kids, self.last(), other=other)

    def _let(self, line: int, struct: bool) -> Node:
        self.at += 1
        pat = self.pattern()
        self.need("=")
        return Node("cond_let", line, [pat, self.expr(5, struct)])

    def _match(self, line: int, struct: bool) -> Node:
        self.at += 1
        head = self.expr(struct=False)
        p, self.at = self.inner()
        arms = []
        while p.at < p.end:
            p.attributes()
            at = p.line()
            pat = p.pattern()
            guard = [p.expr()] if p.take("if") else []
            p.need("=>")
            body = p.expr(statement=True) if p.text() == "{" else p.expr()
            p.take(",")
            arms.append(Node("arm", at, [pat, *guard, body], guard=bool(guard)))
        return Node("match", line, [head, *arms], self.last())

    def _for(self, line: int, struct: bool) -> Node:
        self.at += 1
        pat = self.pattern()
        self.need("in")
        return Node("for", line, [pat, self.expr(struct=False), self.block()], self.last())

    def _while(self, line: int, struct: bool) -> Node:
        self.at += 1
        return Node("while", line, [self.expr(struct=False), self.block()], self.last())

    def _loop(self, line: int, struct: bool) -> Node:
        self.at += 1
        return Node("loop", line, [self.block()], self.last())

    def _unsafe(self, line: int, struct: bool) -> Node:
        self.at += 1
        return Node("unsafe", line, [self.block()], self.last())

    def _const(self, line: int, struct: bool) -> Node:
        self.at += 1
        return Node("const_block", line, [self.block()])

    def _async(self, line: int, struct: bool) -> Node:
        self.at += 1
        self.take("move")
        return self.closure(line) if self.text() in ("|", "||") else Node("async", line, [self.block()])

    def _move(self, line: int, struct: bool) -> Node:
        self.at += 1
        return self.closure(line)

    _static = _move

    def _jump(self, line: int, struct: bool) -> Node:
        word = self.text()
        self.at += 1
        if word != "return" and self.kind() == "life":
            self.at += 1
        return Node(word, line, [self.expr(struct=struct)] if word != "continue" and self.starts(struct) else [])

    _return = _break = _continue = _yield = _jump


KEYWORDS = frozenset("if let match for while loop unsafe const async move static return break continue yield".split())


def body(toks: list[Token], open_: int) -> Node:
    """The block whose brace opens at a place."""
    p = Parser(toks, open_, len(toks))
    return p.block()
