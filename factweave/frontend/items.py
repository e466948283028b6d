"""Items of a source file: imports, modules, types, impls and functions with their bodies, as rows.

A walk over a file's tokens at item level: attributes and visibility are read, `use` trees are flattened
to leaf paths, modules, impls and traits are entered, and each body becomes one row of facts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.frontend import bodies
from factweave.frontend.lexer import SourceError, Token, closing, tokens

#: Words that may stand between visibility and the keyword of an item.
QUALIFIERS = frozenset("const async unsafe extern default auto".split())


def use_leaves(toks: list[Token], at: int, stop: int) -> list[tuple[list[str], str, Token]]:
    """Leaves of a use tree in toks[at:stop]: path, kind (name, rename or glob) and its first token. A rename keeps the imported name; a glob gives its prefix."""
    out, todo = [], [([], at, stop)]
    while todo:
        prefix, i, end = todo.pop()
        path, first = list(prefix), toks[i] if i < end else None
        while i < end:
            t = toks[i]
            if t.text == "{":
                close, depth, from_ = closing(toks, i), 0, i + 1
                for j in range(i + 1, close + 1):
                    depth += (toks[j].text == "{") - (toks[j].text == "}" and j < close)
                    if (j == close or toks[j].text == ",") and not depth:
                        if from_ < j:
                            todo.append((path, from_, j))
                        from_ = j + 1
                path = None
                break
            if t.text == "*":
                out.append((path, "glob", first))
                path = None
                break
            if t.text == "as":
                out.append((path, "rename", first))
                path = None
                break
            if t.kind == "id":
                path.append(t.text.removeprefix("r#"))
            i += 1
        if path is not None and len(path) > len(prefix):
            out.append((path, "name", first))
    return out


def _split(toks: list[Token], lo: int, hi: int) -> list[list[Token]]:
    """Parts of toks[lo:hi] between the commas outside brackets."""
    parts, depth, from_ = [], 0, lo
    for j in range(lo, hi + 1):
        t = toks[j].text if j < hi else ","
        if j < hi and toks[j].kind == "op":
            depth += (t in "([{<" and len(t) == 1) - (t in ")]}>" and len(t) == 1)
        if t == "," and (depth <= 0 or j == hi):
            if from_ < j:
                parts.append(toks[from_:j])
            from_ = j + 1
    return parts


def _parameters(toks: list[Token], open_: int, close: int) -> tuple[int, str, dict[str, str]]:
    """How many parameters besides self, the form of self ('' without one), and the plain types of the named ones."""
    parts = _split(toks, open_ + 1, close)
    first = [t.text for t in parts[0]] if parts else []
    head = first[: first.index(":")] if ":" in first else first
    me = "".join(x for x in head if not x.startswith("'")) if "self" in head else ""
    types = {}
    for part in parts[bool(me) :]:
        words = [t.text for t in part if t.kind != "life"]
        if ":" in words:
            name, kind = words[: words.index(":")], words[words.index(":") + 1 :]
            while kind and kind[0] in ("&", "&&", "mut"):
                kind.pop(0)
            if len(name) <= 2 and name[:-1] in ([], ["mut"]) and kind and kind[0] not in ("dyn", "impl", "(", "[", "fn", "*", "!") and (m := re.match(r"(?:::)?((?:\w+(?:<.*?>)?::)*)(\w+)", "".join(kind))):
                types[name[-1]] = m[2]
    return len(parts) - bool(me), me, types


def _result(toks: list[Token], at: int, stop: int) -> tuple[bool, bool, str | None]:
    """Of a return type: whether it is plain Self, whether it is Self, plain or in one pair of angle brackets, and the error type of a Result."""
    words = []
    while at < stop and toks[at].text not in ("where", "{", ";"):
        words.append(toks[at])
        at += 1
    text = "".join(t.text for t in words)
    inner = [("".join(t.text for t in part)) for m in [next((i for i, t in enumerate(words) if t.text == "<"), None)] if m is not None for part in _split(words, m + 1, len(words) - 1)]
    plain = re.fullmatch(r"(?:\w+::)*Self", text) is not None
    error = inner[1] if len(inner) > 1 and re.match(r"(?:\w+::)*Result<", text) else None
    if error:
        error = re.sub(r"^(std|core)::", "", error)
    return plain, plain or any(re.fullmatch(r"(?:\w+::)*Self", x) for x in inner) and not text.startswith("&"), error


def items(path: str, source: str) -> Iterator[tuple[str, dict]]:
    """(kind of fact, row) of a file."""
    toks = tokens(source)
    yield "source", {"file": path, "production_lines": production_lines(source)}
    todo = [(0, len(toks), [], False, None, "", None, (None, None))]
    while todo:
        i, end, mods, test, parent, owner, trait, within = todo.pop()
        while i < end:
            attrs, public = [], ""
            while i < end and toks[i].text == "#":
                j = i + 1 + (toks[i + 1].text == "!")
                close = closing(toks, j)
                attrs.append("".join(t.text for t in toks[j + 1 : close]))
                if toks[i + 1].text == "!" and attrs[-1] == "cfg(test)" and not mods:
                    yield "module", {"file": path, "module": [], "inline": True, "in_test": True, "line": toks[i].line}
                i = close + 1
            if i < end and toks[i].text == "pub":
                public = "pub"
                i += 1
                if i < end and toks[i].text == "(" and toks[i + 1].text in ("crate", "super", "self", "in"):
                    close = closing(toks, i)
                    public = f"pub({''.join(t.text for t in toks[i + 1 : close])})"
                    i = close + 1
            start = i
            while i < end and (toks[i].text in QUALIFIERS or toks[i].kind == "str") and not (toks[i].text == "const" and toks[i + 1].kind == "id" and toks[i + 1].text not in ("fn", "async", "unsafe", "extern")):
                i += 1
            if i >= end:
                break
            word, own_test = toks[i].text, test or "cfg(test)" in attrs
            if word == "use":
                stop = next(j for j in range(i, end) if toks[j].text == ";")
                for segments, kind, t in use_leaves(toks, i + 1, stop):
                    yield "import", {"file": path, "segments": segments, "kind": kind, "public": public, "module": mods, "in_test": test, "use_line": toks[i].line, "line": t.line, "column": t.column}
                i = stop + 1
            elif word == "mod" and i + 1 < end and toks[i + 1].kind == "id":
                name = toks[i + 1].text
                inline = toks[i + 2].text == "{"
                yield "module", {"file": path, "module": [*mods, name], "inline": inline, "in_test": own_test, "line": toks[i].line}
                if inline:
                    close = closing(toks, i + 2)
                    todo.append((i + 3, close, [*mods, name], own_test, None, "", None, (None, None)))
                    i = close + 1
                else:
                    i += 3
            elif word in ("impl", "trait"):
                body = next(j for j in range(i, end) if toks[j].text in ("{", ";"))
                if toks[body].text == ";":
                    i = body + 1
                    continue
                close, head = closing(toks, body), toks[i + 1 : body]
                of, kind = _trait_name(head) if word == "impl" else None, _type_name(head, word)
                inside = sum(t.text == "fn" and t.kind == "id" for t in toks[body + 1 : close]) if word == "trait" else 0
                if word == "trait":
                    yield "type", {"file": path, "name": kind, "kind": "trait", "line": toks[i + 1].line, "public": public, "fields": [], "methods": inside, "module": mods, "in_test": own_test}
                else:
                    yield "impl", {"file": path, "type_name": kind, "trait_name": of, "line": toks[i].line, "module": mods, "in_test": own_test}
                todo.append((body + 1, close, mods, own_test, kind, word, of, (i, _type_line(head, toks[i].line))))
                i = close + 1
            elif word in ("struct", "enum", "union") and i + 1 < end and toks[i + 1].kind == "id":
                name, line = toks[i + 1].text, toks[i + 1].line
                j = i + 2
                while j < end and toks[j].text not in ("{", ";"):
                    j = closing(toks, j) + 1 if toks[j].text in ("(", "[") else j + 1
                fields = []
                if j < end and toks[j].text == "{":
                    close = closing(toks, j)
                    if word != "enum":
                        for part in _split(toks, j + 1, close):
                            words = _bare(part)
                            if len(words) > 1 and words[1].text == ":":
                                fields.append(words[0].text)
                    j = close
                yield "type", {"file": path, "name": name, "kind": word, "line": line, "public": public, "fields": fields, "methods": 0, "module": mods, "in_test": own_test}
                i = j + 1
            elif word == "fn":
                name = toks[i + 1].text.removeprefix("r#")
                open_ = next(j for j in range(i, end) if toks[j].text == "(")
                close = closing(toks, open_)
                count, me, types = _parameters(toks, open_, close)
                body = next((j for j in range(close, end) if toks[j].text in ("{", ";")), end - 1)
                last = closing(toks, body) if toks[body].text == "{" else body
                own_self, gives_self, error = _result(toks, close + 2, body) if toks[close + 1].text == "->" else (False, False, None)
                has_body = toks[body].text == "{"
                yield "function", {
                    "file": path, "name": name, "parent_type": parent, "line": toks[i + 1].line, "body_line": toks[body].line, "end_line": toks[last].line, "parameter_count": count, "has_self": bool(me),
                    "public": public, "is_test": own_test or "test" in attrs, "is_trait_impl": owner == "impl" and trait is not None, "has_body": has_body, "allow_dead": any("allow(dead_code" in a for a in attrs),
                    "owner": owner, "trait_name": trait, "module": mods, "in_test": test, "test_attr": "test" in attrs, "should_panic": any(a.startswith("should_panic") for a in attrs), "mut_self": me == "&mutself", "gives_self": gives_self, "result_self": own_self, "block": within[0], "block_line": within[1], "error_type": error,
                    "body": bodies.row(toks, body, name, parent, types) if has_body else None,
                }
                i = last + 1
            else:  # any other item ends with a semicolon or its braces
                i = start
                while i < end and toks[i].text != ";":
                    if toks[i].text in ("(", "["):
                        i = closing(toks, i)
                    elif toks[i].text == "{":
                        i = closing(toks, i)
                        if i + 1 >= end or toks[i + 1].text != ";":
                            break
                    i += 1
                i += 1


def production_lines(source: str) -> int:
    """Lines with code before the first line that starts with #[cfg(test)] outside a comment; block comments nest."""
    n = depth = 0
    for line in source.splitlines():
        line = line.strip()
        if not depth and line.startswith("#[cfg(test)]"):
            break
        code, i = False, 0
        while i < len(line):
            two = line[i : i + 2]
            if depth:
                step = {"/*": 1, "*/": -1}.get(two, 0)
                depth, i = max(0, depth + step), i + (2 if step else 1)
            elif two == "//":
                break
            elif two == "/*":
                depth, i = 1, i + 2
            else:
                code, i = code or not line[i].isspace(), i + 1
        n += code
    return n


def _bare(part: list[Token]) -> list[Token]:
    """A field's tokens without attributes and visibility."""
    i = 0
    while i < len(part) and part[i].text == "#":
        i = closing(part, i + 1) + 1
    if i < len(part) and part[i].text == "pub":
        i += 1
        if i < len(part) and part[i].text == "(":
            i = closing(part, i) + 1
    return part[i:]


def _trait_name(head: list[Token]) -> str | None:
    """The last segment of the trait of an `impl Trait for Type`."""
    flat = [t for t in _flat(head) if t.kind == "id"]
    at = next((k for k, t in enumerate(flat) if t.text == "for"), None)
    return flat[at - 1].text if at else None


def _flat(head: list[Token]) -> list[Token]:
    """Tokens outside angle brackets, up to a where clause."""
    out, depth = [], 0
    for t in head:
        if t.text == "where" and not depth:
            break
        if t.text == "<":
            depth += 1
        elif t.text in (">", ">>"):
            depth -= len(t.text)
        elif not depth:
            out.append(t)
    return out


def _type_line(head: list[Token], line: int) -> int:
    """Where the type of an impl is written."""
    flat = _flat(head)
    at = next((k + 1 for k, t in enumerate(flat) if t.text == "for"), 0)
    return flat[at].line if at < len(flat) else line


def _type_name(head: list[Token], word: str) -> str | None:
    flat = _flat(head)
    if word == "trait":
        return flat[0].text if flat else None
    names = [t for t in flat if t.kind == "id" or t.text == "for"]
    if any(t.text == "for" for t in names):
        names = names[max(k for k, t in enumerate(names) if t.text == "for") + 1 :]
    own = [t.text for t in names if t.text not in ("dyn", "mut", "const", "impl", "unsafe")]
    return own[-1] if own else None


IMPORTS = "file string, segments array<string>, kind string, public string, module array<string>, in_test boolean, use_line long, line long, column long"
MODULES = "file string, module array<string>, inline boolean, in_test boolean, line long"
FUNCTIONS = (
    "file string, name string, parent_type string, line long, body_line long, end_line long, parameter_count long, has_self boolean, public string, is_test boolean, is_trait_impl boolean, has_body boolean, allow_dead boolean, "
    "owner string, trait_name string, module array<string>, in_test boolean, test_attr boolean, should_panic boolean, mut_self boolean, gives_self boolean, result_self boolean, block long, block_line long, error_type string, body struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", bodies.BODY) + ">"
)
TYPES = "file string, name string, kind string, line long, public string, fields array<string>, methods long, module array<string>, in_test boolean"
IMPLS = "file string, type_name string, trait_name string, line long, module array<string>, in_test boolean"
ERRORS = "file string, error string"
SOURCES = "file string, production_lines long"
SCHEMAS = {"source": SOURCES, "import": IMPORTS, "module": MODULES, "function": FUNCTIONS, "type": TYPES, "impl": IMPLS, "error": ERRORS}
FACTS = "kind string, file string, " + ", ".join(f"`{k}` struct<{', '.join(c.replace(' ', ':', 1) for c in s.split(', '))}>" for k, s in SCHEMAS.items())


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"kind": k, "file": path, k: r} for k, r in items(path, content or "")]
                except (SourceError, StopIteration, IndexError, RecursionError) as e:
                    rows = [{"kind": "error", "file": path, "error": {"file": path, "error": str(e) or type(e).__name__}}]
                except RuntimeError as e:  # a search inside the generator ended early
                    rows = [{"kind": "error", "file": path, "error": {"file": path, "error": str(e)}}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def facts(files: DataFrame) -> DataFrame:
    """files: path, content. One pass over the sources; each row holds one fact in the column of its kind. A file that can't be read as source gives one error and no fact."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = files.sparkSession
    schema = spark.createDataFrame([], FACTS).schema
    return files.select("path", "content").mapInArrow(_parse(to_arrow_schema(schema)), schema)


def of_kind(all_facts: DataFrame, kind: str) -> DataFrame:
    return all_facts.where(all_facts["kind"] == kind).select(f"`{kind}`.*")
