"""Tokens of Rust source text: kind, text, line, column. Comments and white space are dropped."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      |(?P<line>//[^\n]*)
      |(?P<block>/\*)
      |(?P<raw>\b(?:b|c)?r(?P<hash>\#*)".*?"(?P=hash))
      |(?P<str>(?:b|c)?"(?:[^"\\]|\\.)*")
      |(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')
      |(?P<life>'[A-Za-z_]\w*)
      |(?P<num>\d[\w]*(?:\.\d[\w]*)?(?:[eE][+-]?\d+)?)
      |(?P<id>(?:r\#)?[^\W\d]\w*)
      |(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|>>=|[+\-*/%^&|=!<>]=|.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int


class SourceError(ValueError):
    """Text that has no token structure, such as a comment without an end."""


def tokens(source: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise SourceError(f"no token at line {line}")
        kind, end = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
        if kind == "block":
            depth, end = 1, at + 2
            while depth:
                step = re.compile(r"/\*|\*/").search(source, end)
                if step is None:
                    raise SourceError(f"comment from line {line} has no end")
                depth += 1 if step[0] == "/*" else -1
                end = step.end()
        elif kind not in ("space", "line"):
            out.append(Token("str" if kind == "raw" else kind, source[at:end], line, at - start))
        if breaks := source.count("\n", at, end):
            line, start = line + breaks, source.rindex("\n", at, end) + 1
        at = end
    return out


CLOSES = {"(": ")", "[": "]", "{": "}"}


def closing(toks: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    stack = []
    for i in range(at, len(toks)):
        t = toks[i]
        if t.kind != "op":
            continue
        if t.text in CLOSES:
            stack.append(CLOSES[t.text])
        elif t.text in (")", "]", "}"):
            if not stack or stack.pop() != t.text:
                raise SourceError(f"unexpected {t.text} at line {t.line}")
            if not stack:
                return i
    raise SourceError(f"bracket of line {toks[at].line} isn't closed")
