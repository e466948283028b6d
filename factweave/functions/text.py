"""Text functions: globs, qualified names, path candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A Java regular expression for a glob. A single star crosses slashes; `**/` also matches nothing; braces list alternatives; brackets are classes."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}{')' * depth}$"


def qualified(parent: Column, name: Column) -> Column:
    """parent::name, or the name alone without a parent."""
    return F.concat_ws("::", parent, name)


def ancestors(segments: Column) -> Column:
    """Every prefix of a path's segments, longest first, joined by slashes."""
    n = F.size(segments)
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
