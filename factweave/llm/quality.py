"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each rule is a row (name, ratio, lower bound, upper bound). compile_rules() turns the table into
columns of the same projection; no user function and no shuffle is involved, so a run costs one
scan and any number of rules is evaluated per row.

Defined results: a null or empty text has no words and fails. Ratios over no words or no lines
are 0. Other columns, whatever their names, pass through flags() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import SPACE, adjacent_sum, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is it that was for on are with as at be this have from or an by not but what all were when we there can "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach im dem "
    "le la les de des du et en un une que qui est pour dans sur par au pas plus ce il se ne sont avec son "
    "el los las y del se por con para una su al lo como más pero sus o este si ya"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text passes where least <= value <= most; a bound of None is open."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Values are names of measures().
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("repeats", "repeat_ratio", None, 0.5),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("word_length", "mean_word_chars", 1.5, 14.0),
    Rule("capitals", "capital_ratio", None, 0.4),
    Rule("shouting", "exclaim_ratio", None, 0.3),
    Rule("same_lines", "dup_line_ratio", None, 0.5),
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first place included. Sorts (window, place) within the row, marks windows equal to a neighbour and sums the places they cover."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("p")))
    return F.when(n >= 3, F.sort_array(windows))


def repeated_places(ordered: Column) -> Column:
    same = lambda x, k: F.get(ordered, k)["w"] == x["w"]
    marked = F.transform(ordered, lambda x, k: F.when(same(x, k + 1) | (k > 0) & same(x, F.greatest(k - 1, F.lit(0))), x["p"]))
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column m, a struct of counts and ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn("_o", repeat_words(F.col("_w")))
    df = df.withColumn("_p", repeated_places(F.col("_o"))).withColumn("_l", lines)
    n = F.size("_w").cast("long")
    forms = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), f"{w},", f"{w}.")})
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": adjacent_sum(F.coalesce(F.col("_p"), F.array().cast("array<int>")), 3),
        "n_stop": F.size(F.filter("_w", lambda w: w.isin(forms))).cast("long"),
        "n_capital": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_exclaim": F.regexp_count(t, F.lit("!")).cast("long"),
    }
    df = df.withColumn("m", F.struct(*(v.alias(k) for k, v in counts.items())))
    over = lambda a, b: F.when(F.col(f"m.{b}") > 0, F.col(f"m.{a}") / F.col(f"m.{b}")).otherwise(F.lit(0.0))
    ratios = {
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_ratio": over("n_stop", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "capital_ratio": over("n_capital", "word_chars"),
        "exclaim_ratio": over("n_exclaim", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
    }
    return df.withColumn("m", F.struct("m.*", *(v.alias(k) for k, v in ratios.items()))).drop("_w", "_o", "_p", "_l")


def compile_rules(rules: tuple[Rule, ...], of: str = "m") -> list[Column]:
    """One boolean column per rule: true where the text fails it."""
    out = []
    for r in rules:
        v, fails = F.col(f"{of}.{r.value}"), F.lit(False)
        if r.least is not None:
            fails = fails | (v < r.least)
        if r.most is not None:
            fails = fails | (v > r.most)
        out.append(fails.alias(r.name))
    return out


def flags(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs, then measures (struct), failed (array of rule names) and kept (boolean)."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("t"))
    df = measures(inner, "t")
    failed = F.filter(F.array(*(F.when(c, F.lit(r.name)) for r, c in zip(rules, compile_rules(rules), strict=True))), lambda x: x.isNotNull())
    df = df.select("row", F.col("m").alias("measures"), failed.alias("failed"))
    return df.withColumn("kept", F.size("failed") == 0)


def reject(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with their own columns only.

    A plain filter would be pushed below the projections and repeat their nested expressions many times over; rows
    pass through an outer generator instead, whose output it can't be pushed below.
    """
    passed = F.explode_outer(F.when(F.col("kept"), F.array("row")))
    return flags(docs, text, rules).select(passed.alias("row")).where(F.col("row").isNotNull()).select("row.*")


def query(spark, sf_dir):
    from factweave.llm.common import load

    q = flags(load(spark, sf_dir, "documents"))
    m = lambda c: F.col(f"measures.{c}")
    q = q.select(F.col("row.doc_id"), *(m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "kept")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))
