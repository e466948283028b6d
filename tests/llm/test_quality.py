import re

from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x x", "l1\nl1\n \n\nl1 \nl2", "é🙂 ## <b>|", "\x0b\x0ca\rb nb", "w " * 60, "The cat and the dog. " * 3]


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Q.flags(df).select("row.doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines", "measures.n_repeat_words").collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_counts_as_brute_force(spark):
    assert got(spark, TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t\x0b é", max_size=40), min_size=1, max_size=12))
def test_any_text(spark, texts):
    assert got(spark, texts) == [brute(t) for t in texts]


def test_rules_and_columns(spark):
    good = "the quick brown fox and the lazy dog of that house are in a garden with many other things to see " * 1
    good = " ".join(f"{x}{i}" if i % 2 else x for i, x in enumerate((good * 4).split()))
    rows = [(1, good, "k", 1), (2, "same words here " * 40, None, 2), (3, "buy ### *** " * 30, "z", 3), (4, None, "k", 4), (5, good.upper() + "!!" * 90, "k", 5), (1, good, "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, measures string, kept int")
    assert Q.reject(df).columns == df.columns
    assert sorted(r.doc_id for r in Q.reject(df).collect()) == [1, 1]
    failed = {r.row.doc_id: set(r.failed) for r in Q.flags(df).collect()}
    assert "length" in failed[4] and "repeats" in failed[2] and "symbols" in failed[3] and "capitals" in failed[5] and failed[1] == set()
    one = Q.flags(df, rules=(Q.Rule("few", "n_words", None, 10),)).where("kept").select("row.doc_id").collect()
    assert [r.doc_id for r in one] == [4]
    assert Q.reject(df.limit(0)).collect() == []
