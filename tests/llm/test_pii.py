import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from factweave.llm import pii

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in RAW.items()}


TEXTS = [
    None, "", "no data", "é🙂 mail a.b@c-d.example.com, x@y", "a@b.c_x@d.e a@b.c+x@d.e@f.g", "@@ a@ @b.c a@b..c a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 999999999999999999999.1.1.1 1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111 1111 1111", "1234567812345670 12345678123456701234 4785380592391139$$$", "+1 (743) 555-3824 +1 2 +12345678901234567890 ++49 30 1234567) +1 (743) 555-3824",
    "x" * 30000, "1 " * 20000, "a." * 20000 + "@", "9" * 20000, ("mail q%d@w.example.org " % 7) * 300, "+1-" * 5000, "ﬀ٣٤ 1.2.3.٤ ١٢٣",
]


def test_base_spans_as_plain_regular_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in pii.scan(df, min_joint=1000).collect():
        want = brute(r.row.text)
        for k in pii.PATTERNS:
            assert [(s.start, s.end) for s in r[k]] == want[k], (k, (r.row.text or "")[:60])
        assert r.term == []


def corpus():
    rows, n = [], 0
    for i in range(40):
        rows.append((n := n + 1, f"Plain words number {'abcdefghij'[i % 10] * 5} appear commonly everywhere here {'qwertyuiop'[i // 4] * 4}"))
    for i in range(6):
        rows.append((n := n + 1, f"Ask Zanzibarov of commonly Kestrelton {'lmnopq'[i] * 4} at z.k@mail.example.com or zanzibarov"))
    rows.append((n := n + 1, "commonly rare@one.example.com Singular"))
    rows += [(n + 1, rows[-1][1]), (n + 2, rows[-1][1]), (n + 3, None), (None, rows[41][1])]
    return rows


def contexts(text, letters, near):
    """(entity, words around it) of each valid value."""
    for k, p in RAW.items():
        last, found = 0, list(re.finditer(p, text))
        gaps = [text[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)], strict=True)]
        words = [re.findall(rf"[^\W\d_]{{{letters},}}", g.lower()) for g in gaps]
        for i, m in enumerate(found):
            if valid(k, m[0]):
                yield (k, m[0].lower()), {*words[i][-near:], *words[i + 1][:near]}


def brute_terms(rows, min_joint, c, letters=4, prior=0.0, near=10):
    every = [t or "" for _, t in rows]
    terms = {t: set(re.findall(rf"[^\W\d_]{{{letters},}}", t.lower())) for t in every}
    ents = {t: defaultdict(set) for t in every}
    for t in ents:
        for e, w in contexts(t, letters, near):
            ents[t][e] |= w
    n, out = len(every), {t: set() for t in every}
    for t in set(every):
        for e in ents[t]:
            d_e = sum(e in ents[x] for x in every)
            for w in ents[t][e]:
                both = [x for x in every if e in ents[x] and w in ents[x][e]]
                pmi = math.log2(n / d_e * (len(both) + prior * d_e / n) / (sum(w in terms[x] for x in every) + prior))
                if len(set(both)) >= min_joint and pmi >= c * math.log2(n / d_e) and pmi > 0:
                    out[t].add(w)
    return out


def test_terms_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_joint, c in ((5, 0.8), (2, 0.3), (1, 0.95)):
        want = brute_terms(rows, min_joint, c)
        for r in pii.scan(df, min_joint=min_joint, disclosure=c).collect():
            t = r.row.text or ""
            base = [s for v in brute(t).values() for s in v]
            spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in want[t] and not any(a < m.end() and m.start() < b for a, b in base)]
            assert [(s.start, s.end) for s in r.term] == spans
    assert {"zanzibarov", "kestrelton"} <= brute_terms(rows, 5, 0.8)[rows[41][1]] and "commonly" not in brute_terms(rows, 5, 0.8)[rows[41][1]]


def test_sanitise_and_columns(spark):
    rows = [(*r, f"s{i}", i) for i, r in enumerate(corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, row int")
    out = {r.row: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and len(out) == len(rows)
    assert out[40].text == "Ask [TERM] of commonly [TERM] llll at [EMAIL] or [TERM]"
    assert out[0].text == rows[0][1] and out[50].text is None if rows[50][1] is None else True
    assert pii.sanitise(df.limit(0)).collect() == []


def test_overlaps_are_covered_once(spark):
    df = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y")], "doc_id long, text string")
    got = pii.sanitise(df).first().text
    assert "1" not in got and got.startswith("x ") and got.endswith(" y")


def test_digest(spark):
    s = pii.with_base(spark.createDataFrame([("a@b.c 1.2.3.4",)], "t string")).select(pii.listed(tuple(pii.PATTERNS)).alias("x"), F.sha2(pii.listed(tuple(pii.PATTERNS)), 256).alias("h")).first()
    assert s.x == "email:0:5,ip:6:13" and s.h == hashlib.sha256(s.x.encode()).hexdigest()


def test_names_beside_values_that_stand_in_one_text(spark, tmp_path):
    rows = [(i, f"common words stand here and there {'abcdefghij'[i % 10] * 2}") for i in range(300)]
    rows.append((300, "common words and there: write to Kim Kestrelton, k.k@one.example.com or +1 (743) 555-3824"))
    rows.append((301, rows[300][1]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    for i in (300, 301):
        got = {rows[i][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].spans.split(",")) if k == "term"}
        assert {"Kim", "Kestrelton"} <= got and not got & {"common", "words", "and", "there"}
    assert out[0].spans == ""
    clean = pii.sanitise(spark.createDataFrame(rows[299:], "doc_id long, text string"), **pii.WHOLE)
    assert "text" in clean.columns and clean.count() == 3


def test_whole_estimate_as_brute_force(spark):
    rows = corpus()
    rows += [(900 + i, f"Bo {'xyz'[i]}{'xyz'[i]} two@one.example.com b{i % 2}@one.example.com 1.2.3.{i} commonly words") for i in range(3)]
    want = brute_terms(rows, 1, 0.8, 1, 1.0)
    assert "singular" in want["commonly rare@one.example.com Singular"] and "bo" in want[rows[-1][1]]
    for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **pii.WHOLE).collect():
        t = r.row.text or ""
        base = [s for v in brute(t).values() for s in v]
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in want[t] and not any(a < m.end() and m.start() < b for a, b in base)]
        assert [(s.start, s.end) for s in r.term] == spans, t


def test_contexts_end_after_so_many_words(spark):
    far = " ".join(f"w{c}" for c in "abcdefghijkl")
    rows = [(i, f"plain {far}") for i in range(200)] + [(500, f"Kestrelton {far} near it x@y.example.org beside {far} Zanzibarov, Kestrelton again")]
    for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), **{**pii.WHOLE, "near": 3}).collect():
        got = [s.value for s in r.term]
        assert got == (["near", "it", "beside"] if r.row.doc_id == 500 else [])
    assert {"near", "it", "beside"} == brute_terms(rows, 1, 0.8, 1, 1.0, 3)[rows[-1][1]]


def test_many_values_in_a_long_text_take_linear_time(spark):
    import time

    n = 60_000
    text = " ".join(f"word{i % 977} mail u{i}@w{i % 50}.example.org" if i % 4 == 0 else f"some{chr(97 + i % 26)}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.text for r in pii.sanitise(df, **pii.WHOLE).collect()}
    took = time.time() - began
    assert "@" not in out[1] and out[1].count("[EMAIL]") == n // 4 and out[2] == "short" and took < 90, took


def brute_whole(rows, min_joint=1, c=0.8, letters=1, prior=1.0):
    """Terms of each text, every document as a whole the context of its values."""
    every = [t or "" for _, t in rows]
    terms = {t: set(re.findall(rf"[^\W\d_]{{{letters},}}", t.lower())) for t in every}
    own = {t: set(re.findall(rf"[^\W\d_]{{{letters},}}", re.sub(RAW["email"], "_", t).lower())) for t in every}
    ents = {t: {(k, m[0].lower()) for k, p in RAW.items() for m in re.finditer(p, t) if valid(k, m[0])} for t in every}
    n, out = len(every), {t: set() for t in every}
    for t in set(every):
        for e in ents[t]:
            d_e = sum(e in ents[x] for x in every)
            for w in own[t]:
                both = [x for x in every if e in ents[x] and w in own[x]]
                pmi = math.log2(n / d_e * (len(both) + prior * d_e / n) / (sum(w in terms[x] for x in every) + prior))
                if len(set(both)) >= min_joint and pmi >= c * math.log2(n / d_e) and pmi > 0:
                    out[t].add(w)
    return out


def test_terms_far_from_a_value(spark, tmp_path):
    far = " ".join(f"w{c}" for c in "abcdefghijklmnopq")
    rows = [*corpus(), *((800 + i, f"plain {far}") for i in range(200))]
    rows += [(600, f"Kestrelfar {far} near it x@y.example.org beside {far} Zanzifar, 1.2.3.4"), (601, f"Bo {far} a@b.example.org {far} commonly c@d.example.org {far} Kim"), (602, f"Bo c@d.example.org {far} Kim a@b.example.org words")]
    rows.append((603, rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_whole(rows)
    assert {"kestrelfar", "zanzifar", "near"} <= want[rows[-4][1]] and {"bo", "kim"} <= want[rows[-1][1]]
    text = {i: t or "" for i, t in rows}
    for r in pii.query(spark, str(tmp_path)).collect():
        t = text[r.doc_id]
        got = {t[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
        assert got == want[t], t
