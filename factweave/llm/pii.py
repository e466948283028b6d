"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Places come from
built-in functions: a text splits at the matches, and running sums of piece and match lengths are
the spans (code points, end exclusive).

Terms: every distinct base value is a protected entity e, and its context the whole document (near=None, as the query and
the pipeline have it) or the `near` words before and after it, up to the next value of its pattern. Over all documents, N of them, with D(x) the number that hold x and D(t, e)
the number with t in a context of e, IC(e) = log2(N / D(e)) is what e is worth and PMI(t, e) =
log2(N * P(e | t) / D(e)) what a term t tells of it, where P(e | t) = (D(t, e) + prior * D(e) / N) / (D(t) + prior):
the share of t's documents that name e, drawn by `prior` documents towards what chance would give. Where a term was
seen with an entity in `min_joint` different texts or more and PMI >= `disclosure` * IC, it is a span (kind
term) wherever it stands in the documents that name the entity in its context.

Personal values hardly recur, so the query and the pipeline take WHOLE: one joint text is enough, words of
any length count, and a prior of one document keeps few sightings from counting as certainty. Without a
prior, a support of several texts is the guard instead; entities of fewer texts then disclose nothing.
Contexts of some words keep rare words that merely share a long document with a value, and lose terms that disclose
it from further away.

Only documents with base spans go through joins; all others pass in a narrow projection. Document counts of terms
are taken over the whole corpus, partially aggregated before the shuffle; pairs of equal figures are
rated once, so a common term is one row; documents meet their terms by a 128-bit hash of the text and a salt.
Everything is built-in expressions, linear in text and matches.

Defined results: null text is empty and has no spans. Repeated rows have the same spans. Numbers of
any length are handled as text. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed
from factweave.llm.common import cut, kept_column, load, text_key, uncovered, with_running

#: In the order that results list them. A lookbehind (or the end of the last match) only saves
#: attempts that fail anyway, so long runs cost linear time; possessive loops need no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
KINDS = (*PATTERNS, "term")
MIN_JOINT, DISCLOSURE, MIN_LETTERS, NEAR = 5, 0.8, 4, 10
#: Salts of the join of documents with their terms, and characters of a block that pieces are cut from.
SALTS, PIECE = 16, 4096
#: What the query and the pipeline estimate with: rare values and short names count.
WHOLE = {"min_joint": 1, "letters": 1, "prior": 1.0}
#: The same over whole documents: a term may stand anywhere in a document with the value.
EVERYWHERE = {**WHOLE, "near": None}
SPAN = "array<struct<start:int,end:int,value:string>>"


def with_spans(df: DataFrame, text: str, pattern: str | Column, out: str, needs: Column | None = None, near: int = 0, letters: int = 1) -> DataFrame:
    """df with an array of (start, end, value) for the pattern's matches, leftmost and non-overlapping. With near, each also has the lower-cased words (of so many letters) around it, up to the next match."""
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))  # lit() leaves a column as it is
    none = F.array()
    df = df.withColumn("_v", F.when(needs, found).otherwise(none.cast("array<string>")) if needs is not None else found)
    df = df.withColumn("_p", F.when(F.size("_v") > 0, F.split(t, pattern, -1)).otherwise(none.cast("array<string>")))
    ahead = lambda v, i: F.length(F.get("_p", i)) + F.when(i > 0, F.length(F.get("_v", F.greatest(i - 1, F.lit(0))))).otherwise(F.lit(0))
    df = df.withColumn("_n", kept_column("_p", F.transform("_v", ahead)))
    df = with_running(df, "_n", "_r")
    fields = lambda v, i: [(F.get("_r", i) + F.get("_n", i)).alias("start"), (F.get("_r", i) + F.get("_n", i) + F.length(v)).alias("end"), v.alias("value")]
    if not near:
        return df.withColumn(out, kept_column("_r", F.transform("_v", lambda v, i: F.struct(*fields(v, i)))).cast(SPAN)).drop("_v", "_p", "_n", "_r")
    df = df.withColumn("_w", F.transform("_p", lambda p: words(p, letters)))
    left = lambda i: F.slice(F.get("_w", i), F.greatest(F.size(F.get("_w", i)) - near, F.lit(0)) + 1, F.lit(near))
    around = lambda i: F.array_distinct(F.concat(left(i), F.slice(F.get("_w", i + 1), F.lit(1), F.lit(near))))
    each = F.transform("_v", lambda v, i: F.struct(*fields(v, i), around(i).alias("near")))
    return df.withColumn(out, kept_column("_w", each)).drop("_v", "_p", "_n", "_r", "_w")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48)
    worth = F.transform(each, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0


CHECKS = {
    "ip": lambda x: F.forall(F.split(x["value"], r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")),
    "card": lambda x: F.when(F.length(digits(x["value"])).between(16, 19), luhn(digits(x["value"]))).otherwise(F.lit(False)),
    "phone": lambda x: F.length(digits(x["value"])).between(8, 15),
}


def with_base(df: DataFrame, text: str = "t", near: int = 0, letters: int = 1) -> DataFrame:
    """df with a column of spans for each base kind."""
    for kind, pattern in PATTERNS.items():
        df = with_spans(df, text, pattern, kind, NEEDS[kind](F.col(text)), near, letters)
        if kind in CHECKS:
            df = df.withColumn(kind, F.filter(kind, CHECKS[kind]))
    return df


def _each(kind: str, f) -> Column:
    return F.transform(kind, lambda x: f(x, kind))


def words(text: Column, letters: int = MIN_LETTERS) -> Column:
    """Lower-cased words of so many letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{letters},}}"), F.lit(0))


def _based(docs: DataFrame, text: str, near: int, letters: int) -> DataFrame:
    """row, t and base spans. A generator of one row stands between, so that filters above don't repeat the patterns' expressions below."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t.alias("t"))
    rows = with_base(rows, near=near, letters=letters).select("row", "t", F.explode_outer(F.array(F.struct(*PATTERNS))).alias("x"))
    return rows.select("row", "t", "x.*")


HOLDS = " + ".join(f"size({k})" for k in PATTERNS) + " > 0"


def disclosing(docs: DataFrame, held: DataFrame, text: str = "text", min_joint: int = MIN_JOINT, disclosure: float = DISCLOSURE, letters: int = MIN_LETTERS, prior: float = 0.0) -> DataFrame:
    """key, terms: the terms to sanitise in each text. held: key and base spans with contexts, a row for each document that has any."""
    named = F.concat(*(_each(k, lambda x, k: F.struct(F.concat(F.lit(f"{k}:"), F.lower(x["value"])).alias("e"), x["near"].alias("near"))) for k in PATTERNS))
    held = held.select("key", named.alias("ents"))
    both = F.flatten(F.transform("ents", lambda x: F.transform(x["near"], lambda w: F.concat(x["e"], F.lit("\n"), w))))  # neither side holds a line break
    pairs = checkpointed(held.select("key", F.explode(F.array_distinct(both)).alias("pair")).groupBy("key", "pair").agg(F.count("*").alias("m")))
    joint = pairs.groupBy("pair").agg(F.count("*").alias("texts"), F.sum("m").alias("d_te")).where(F.col("texts") >= min_joint)
    joint = joint.select("pair", F.substring_index("pair", "\n", 1).alias("entity"), F.substring_index("pair", "\n", -1).alias("term"), "d_te")
    d_e = held.select(F.explode(F.array_distinct(F.transform("ents", lambda x: x["e"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("d_e"))
    joint = checkpointed(joint.join(d_e, "entity").select("pair", "term", "d_te", "d_e"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    every = docs.select(F.explode(F.array_distinct(words(t, letters))).alias("term")).groupBy("term").agg(F.count("*").alias("d_t"))
    rated = joint.select("term", "d_te", "d_e").distinct().join(every, "term")
    n = F.lit(float(docs.count()))
    pmi = F.log2(n / F.col("d_e") * (F.col("d_te") + prior * F.col("d_e") / n) / (F.col("d_t") + prior))
    rated = rated.where((pmi >= disclosure * F.log2(n / F.col("d_e"))) & (pmi > 0)).select("term", "d_te", "d_e")
    told = joint.join(rated, ["term", "d_te", "d_e"], "left_semi").select("pair")
    return checkpointed(pairs.join(told, "pair", "left_semi").groupBy("key").agg(F.collect_set(F.substring_index("pair", "\n", -1)).alias("terms")))


def disclosing_whole(docs: DataFrame, held: DataFrame, text: str = "text", min_joint: int = MIN_JOINT, disclosure: float = DISCLOSURE, letters: int = MIN_LETTERS, prior: float = 0.0) -> DataFrame:
    """key, terms as disclosing() gives them, with the whole document outside its addresses as the context of each of its entities.

    Entities of the same texts have the same figures with every term, so they count as one class (a 128-bit hash of the set of
    texts). Classes of a single text need no pairs: every term of it has D(t, e) = D(e). The others meet those terms of their
    texts that could pass at best, with D(t, e) = min(D(t), D(e)); that leaves out none that passes."""
    n = F.lit(float(docs.count()))
    many = held.groupBy("key").agg(F.count("*").cast("double").alias("m"))
    named = F.array_distinct(F.concat(*(_each(k, lambda x, k: F.concat(F.lit(f"{k}:"), F.lower(x["value"]))) for k in PATTERNS)))
    bare = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    bare = F.when(F.size("email") > 0, F.regexp_replace(bare, PATTERNS["email"], "_")).otherwise(bare)
    ents = checkpointed(held.select("key", F.explode(named).alias("entity")).distinct().join(many, "key"))
    a, b = (F.bit_xor(F.xxhash64("key", F.lit(k))) for k in (1, 2))
    of = ents.groupBy("entity").agg(F.struct(a.alias("a"), b.alias("b"), F.count("*").alias("texts"), F.sum("m").alias("d_e")).alias("c"))
    classed = checkpointed(ents.select("key", "entity").join(of, "entity").select("key", "c").distinct())
    every = docs.select(F.explode(F.array_distinct(words(F.coalesce(F.col(f"`{text}`"), F.lit("")), letters))).alias("term")).groupBy("term").agg(F.count("*").alias("d_t"))
    terms = held.select("key", F.explode(F.array_distinct(words(bare, letters))).alias("term")).distinct().join(many, "key")
    terms = checkpointed(terms.join(every, "term"))

    def told(d_te: Column, d_e: Column) -> Column:
        pmi = F.log2(n / d_e * (d_te + prior * d_e / n) / (F.col("d_t") + prior))
        return (pmi >= disclosure * F.log2(n / d_e)) & (pmi > 0)

    one = classed.where("c.texts = 1").select("key").distinct()
    here = terms.where(told(F.col("m"), F.col("m"))).join(one, "key", "left_semi").select("key", "term")
    here = here if min_joint <= 1 else here.limit(0)
    best = F.least(F.col("d_t").cast("double"), F.col("c.d_e"))
    pairs = checkpointed(classed.where((F.col("c.texts") > 1) & (F.col("c.texts") >= min_joint)).join(terms, "key").where(told(best, F.col("c.d_e"))).select("key", "c", "term", "d_t", "m"))
    sums = pairs.groupBy("c", "term", "d_t").agg(F.sum("m").alias("d_te"), F.count("*").alias("joint")).where(F.col("joint") >= min_joint)
    shared = pairs.join(sums.where(told(F.col("d_te"), F.col("c.d_e"))).select("c", "term"), ["c", "term"], "left_semi").select("key", "term")
    return checkpointed(here.union(shared).groupBy("key").agg(F.collect_set("term").alias("terms")))


def _alternatives(terms: Column) -> Column:
    """A pattern that matches any of the terms as a whole word in any case; terms share a group by their first letter."""
    first = F.array_distinct(F.transform(terms, lambda w: F.substring(w, 1, 1)))
    groups = F.transform(first, lambda c: F.concat(c, F.lit("(?:"), F.array_join(F.transform(F.filter(terms, lambda w: F.startswith(w, c)), lambda w: F.substring(w, F.lit(2), F.length(w))), "|"), F.lit(")")))
    return F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(groups, "|"), F.lit(r")(?!\p{L})"))


def scan(docs: DataFrame, text: str = "text", min_joint: int = MIN_JOINT, disclosure: float = DISCLOSURE, letters: int = MIN_LETTERS, prior: float = 0.0, near: int | None = NEAR) -> DataFrame:
    """row (struct of docs' columns), t (the text, null as empty) and an array of spans (start, end, value) for each of KINDS."""
    t = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    based = _based(docs, text, near or 0, letters)
    held = checkpointed(based.where(HOLDS).select(text_key(F.col("t")).alias("key"), "row", *PATTERNS))
    found = (disclosing_whole if near is None else disclosing)(docs, held, text, min_joint, disclosure, letters, prior)
    spans = [_each(k, lambda x, k: F.struct(x["start"], x["end"], x["value"])).cast(SPAN).alias(k) for k in PATTERNS]
    rows = held.select("key", "row", *spans, F.floor(F.rand(7) * SALTS).cast("int").alias("salt"))
    found = found.select("key", "terms", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(found, ["key", "salt"], "left").drop("key", "salt").withColumn("t", t)
    # words beside an address are looked for with the address blanked, so no term overlaps one
    blank = F.concat(_each("email", lambda x, _: F.repeat(F.lit("_"), x["end"] - x["start"])), F.array(F.lit("")))
    blanked = F.array_join(F.zip_with(F.split("t", PATTERNS["email"], -1), blank, lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn("_m", F.when(F.size("email") > 0, F.when(F.col("terms").isNotNull(), blanked).otherwise(F.col("t"))).otherwise(F.col("t")))
    rows = rows.withColumn("_a", F.when(F.col("terms").isNotNull(), _alternatives(F.col("terms"))).otherwise(F.lit(r"(?!)")))
    rows = with_spans(rows, "_m", F.col("_a"), "term", F.col("terms").isNotNull()).drop("_m", "_a", "terms")
    plain = based.where(f"not ({HOLDS})").select("row", "t", *spans, F.array().cast(SPAN).alias("term"))
    return plain.unionByName(rows)


def listed(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.concat(*(_each(k, lambda x, k: F.concat(F.lit(f"{k}:"), x["start"], F.lit(":"), x["end"])) for k in kinds)), ",")


def sanitise(docs: DataFrame, text: str = "text", min_joint: int = MIN_JOINT, disclosure: float = DISCLOSURE, letters: int = MIN_LETTERS, prior: float = 0.0, near: int | None = NEAR) -> DataFrame:
    """docs with each span generalised to its kind in brackets; the first of overlapping spans covers the others. Same columns; texts without spans stay."""
    s = scan(docs, text, min_joint, disclosure, letters, prior, near)
    every = F.concat(*(_each(k, lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("as"))) for k in KINDS))
    s = s.withColumn("_s", F.sort_array(every)).withColumn("_e", F.transform("_s", lambda x: x["end"]))
    s = with_running(s, "_e", "_r", most=True).withColumn("_u", uncovered("_s", "_r"))
    s = s.withColumn("_b", F.when(F.size("_s") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    pieces = F.transform("_u", lambda x: F.concat(cut("_b", x["from"], x["span"]["start"], PIECE), x["span"]["as"]))
    clean = F.concat(F.array_join(pieces, ""), cut("_b", F.array_max("_e"), F.length("t"), PIECE))
    new = F.when(F.size("_s") > 0, clean).otherwise(F.col(f"row.`{text}`"))
    return s.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    s = scan(load(spark, sf_dir, "documents").select("doc_id", "text"), **EVERYWHERE)
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return s.select("row.doc_id", *(n(k) for k in PATTERNS), F.sha2(listed(tuple(PATTERNS)), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
