import random
import re

import corpus_pipeline
from factweave.llm import packing, tokens

STOP = "the of and to in a is it that was for on".split()


def sentence(rng, n=60):
    words = [rng.choice(STOP) if i % 3 == 0 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for i in range(n)]
    return " ".join(words)


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    clean = [sentence(rng, 90) for _ in range(12)]
    items = [sentence(rng, 20) for _ in range(3)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows.append((100, clean[3], "en", "x", 1))  # exact copy
    rows.append((101, f"{clean[4][:200]} {items[0]} {sentence(rng)} {items[1]}", "en", "x", 1))  # two items
    rows.append((102, f"{sentence(rng)} {items[2]} {sentence(rng)}", None, None, None))  # one item
    rows.append((103, "short text", "en", "x", 1))
    rows.append((104, "buy ### now *** " * 40, "en", "x", 1))
    rows.append((105, f"{sentence(rng)} mail bob@mail.example.com or +1 (743) 555-3824 {sentence(rng)}", "en", "x", 1))
    rows += [(106, None, "en", "x", None), (107, "", "en", "x", 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = set(range(12))
    assert set(kept["quality_rules"]) == good | {100, 101, 102, 105}
    assert set(kept["near_dedup"]) == good | {101, 102, 105}
    assert set(kept["decontamination"]) == good | {102, 105}
    last = kept["personal_data"]
    assert {i: last[i] for i in good} == dict(enumerate(clean))
    assert items[2] not in last[102] and items[2].split()[5] + " " + items[2].split()[6] + " " + items[2].split()[7] not in last[102]
    assert "[EMAIL]" in last[105] and "[PHONE]" in last[105] and not re.search("bob@|555", last[105])
    t = tokens.Encoder(tokens.public(packing.VOCABULARY)).tokenizer
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in last.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
