import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import packing, tokencounts, tokenfiles, tokens

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
HARD = ["", None, " ", "  ", "a  b", "a \n b", "a\n b", "a \nb", " lead", "trail ", "trail\n ", "x  y", "x  y", "it's we'll", "don 't", "\t\tq", "é ́x", "ÀÉ ǅ İ ΑΣ Σ", "<|endoftext|> a<|endoftext|>", "日本 語", "12 345 6", "a  b", "a \x1c b", "  \n\n  end", "🙂 👍🏽", "\x00 a", "a\x0b b\x0cc\r\nd", "naïve " * 50, "Word. WORD, word! wörd?! ÜBER. İstanbul. ſt. ﬁn, ŉ. ǆ. ßẞ. Ωmega. é. été.. co-op. x.y. End.\nNext\nline. \nx 5\nab 'q'\ns\n\nB. ª. ² a². don't. L'été."]


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public(name))
    t.encode_special_tokens = True
    return t


def split(ids, ends):
    return [x.tolist() for x in np.split(ids, ends[:-1])]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name):
    t, enc = plain(name), tokens.Encoder(tokens.public(name))
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in HARD]
    for _ in range(2):  # the second time from the cache
        assert split(*enc.encode(pa.array(HARD), 2)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sÉ́  　.,1<|>é漢\x1c\x85", max_size=30), min_size=1, max_size=8), st.sampled_from(NAMES))
def test_any_white_space(texts, name):
    t, enc = plain(name), tokens.encoder(tokens.public(name))
    assert split(*enc.encode(pa.array(texts))) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def documents(spark, extra=()):
    rows = [(5, "the quick brown fox " * 300, "a"), (1, None, "b"), (2, "", None), (9, "one", "c"), (9, "one", "c"), (None, "null id", "d"), (3, "# hash ## is id two", "e"), *extra]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_packing_round_trip(spark):
    rows, df = documents(spark)
    t, got = plain(packing.VOCABULARY), {}
    out = packing.pack(df).collect()
    for r in sorted(out, key=lambda r: r.start):
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.length == len(r.ids) // 4 and 1 << r.bucket == r.length
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert len({r.sequence_id for r in out}) == len(out)
    for d, text, _ in rows:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = got[d, len(want)]
        copies = 2 if d == 9 else 1
        assert len(pieces) % copies == 0
        one = pieces[::copies]
        assert sum((x for _, x in one), []) == want
        assert [s for s, _ in one] == np.cumsum([0, *(len(x) for _, x in one)])[:-1].tolist()


@given(st.lists(st.integers(1, 20_000), max_size=20))
def test_decompose(lengths):
    sizes, count = packing.decompose(np.array(lengths, np.int64))
    assert [int(x.sum()) for x in np.split(sizes, np.cumsum(count)[:-1])][: len(lengths)] == lengths


def test_token_files_round_trip(spark, tmp_path):
    rows, df = documents(spark)
    t = plain(tokenfiles.VOCABULARY)
    manifest = tokenfiles.write(df, str(tmp_path))
    back = sorted(tokenfiles.read(manifest).collect(), key=lambda r: r.ordinal)
    want = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back] == want
    assert [r.start for r in back] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert {r.width for r in manifest.collect()} == {2}


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rows, df = documents(spark)
    t = plain(tokenfiles.VOCABULARY)
    manifest = tokenfiles.write(df, str(tmp_path), end_id=tokencounts.END_OF_TEXT).collect()
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows)
    files = spark.createDataFrame([(f"{r.stem}.bin", r.width) for r in manifest], "path string, width int")
    for block in (1, 7, 1000, 1 << 20):
        got = tokencounts.count(files, block=block).collect()
        assert sorted(r.n_tokens for r in got) == want and all(r.ended for r in got)


def test_counts_query_has_the_ids_of_its_documents(spark, tmp_path, monkeypatch):
    t = plain(tokenfiles.VOCABULARY)
    rows = [(5, "one two"), (5, "one two"), (None, "three"), (7, None), (8, ""), (9, "a much longer text " * 50), (1, "<|endoftext|> inside"), (10, "é🙂")]
    for kind, name in ((lambda d: d, "long"), (lambda d: None if d is None else f"id{d}", "string")):
        spark.createDataFrame([(kind(d), x) for d, x in rows], f"doc_id {name}, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = sorted(((kind(d), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in rows), key=str)
        for block in (3, tokencounts.BLOCK):
            got = tokencounts.query(spark, f"{tmp_path}/{name}", block=block)
            assert got.columns == ["doc_id", "n_tokens"] and sorted((tuple(r) for r in got.collect()), key=str) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tokencounts.query(spark, f"{tmp_path}/none").collect() == []


def test_files_of_a_store_that_cannot_be_mapped(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    rows, df = documents(spark)
    manifest = tokenfiles.write(df, str(tmp_path)).collect()
    monkeypatch.setattr(tokenfiles, "READ_IDS", 5)
    read = lambda: [r for m in manifest for b in tokenfiles._read(iter([pa.RecordBatch.from_pylist([m.asDict()])])) for r in b.to_pylist()]
    near = read()
    store = lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path.lstrip("/"))
    monkeypatch.setattr(tokenfiles, "place", store)
    assert read() == near and len(near) == len(rows)
    stem = max(manifest, key=lambda m: m.n_docs).stem
    every = [x for a in tokenfiles.names(stem) for x in a.to_pylist()]
    for lo, hi in ((0, 2), (1, 3), (2, 2), (0, len(every))):
        assert [x for a in tokenfiles.names(stem, lo, hi) for x in a.to_pylist()] == every[lo:hi]


def test_separator_scan_edges(spark, tmp_path):
    for name, ids in (("none", []), ("open", [1, 2, 3]), ("ends", [7, 7, 1, 7, 5]), ("long", [1] * 10 + [7])):
        np.array(ids, "<u2").tofile(tmp_path / name)
    files = spark.createDataFrame([(str(tmp_path / n), 2) for n in ("none", "open", "ends", "long")], "path string, width int")
    got = sorted((r.path.rpartition("/")[2], r.ordinal, r.n_tokens, r.ended) for r in tokencounts.count(files, end_id=7, block=2).collect())
    assert got == [("ends", 0, 1, True), ("ends", 1, 1, True), ("ends", 2, 2, True), ("ends", 3, 1, False), ("long", 0, 11, True), ("open", 0, 3, False)]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).collect() == []
    assert tokenfiles.read(tokenfiles.write(none, str(tmp_path))).collect() == []


def test_crc_is_over_little_endian_ids(spark):
    _, df = documents(spark)
    for r in packing.digest(packing.pack(df)).join(packing.pack(df).select("sequence_id", "ids"), "sequence_id").collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
