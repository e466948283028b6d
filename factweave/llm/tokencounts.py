"""Token counts from flat token files alone, by a separator scan.

Files are cut into blocks of a fixed number of ids, whatever documents they hold. A task searches its
block for the end-of-document id in one vectorised comparison and returns the places of ends. A
prefix scan over each file's blocks then gives the last end before a block and the documents before
it, so a document's length is the distance between two ends even where it spans many blocks.

The end id must not occur inside documents; the vocabulary's own end-of-text id never does, as
its string in a text is encoded as ordinary text.

Documents' ids lie beside the tokens in document order, so the task that holds a block's ends reads just
their range of ids.

Defined results: repeated, null and text ids stay as they are; ids after a file's last end count as a last document with ended = false. An empty file
has no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.session import checkpointed
from factweave.llm import tokenfiles
from factweave.llm.common import load

BLOCK, END_OF_TEXT = 1 << 22, 50256


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, at = tokenfiles.place(r["path"])
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(r["n"] * r["width"], r["first"] * r["width"]), f"<u{r['width']}")
                ends = np.flatnonzero(ids == end_id) + r["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]]), pa.array([r["first"]]), pa.array([r["first"] + r["n"]]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "first", "stop", "last_end", "n_ends", "ends"],
                )

    return run


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes come from the store, in the workers."""
        for batch in batches:
            for r in batch.to_pylist():
                store, at = tokenfiles.place(r["path"])
                n = store.get_file_info(at).size // r["width"]
                first = np.arange(0, n, block)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(first), pa.string()), pa.array([r["width"]] * len(first), pa.int32()), pa.array(first), pa.array(np.minimum(block, n - first))], ["path", "width", "first", "n"])

    return run


def scanned(files: DataFrame, end_id: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """files: path, width (bytes an id). A row per block: its ends, the last end before it (prev), the documents before it (done), and whether it is its file's last.

    The prefix scan sees a few numbers a block; the ends meet them again by block.
    """
    sizes = files.select("path", F.col("width").cast("int").alias("width")).mapInArrow(_blocks(block), "path string, width int, first long, n long")
    found = checkpointed(sizes.repartition("path", "first").mapInArrow(_scan(end_id), "path string, first long, stop long, last_end long, n_ends long, ends array<long>"))
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("path").orderBy("first")
    slim = found.select("path", "first", F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("prev"), F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("done"), F.lead("first").over(order).isNull().alias("final"))
    return found.join(slim, ["path", "first"])


def _lengths(prev: int, ends: np.ndarray) -> np.ndarray:
    """Distances between ends: the documents that end in a block."""
    return np.diff(ends, prepend=prev)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends = np.array(r["ends"], np.int64)
            n, ended = _lengths(r["prev"], ends), np.ones(len(ends), bool)
            last = r["prev"] if r["last_end"] is None else r["last_end"]
            if r["final"] and r["stop"] > last + 1:
                n, ended = np.append(n, r["stop"] - last - 1), np.append(ended, False)
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(n), pa.string()), pa.array(r["done"] + np.arange(len(n))), pa.array(n), pa.array(ended)], ["path", "ordinal", "n_tokens", "ended"])


def count(files: DataFrame, end_id: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """files: path, width (bytes an id). Returns path, ordinal (in the file), n_tokens (with the end id) and ended."""
    return scanned(files, end_id, block).mapInArrow(_counts, "path string, ordinal long, n_tokens long, ended boolean")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block's documents with their ids, which the task reads by ordinal from the file beside the tokens."""
    for batch in batches:
        for r in batch.to_pylist():
            n, at = _lengths(r["prev"], np.array(r["ends"], np.int64)), 0
            for ids in tokenfiles.names(r["path"].removesuffix(".bin"), r["done"], r["done"] + len(n)):
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[at : at + len(ids)])], ["doc_id", "n_tokens"])
                at += len(ids)


def named(files: DataFrame, id_type: str = "bigint", end_id: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of files that tokenfiles.write made; no row of a document is joined."""
    return scanned(files, end_id, block).mapInArrow(_named, f"doc_id {id_type}, n_tokens long")


def query(spark, sf_dir, block: int = BLOCK):
    """Token counts of documents: files are written first, then counted without their offsets."""
    docs = load(spark, sf_dir, "documents")
    made = tokenfiles.write(docs, end_id=END_OF_TEXT, ordered=False)
    n = max(1, made.count())
    files = made.select(F.concat("stem", F.lit(".bin")).alias("path"), "width").repartition(n)
    return named(files, docs.schema["doc_id"].dataType.simpleString(), block=block)
