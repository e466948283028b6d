"""Packing by power-of-two decomposition.

A document's ids (its end id included) are cut into pieces of 4096 and then of the powers of two in
the rest, largest first. Each piece is a sequence of its own, in the bucket of its length, so no
sequence crosses documents and none is padded. One pass over the documents, without a shuffle.

Defined results: a null or empty text has its end id only. Sequence ids are unique; their high bits
are the partition's number. Rows, ids and other columns of docs may repeat or be null: each row
is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import load
from factweave.llm.tokens import encoder, ids_binary, public, slices

MOST, END_ID, VOCABULARY = 4096, 2, "word_bpe_49k.json"


def decompose(lengths: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths in document order, and how many pieces each document has. `most` is a power of two."""
    bits = most.bit_length() - 1
    counts = np.empty((len(lengths), bits + 1), np.int64)
    counts[:, 0] = lengths >> bits
    for k in range(bits):
        counts[:, k + 1] = lengths >> (bits - 1 - k) & 1
    sizes = most >> np.arange(bits + 1)
    return np.repeat(np.tile(sizes, len(lengths)), counts.ravel()), counts.sum(axis=1)


def _cut(path: str, end_id: int, most: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(path), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 1):
                ids, ends = enc.encode(batch.column(1), end_id)
                tokens = np.diff(ends, prepend=0)
                length, count = decompose(tokens, most)
                stop = np.cumsum(length)
                row = np.repeat(np.arange(len(count)), count)
                start = stop - length - (ends - tokens)[row]
                seq = sequence + np.arange(len(length))
                sequence += len(length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)).cast(kind), pa.array(start), pa.array(length), ids_binary(ids, stop), pa.array(tokens[row]), pa.array(seq), pa.array(np.zeros(len(length), np.int64))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket (log2 of the length)."""
    if most & (most - 1) or most < 1:
        raise ValueError("most is a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    two = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = two.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    out = two.mapInArrow(_cut(tokenizer or public(VOCABULARY), end_id, most, to_arrow_type(kind)), schema)
    return out.withColumn("bucket", F.log2("length").cast("int"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir):
    return digest(pack(load(spark, sf_dir, "documents")))
