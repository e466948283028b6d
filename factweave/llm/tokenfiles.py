"""Token files: flat unsigned ids in document order, with 64-bit document offsets beside them.

Documents are range-partitioned and sorted by (id, hash of the text). Each task streams its ids to a file of its
own in the shared folder, named by partition and a fresh token, so a task that runs twice never
writes into the file of its first run; the manifest, one row per partition, names the files that
count. Bases of partitions are prefix sums over the manifest. Files:

- <part>.bin: ids, 16 bits where the vocabulary fits, else 32, little-endian, nothing else;
- <part>.idx: 64-bit offsets (in ids) of each document and of the end;
- <part>.doc: the document ids, as an Arrow file (any type, nulls allowed).

Readers map files into memory where the folder is local to them (mounted); from any other store they
read the ranges they need, so memory is bounded by a batch of documents either way.

Defined results: null texts are empty; an empty text has its end id only; null ids come first; repeated
rows are documents of their own; an empty table gives no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factweave.functions.session import shared_dir
from factweave.llm.common import load
from factweave.llm.tokens import encoder, ids_binary, public, slices

END_ID, VOCABULARY, READ_IDS, ENCODE_BYTES = 2, "byte_bpe_50k.json", 1 << 21, 8 << 20
MANIFEST = "part long, stem string, width int, n_docs long, n_tokens long, doc_base long, token_base long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(out: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = "<u2" if max(enc.vocab - 1, end_id) < 1 << 16 else "<u4"
        store, stem = place(f"{out}/{part:06d}-{uuid.uuid4().hex}")
        store.create_dir(stem.rpartition("/")[0], recursive=True)
        n_docs = n_tokens = 0
        opened = None
        for whole in batches:
            for batch in slices(whole, 1, ENCODE_BYTES):
                if opened is None:
                    opened = store.open_output_stream(f"{stem}.bin"), store.open_output_stream(f"{stem}.idx"), store.open_output_stream(f"{stem}.doc")
                    names = pa.ipc.new_file(opened[2], pa.schema([pa.field("doc_id", batch.schema.field(0).type)]))
                    opened[1].write(np.zeros(1, "<i8").tobytes())
                ids, ends = enc.encode(batch.column(1), end_id)
                opened[0].write(ids.astype(kind).tobytes())
                opened[1].write((ends + n_tokens).astype("<i8").tobytes())
                names.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"]))
                n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + int(ends[-1])
        if opened is not None:
            names.close()
            for f in opened:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "stem": [stem if store.type_name == "local" else f"{out}/{stem.rpartition('/')[2]}"], "width": pa.array([int(kind[2])], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return run


def write(docs: DataFrame, out: str | None = None, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, ordered: bool = True) -> DataFrame:
    """Writes the files (with ordered = False in the order of docs' own partitions, without a shuffle) and returns the manifest: part, stem, width (bytes an id), n_docs, n_tokens, doc_base, token_base. One row per partition comes to the driver, no document does."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    two = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if ordered:  # the sample of range bounds holds no text
        two = two.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = two.mapInArrow(_write(out, tokenizer or public(VOCABULARY), end_id), "part long, stem string, width int, n_docs long, n_tokens long").collect()
    rows.sort(key=lambda r: r.part)
    sums = [list(accumulate((r[k] for r in rows), initial=0)) for k in ("n_docs", "n_tokens")]
    return spark.createDataFrame([(*r, d, t) for r, d, t in zip(rows, *(s[:-1] for s in sums), strict=True)], MANIFEST)


class Flat:
    """A file of numbers: mapped where it is local, else read by ranges."""

    def __init__(self, path: str, kind: str):
        store, at = place(path)
        self.kind, self.size = np.dtype(kind), store.get_file_info(at).size // np.dtype(kind).itemsize
        self.map = np.memmap(at, dtype=kind, mode="r") if store.type_name == "local" and self.size else None
        self.file = None if self.map is not None else store.open_input_file(at)

    def slice(self, lo: int, hi: int) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[lo:hi])
        return np.frombuffer(self.file.read_at((hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def names(stem: str, lo: int = 0, hi: int | None = None) -> Iterator[pa.Array]:
    """Ids of the documents from lo to hi in a file, by batches as they were written."""
    store, at = place(f"{stem}.doc")
    reader = pa.ipc.open_file(pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at))
    n = 0
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        first, last = max(lo - n, 0), batch.num_rows if hi is None else min(hi - n, batch.num_rows)
        if first < last:
            yield batch.column(0).slice(first, last - first)
        n += batch.num_rows
        if hi is not None and n >= hi:
            break


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            flat, idx = Flat(f"{r['stem']}.bin", f"<u{r['width']}"), Flat(f"{r['stem']}.idx", "<i8")
            first = 0
            for docs in names(r["stem"]):
                ends, lo = idx.slice(first, first + len(docs) + 1), 0
                while lo < len(docs):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + READ_IDS, "right")) - 1)
                    start, own = int(ends[lo]), ends[lo + 1 : hi + 1]
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(lo, hi - lo), pa.array(r["doc_base"] + first + np.arange(lo, hi)), pa.array(r["token_base"] + ends[lo:hi]), pa.array(np.diff(own, prepend=start)), ids_binary(flat.slice(start, int(own[-1])).astype("<u4"), own - start)],
                        ["doc_id", "ordinal", "start", "n_tokens", "ids"],
                    )
                    lo = hi
                first += len(docs)


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents from the files: doc_id, ordinal, start, n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_read, f"doc_id {id_type}, ordinal long, start long, n_tokens long, ids binary")


def query(spark, sf_dir):
    back = read(write(load(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
