"""Token ids by the tokenizers library, for Arrow columns of whole texts.

A text is cut where no token can cross, each distinct piece goes through the library once per batch
(or comes from a bounded cache in the worker), and ids are gathered by piece. Cuts depend on the
tokenizer's own pipeline:

- byte-level pre-tokenizer without normalizer: before each single space. White space before such a
  space that isn't followed by a word character would be read differently in two pieces, so texts
  with white space on both sides of a space (or before a final one) aren't cut;
- a split that drops white space: at ASCII white space;
- anything else: not at all.

Strings of special tokens in a text are ordinary text. A null text is empty.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Anything that some regular-expression engine takes as white space.
_WIDE = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}\pZ]"
_UNSAFE = f"{_WIDE} ({_WIDE}|$)|\\x00"
#: Marks after a letter and before white space or the end are a pre-token of their own.
_MARKS = "[.,;:!?]+"
#: A piece of Latin letters that composition leaves alone and whose lower case is one letter each.
_LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: A single line break after a word or mark and before a letter is a pre-token of its own, so the letter starts a piece.
_BREAK = r"([\pL\pN.,;:!?])\n(\pL)"
#: Between pieces of letters that are encoded in one call: no such piece can give its id.
STOP = "."
#: How byte-level tokenizers write bytes as characters: printable ones stay, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_FORMS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
CACHE_PIECES, CACHED_CHARS, SLICE_BYTES = 600_000, 48, 4 << 20


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cut, self.cache = self._cut(), {}
        self.bare = None
        if self.cut != "none":
            spec = json.loads(self.tokenizer.to_str())
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": STOP}, "behavior": "Isolated", "invert": False}, "added_tokens": [], "post_processor": None}
            bare = Tokenizer.from_str(json.dumps(spec))
            stop = bare.encode(STOP, add_special_tokens=False).ids
            if len(stop) == 1 and STOP in bare.id_to_token(stop[0]):
                self.bare, self.stop = bare, stop[0]

    def _cut(self) -> str:
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "space"
        first = (pre.get("pretokenizers") or [{}])[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and norm:
            return "words"
        return "none"

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, a code per piece, and the number of pieces of each text."""
        n = len(texts)
        if self.cut == "none":
            return texts, np.arange(n), np.ones(n, np.int64)
        if self.cut == "words":
            own = texts.take(pa.array(np.arange(n)))  # ascii_lower reads a slice's buffer from its start
            apart = pc.replace_substring_regex(pc.ascii_lower(own), rf"(\pL)({_MARKS})(\s|$)", r"\1 \2\3")
            split = pc.ascii_split_whitespace(apart)
            flat = split.flatten().dictionary_encode()
            return flat.dictionary, flat.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
        whole = pc.match_substring_regex(texts, _UNSAFE)
        apart = pc.replace_substring_regex(pc.replace_substring(pc.if_else(whole, "", texts), " ", "\0 "), rf"(\pL)({_MARKS})([\x00\s]|$)", "\\1\0\\2\\3")
        apart = pc.replace_substring_regex(apart, _BREAK, "\\1\n\0\\2")
        split = pc.split_pattern(apart, "\0")
        flat, count = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
        codes, full = flat.indices.to_numpy().astype(np.int64), whole.to_numpy(zero_copy_only=False)
        kept = texts.filter(whole)
        codes[(np.cumsum(count) - count)[full]] = len(flat.dictionary) + np.arange(len(kept))
        return pa.concat_arrays([flat.dictionary, kept]), codes, count

    def _encoded(self, pieces: pa.Array) -> dict[str, bytes]:
        """Pieces of plain letters go to a tokenizer without normalizer and pre-tokenizer, in the form that those would give them and many in one call; other pieces go to the full one."""
        made: dict[str, bytes] = {}
        simple = pc.match_substring_regex(pieces, _LETTERS) if self.bare else pa.array(np.zeros(len(pieces), bool))
        own, rest = pieces.filter(simple), pieces.filter(pc.invert(simple))
        for at in range(0, len(own), 20_000):
            part = own.slice(at, 20_000).to_pylist()
            form = STOP.join(part)
            form = (form if self.cut == "space" else form.lower()).encode().decode("latin-1").translate(BYTE_FORMS)
            ids = np.array(self.bare.encode_batch_fast([form], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.stop) * 4).tolist()
            made.update(zip(part, (raw[i:j] for i, j in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)), strict=True))
        for at in range(0, len(rest), 20_000):
            part = rest.slice(at, 20_000).to_pylist()
            made.update(zip(part, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return made

    def _ids(self, pieces: pa.Array) -> list[bytes]:
        own = pieces.to_pylist()
        out = list(map(self.cache.get, own))
        new = np.fromiter((x is None for x in out), bool, len(out))
        if not new.any():
            return out
        made = self._encoded(pieces.filter(pa.array(new)))
        if len(self.cache) + len(made) > CACHE_PIECES:
            self.cache = {p: x for p, x in zip(own, out, strict=True) if x is not None}  # what this slice uses stays
        if len(made) <= CACHE_PIECES:
            self.cache.update(made if max(map(len, made)) <= CACHED_CHARS else {p: x for p, x in made.items() if len(p) <= CACHED_CHARS})
        return [made[p] if x is None else x for p, x in zip(own, out, strict=True)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one row, and where each text's ids end; end_id follows each text's own ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        pieces, codes, count = self._pieces(texts)
        ids = self._ids(pieces)
        if end_id is not None:
            ids.append(np.array([end_id], "<u4").tobytes())
            codes = np.insert(codes, np.cumsum(count), len(pieces))
            count = count + 1
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        each = size[codes]
        before = np.cumsum(each) - each
        at = np.repeat(starts[codes] - before, each)
        at += np.arange(len(at))
        ends = np.cumsum(count)
        total = np.append(0, np.cumsum(each))
        return table[at], total[ends]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so its cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    group = np.cumsum(size) // most
    cuts = np.append(np.flatnonzero(np.diff(group)) + 1, batch.num_rows)
    lo = 0
    for hi in cuts.tolist():
        yield batch.slice(lo, hi - lo)
        lo = hi


def ids_binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit ids of each piece, as binary values."""
    offsets = np.append(0, ends).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def public(name: str) -> str:
    """Where a public vocabulary file is; the package that brings them is a parameter of the environment, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)
