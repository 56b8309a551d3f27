"""Text helpers that run inside tasks: null handling, byte-bounded slices, tokenizing by distinct pieces."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
#: the marks have no part in a contraction or an added token
PLAIN = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([-!#$%&*+./,:;=?@^~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty strings and 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def listed(values: pa.Array) -> list:
    """The values as Python objects, made in one go: ``to_pylist`` makes an Arrow scalar of each first."""
    return values.to_numpy(zero_copy_only=False).tolist()


def slices(batches, name: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that each holds about ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _byte_table(lower: bool) -> np.ndarray:
    """Every white space byte becomes a space, and with ``lower`` A-Z become a-z; bytes of longer characters stay."""
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 32
    if lower:
        table[65:91] += 32
    return table


BYTES = {lower: _byte_table(lower) for lower in (False, True)}


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between white space ``[\\x20\\x09-\\x0D]``: index into the distinct words of each word, the distinct words, and the
    bounds of each text's words (one more entry than texts). ``lower`` puts A-Z in lower case."""
    texts = pa.concat_arrays([texts])  # without an offset into shared buffers
    offsets, data = texts.buffers()[1:]
    if data is not None and len(texts):
        mapped = BYTES[lower][np.frombuffer(data, np.uint8)]
        first = texts.offset
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(mapped)], offset=first)
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    base = offsets[0] if len(offsets) else 0
    encoded = flat.dictionary_encode()
    distinct = listed(encoded.dictionary)
    index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = offsets - base
    if "" in distinct:  # white space at either end of a text gives an empty part
        kept = index != distinct.index("")
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        index = index[kept]
    return index, distinct, bounds


class PieceEncoder:
    """Encodes whole texts with a tokenizer by encoding each distinct piece once, and the word in a plain piece once.

    A single space or line feed between two characters that are not white space starts a new pre-token in these tokenizers, so the ids
    of a text are those of its pieces, each with the white space before it. A text in which a piece is empty or begins or ends with
    (other) white space is encoded in one go. ``keep`` bounds the pieces remembered between batches, not what is encoded: when it is
    passed, pieces seen in one batch only are forgotten. Added tokens of the vocabulary, as ``<|endoftext|>``, are found as the library
    does by default: a text that may hold one is encoded in one go.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: what is before the first letter of an added token, which no normaliser changes, or else all of it
        self.marks = sorted({re.match(r"[^\w\s]*", t)[0] or t for t in added})
        self._tokenize = self.tokenizer.model.tokenize
        self.keep = keep
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int32)
        self.odd = np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint32)
        self._set_plain()

    def _set_plain(self) -> None:
        """Plain pieces (letters, then perhaps marks) go to the BPE model itself, which saves the alignment work of a full encoding.
        Only when that gives the same ids on probes for one of the two byte-level layouts."""
        probes = ["abc", "Straße", "ÉTÉ.", "señor,", "x", "THE", "ing.", "naïveté", "Øre,", "\nThe", "\nétat.", "\nx,", "abc%%%", "ÉTÉ,###",
                  "\nNo?!", "a-", "x.***", "b&&&", "c$$$", *(f"ab{m}c{m}{m}".replace("c", "") for m in "-!#$%&*+./,:;=?@^~")]
        for space, lower in (("\u0120", False), ("", True)):
            self.plain = (space, lower)
            self.cores: dict[str, list[int]] = {}
            if [self._plain_ids(*PLAIN.fullmatch(p).groups()) for p in probes] == self._ids([_spaced(p) for p in probes]):
                return
        self.plain = None

    def _plain_ids(self, before: str, word: str, marks: str) -> list[int]:
        space, lower = self.plain
        if lower:
            word = word.lower()
        if before and space:
            return self._core(BYTE_LETTERS[10]) + self._core(word) + (self._core(marks) if marks else [])
        ids = self._core(space + word)
        return ids + self._core(marks) if marks else ids

    def _core(self, word: str) -> list[int]:
        """Ids of a word or of marks; with the same word in other cases or before other marks, they are known already."""
        ids = self.cores.get(word)
        if ids is None:
            letters = word
            if not word.isascii():
                space, _ = self.plain
                skip = len(space) if space and word.startswith(space) else 0
                letters = word if word == BYTE_LETTERS[10] else word[:skip] + word[skip:].encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.cores[word] = [t.id for t in self._tokenize(letters)]
        return ids

    def _forget(self) -> None:
        rows = np.fromiter(self.known.values(), np.int64, len(self.known))
        stay = self.hits[rows] > 1
        if stay.sum() > self.keep // 2:
            stay &= self.hits[rows] > np.median(self.hits[rows[stay]])
        names = [p for p, s in zip(self.known, stay) if s]
        rows = rows[stay]
        self.pool = self.pool[ranges(self.starts[rows], self.sizes[rows])]
        self.sizes, self.hits, self.odd = self.sizes[rows], self.hits[rows] // 2 + 1, self.odd[rows]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = dict(zip(names, range(len(names))))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if len(self.cores) > self.keep // 2:
            self.cores.clear()
        plain = [PLAIN.fullmatch(p) if self.plain else None for p in pieces]
        rest = [p for p, simple in zip(pieces, plain) if not simple]
        full = []
        for at in range(0, len(rest), 8192):
            full += self._ids([_spaced(p) for p in rest[at : at + 8192]])
        others = iter(full)
        lists = [self._plain_ids(*simple.groups()) if simple else next(others) for p, simple in zip(pieces, plain)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        row = len(self.known)
        self.known.update(zip(pieces, range(row, row + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int32)])
        self.odd = np.concatenate([self.odd, np.fromiter((not simple and _odd(p) for p, simple in zip(pieces, plain)), bool, len(pieces))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text's ids."""
        if len(texts) == 0:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        flat = parts.flatten()
        heads = listed(flat.take(pa.array(bounds[:-1])))
        encoded = flat.dictionary_encode()
        pieces = listed(encoded.dictionary)
        index = encoded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.keep:
            self._forget()
        self._learn([p for p, row in zip(pieces, map(self.known.get, pieces)) if row is None])
        rows = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.hits[rows] += 1
        starts, sizes = self.starts[rows][index], self.sizes[rows][index]
        firsts = bounds[:-1]
        apart = np.add.reduceat(self.odd[rows][index], firsts, dtype=np.int64) > 0
        for mark in self.marks:
            found = pc.match_substring(texts, mark, ignore_case=mark.lower() != mark.upper())
            apart |= found.to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(apart)
        # the first piece has no space before it; a text with an odd piece is encoded as a whole in its place
        for i in whole:
            sizes[firsts[i] : bounds[i + 1]] = 0
            heads[i] = texts[int(i)].as_py()
        extra = self._ids(heads)
        sizes[firsts] = np.fromiter(map(len, extra), np.int64, len(extra))
        starts[firsts] = len(self.pool) + np.cumsum(sizes[firsts]) - sizes[firsts]
        pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(extra), np.uint32, int(sizes[firsts].sum()))])
        return pool[ranges(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]


def _spaced(piece: str) -> str:
    """The piece with what was before it in its text; one that begins with a line feed had no space."""
    return piece if piece[:1] == "\n" else " " + piece


def _odd(piece: str) -> bool:
    piece = piece[1:] if piece[:1] == "\n" else piece
    return not piece or piece[0].isspace() or piece[-1].isspace()


_encoders: dict[str, PieceEncoder] = {}


def release() -> None:
    """Drop what earlier tasks of this Python worker kept: workers are reused, and an operator that does not encode should not hold the
    pieces another one learned. Freed buffers go back to the system."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
