"""Byte-level BPE as a streaming transducer: encoding with bounded lookahead, decoding with a byte-to-text state machine.

A token of the text read so far stays a token of the whole text once enough bytes behind it are known: ``lookahead`` computes how many
from the merge list alone. A token can only be lost to a merge across its right end that comes before the merge that made or will use
it, and whether that merge happens depends on the token to its right in the same way, with ever earlier merges; the longest such
chain, in bytes, is the sufficient lookahead. Tokens that far from the end of the buffer are emitted and their bytes forgotten, so a
run of a million letters takes no more memory than a line.

Text is cut into pieces (letters, digits, other characters, white space) incrementally: a piece is complete once the characters behind
it are known, and a long unfinished piece is fed to the transducer while it grows. The ids of short pieces are remembered up to a bound,
which saves time and changes nothing. Decoding turns ids into bytes and bytes into text with a decoder that holds an unfinished
character between calls; malformed bytes become U+FFFD, one for each maximal part.

Defined results: a null text counts as empty and has no tokens; rows keep their number, repeated or not; an empty table gives an empty
one; of clashing names the operator's own column replaces the table's; ids outside the vocabulary are skipped in decoding.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.llm.words import BYTE_LETTERS

CHUNK_CHARS = 1 << 16
PIECE_CHARS = 64
KNOWN_PIECES = 300_000
STREAM_BYTES = 1024
#: fixed values: contractions and white space of the byte-level pre-tokenizer
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    cuts = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(cuts, cuts[1:]))


def _patterns(most: int) -> tuple[re.Pattern, dict[str, re.Pattern]]:
    """A piece, and the run of characters that may extend one, in texts of code points up to ``most``; narrow classes match faster.

    Letters come first, as most pieces are words and no other kind begins like them."""
    kinds = {initial: [] for initial in "LN"}
    for c in range(most + 1):
        kinds.get(unicodedata.category(chr(c))[0], []).append(c)
    letter, number, space = _ranges(kinds["L"]), _ranges(kinds["N"]), _ranges([c for c in WHITE_SPACE if c <= most])
    other = f"[^{space}{letter}{number}]+"
    runs = {"letter": f"[{letter}]+", "number": f"[{number}]+", "other": other, "space": f"[{space}]+"}
    piece = f" ?[{letter}]+|{CONTRACTIONS}| ?{other}| ?[{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(piece), {name: re.compile(run) for name, run in runs.items()}


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE file, and the lookahead they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = {letter: byte for byte, letter in BYTE_LETTERS.items()}
        ids = told["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(letters.__getitem__, token)) for token, i in ids.items()}
        self.byte_ids = [ids.get(BYTE_LETTERS[b]) for b in range(256)]
        #: (left id, right id) -> place in the merge list; ids of the results by place
        self.merges: dict[tuple[int, int], int] = {}
        self.results: list[int] = []
        for place, merge in enumerate(told["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[left], ids[right]] = place
            self.results.append(ids[left + right])
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.names = {i: b"%d" % i for i in self.bytes_of}
        self.lookahead = lookahead(self.merges, self.results, {i: len(b) for i, b in self.bytes_of.items()})
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.added_chars = max(map(len, self.added), default=0)
        self.narrow, (self.piece, self.runs) = _patterns(0xFF)[0], _patterns(sys.maxunicode)

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.piece.findall(text)
        return self.narrow.findall(text)


def lookahead(merges: dict[tuple[int, int], int], results: list[int], sizes: dict[int, int]) -> int:
    """Bytes behind a token that decide whether it stays.

    One pass in the order of the merge list. ``across[x]``: the most that an earlier merge (x, y) over x's right end needs, which is y
    and what decides on y. ``inside[v]``: the most that a merge over the right end of v needs before v is whole, found when v is made.
    """
    across: dict[int, int] = defaultdict(int)
    inside: dict[int, int] = defaultdict(int)
    made: dict[int, int] = {}
    for (left, right), place in sorted(merges.items(), key=lambda m: m[1]):
        result = results[place]
        if made.get(left, -1) >= place or made.get(right, -1) >= place:
            raise ValueError("a merge uses a token that a later merge makes")
        needs = sizes[right] + max(inside[right], across[right])
        inside[result] = max(inside[result], inside[right], across[right])
        across[left] = max(across[left], needs)
        made.setdefault(result, place)
    return max([*across.values(), *inside.values()], default=0)


class PieceStream:
    """The transducer of one piece: bytes in, stable ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held = b""

    def feed(self, raw: bytes, last: bool = False) -> list[int]:
        out: list[int] = []
        for at in range(0, max(len(raw), 1), STREAM_BYTES):
            self.held += raw[at : at + STREAM_BYTES]
            end = last and at + STREAM_BYTES >= len(raw)
            if end or len(self.held) >= self.vocabulary.lookahead + STREAM_BYTES:
                out += self._emit(end)
        return out

    def _emit(self, last: bool) -> list[int]:
        ids = merged(self.vocabulary, self.held)
        if last:
            self.held = b""
            return ids
        room, done, count = len(self.held) - self.vocabulary.lookahead, 0, 0
        for token in ids:
            size = len(self.vocabulary.bytes_of[token])
            if done + size > room:
                break
            done += size
            count += 1
        self.held = self.held[done:]
        return ids[:count]


def merged(vocabulary: Vocabulary, raw: bytes) -> list[int]:
    """Ids of ``raw``: the earliest merge of the list first, from left to right. Bytes without an id are left out."""
    ids = list(map(vocabulary.byte_ids.__getitem__, raw))
    if None in ids:
        ids = [i for i in ids if i is not None]
    place_of, results = vocabulary.merges.get, vocabulary.results
    if len(ids) <= PIECE_CHARS:
        never = len(results)
        places = [place_of(pair, never) for pair in zip(ids, ids[1:])]
        while places and (best := min(places)) < never:
            at = places.index(best)
            ids[at : at + 2] = [results[best]]
            del places[at]
            if at:
                places[at - 1] = place_of((ids[at - 1], ids[at]), never)
            if at < len(places):
                places[at] = place_of((ids[at], ids[at + 1]), never)
        return ids
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    queue = [(place, i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if (place := place_of(pair)) is not None]
    heapq.heapify(queue)
    while queue:
        best, i, pair = heapq.heappop(queue)
        j = after[i]
        if ids[i] != pair[0] or j == len(ids) or ids[j] != pair[1]:
            continue
        ids[i], ids[j] = results[best], -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(ids) and (place := place_of((ids[a], ids[b]))) is not None:
                heapq.heappush(queue, (place, a, (ids[a], ids[b])))
    return [i for i in ids if i >= 0]


class Known(dict):
    """Ids of short pieces, as 4-byte integers; a missing piece goes through the transducer. A full table becomes the older one, from
    which pieces that are met again come back."""

    def __init__(self, vocabulary: Vocabulary, most: int = KNOWN_PIECES):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = _raw(PieceStream(self.vocabulary).feed(piece.encode(), last=True))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Text in pieces of any size in, ids out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary, known: Known | None = None):
        self.vocabulary = vocabulary
        self.known = Known(vocabulary) if known is None else known
        self.held = ""
        self.run: tuple[str, PieceStream] | None = None

    def feed(self, text: str, last: bool = False) -> np.ndarray:
        """The ids that became certain; ``last`` ends the text."""
        text, out, added = self.held + text, [], self.vocabulary.added_pattern
        self.held = ""
        while added and (found := added.search(text)):
            self._segment(text[: found.start()], True, out)
            out.append(np.array([self.vocabulary.added[found[0]]], "<i4").tobytes())
            text = text[found.end() :]
        # the beginning of an added token at the end waits
        kept = 0 if last else self._begun(text)
        self._segment(text[: len(text) - kept], last, out)
        self.held += text[len(text) - kept :]
        return np.frombuffer(b"".join(out), "<i4")

    def _begun(self, text: str) -> int:
        tails = range(min(len(text), self.vocabulary.added_chars - 1), 0, -1)
        return next((n for n in tails if any(t.startswith(text[-n:]) for t in self.vocabulary.added)), 0)

    def _segment(self, text: str, last: bool, out: list[bytes]) -> None:
        """Pieces of text between added tokens; what is not certain yet is held."""
        self.held = ""
        if self.run:
            text = self._continue(text, last, out)
            if self.run:
                return
        pieces = self.vocabulary.pieces(text)
        waiting = 0
        if not last:
            # a contraction is certain three characters after its start, any other piece with the character behind it
            while pieces and waiting + (len(pieces[-1]) if waiting else 0) < 3:
                waiting += len(pieces.pop())
        out += map(self.known.__getitem__, pieces)
        if waiting > PIECE_CHARS:
            self._open(text[len(text) - waiting :], out)
        elif waiting:
            self.held = text[len(text) - waiting :]

    def _open(self, piece: str, out: list[bytes]) -> None:
        """Feed a long unfinished piece to a transducer of its own."""
        kind = next(name for name, run in self.vocabulary.runs.items() if run.match(piece[-1]))
        self.run = (kind, PieceStream(self.vocabulary))
        keep = 1 if kind == "space" else 0  # the last white space may belong to the next piece
        out.append(_raw(self.run[1].feed(piece[: len(piece) - keep].encode())))
        self.held = piece[len(piece) - keep :]

    def _continue(self, text: str, last: bool, out: list[bytes]) -> str:
        """Extend the open piece; the text behind it, once it has ended."""
        kind, stream = self.run
        found = self.vocabulary.runs[kind].match(text)
        end = found.end() if found else 0
        if end == len(text) and not last:
            keep = 1 if kind == "space" and end else 0
            out.append(_raw(stream.feed(text[: end - keep].encode())))
            self.held = text[end - keep :]
            return ""
        if kind == "space" and end < len(text):
            end -= 1
        out.append(_raw(stream.feed(text[:end].encode(), last=True)))
        self.run = None
        return text[end:]


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Decoder:
    """Ids in, text out as soon as its characters are whole."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes_of.get(i, b"") for i in ids)
        return self.state.decode(raw, last)


_loaded: dict[str, tuple[Vocabulary, Known]] = {}


def loaded(path: str) -> tuple[Vocabulary, Known]:
    """One vocabulary per Python worker and file."""
    if path not in _loaded:
        vocabulary = Vocabulary(path)
        _loaded[path] = (vocabulary, Known(vocabulary))
    return _loaded[path]


def chunks(text: str, size: int = CHUNK_CHARS):
    """(part, whether it is the last)."""
    for at in range(0, max(len(text), 1), size):
        yield text[at : at + size], at + size >= len(text)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    rest = [c for c in docs.columns if c != ids]

    def run(batches):
        vocabulary, known = loaded(path)
        for batch in batches:
            rows = []
            for value in batch.column("__text"):
                stream = Encoder(vocabulary, known)
                rows.append(np.concatenate([stream.feed(part, last) for part, last in chunks(value.as_py() or "")]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(rows, pa.list_(pa.int32()))], names=[*rest, ids])

    rows = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text).alias("__text"))
    schema = T.StructType([docs.schema[c] for c in rest]).add(ids, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column of decoded text."""
    rest = [c for c in rows.columns if c != text]

    def run(batches):
        vocabulary, _ = loaded(path)
        for batch in batches:
            texts = []
            for value in batch.column("__ids"):
                stream, found = Decoder(vocabulary), value.as_py() or []
                texts.append("".join(stream.feed(found[at : at + CHUNK_CHARS], at + CHUNK_CHARS >= len(found)) for at in range(0, max(len(found), 1), CHUNK_CHARS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, text])

    schema = T.StructType([rows.schema[c] for c in rest]).add(text, T.StringType())
    return rows.select(*(F.col(f"`{c}`") for c in rest), F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids go from the encoder to the decoder as they come."""
    def run(batches):
        vocabulary, known = loaded(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column("text"):
                encoder, decoder = Encoder(vocabulary, known), Decoder(vocabulary)
                ids_digest, text_digest, n = hashlib.sha256(), hashlib.sha256(), 0
                for part, last in chunks(value.as_py() or ""):
                    ids = encoder.feed(part, last).tolist()
                    if ids:
                        ids_digest.update(b"," * (n > 0) + b",".join(map(vocabulary.names.__getitem__, ids)))
                    text_digest.update(decoder.feed(ids, last).encode())
                    n += len(ids)
                counts.append(n)
                of_ids.append(ids_digest.hexdigest())
                of_text.append(text_digest.hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
