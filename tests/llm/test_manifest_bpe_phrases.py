"""Merkle manifest, streaming BPE and phrase mining against brute-force versions, on edge cases and on sf0.001."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldcal.llm import bpe_transducer, merkle_manifest, phrase_mining, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PROSE = " ".join(f"word{i % 37} thing{i % 53}," for i in range(160))
TEXTS = [
    None, "", " \n ", "one", "one", PROSE, PROSE, "x" + PROSE + "\t end  twice", "a b a b a b " * 30, "é à　ü…" * 12, "long " * 20000,
    "<|endoftext|> x <|endof text|><|endoftext|>", "It's we'll THEY'RE 'tis  don''t", "trail \n\n", "z" * 5000, " " * 3000 + "end", "a,b.C;d:e!f?g\x0bh\x0ci\rj",
    "\U0001f600" * 40 + "‍́", "0123456789" * 300, "A a. A a, a A A",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, level int, pos long, depth int, segment int, ids int, block long"


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("t", 1, 2, 3, 4, 5, 6)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t) if t and i % 3 else None, *clash) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "one", "en", "s1", 3, *clash), (None, PROSE, None, None, 1, *clash), (-5, "alone", "ünï", "s", 5, *clash), (9, "x", "", "", 0, *clash)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(leaves):
    """Levels of a tree, from the leaves to its one root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def way(levels, at):
    """Per level: whether the node is the right one, and its sibling or None."""
    for level in levels[:-1]:
        yield at % 2, level[at ^ 1] if at ^ 1 < len(level) else None
        at //= 2


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {lang: tree_of([leaf(r) for r in by_lang[lang]]) for lang in langs}
    upper = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            path = [*way(trees[lang], i), *way(upper, at)]
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, int(changed))
            for right, sibling in path:
                node = digest(([sibling, node] if right else [node, sibling]) if sibling else [node])
            root = upper[-1][0]
            out.append((r.doc_id, leaf(r), trees[lang][-1][0], root, digest(s for _, s in path if s), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_edges(docs, nothing, levels):
    expected = brute_manifest(docs.collect())
    assert sorted(map(tuple, merkle_manifest.manifest(docs, levels).collect()), key=str) == expected
    assert not all(row[-1] for row in expected)
    if levels == 10:
        assert sorted(map(tuple, merkle_manifest.manifest(docs.repartition(7), levels).collect()), key=str) == expected
        assert merkle_manifest.manifest(nothing).count() == 0


def test_manifest_of_one_row(docs):
    one = docs.where("doc_id = 3")
    assert list(map(tuple, merkle_manifest.manifest(one).collect())) == brute_manifest(one.collect())


def test_manifest_query(spark, sf_dir):
    rows = queries.documents(spark, sf_dir).collect()
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, sf_dir).collect()), key=str) == brute_manifest(rows)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_transducer.Vocabulary(PATH)


def stream(vocabulary, text, sizes):
    """Ids of ``text`` fed in parts of the given sizes, one after the other."""
    encoder, at, ids = bpe_transducer.Encoder(vocabulary), 0, []
    while at < len(text):
        step = next(sizes)
        ids += encoder.feed(text[at : at + step]).tolist()
        at += step
    return ids + encoder.feed("", last=True).tolist()


def brute_round_trip(library, rows):
    out = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_round_trip_edges(docs, nothing, library):
    assert sorted(map(tuple, bpe_transducer.round_trip_digests(docs, PATH).collect()), key=str) == brute_round_trip(library, docs.collect())
    assert bpe_transducer.round_trip_digests(nothing, PATH).count() == 0


def test_round_trip_query(spark, sf_dir, library):
    rows = queries.documents(spark, sf_dir).collect()
    assert sorted(map(tuple, queries.op12_bpe_transducer(spark, sf_dir).collect()), key=str) == brute_round_trip(library, rows)


def test_encode_decode_tables(docs, library):
    coded = bpe_transducer.encode(docs.select("doc_id", "text", "ids"), PATH)
    back = bpe_transducer.decode(coded, PATH).collect()
    assert len(back) == docs.count()
    for r in back:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_parts_of_any_size_give_the_same_ids(vocabulary, library, step):
    for text in (t for t in TEXTS if t and len(t) < 10000):
        assert stream(vocabulary, text, iter(lambda: step, 0)) == library.encode(text, add_special_tokens=False).ids


@functools.cache
def plain():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aet'sLl  \n\t.,09é　́漢😀<|endoftext>"), max_size=120), st.integers(0, 1000))
def test_streaming_matches_the_library(text, seed):
    dice = random.Random(seed)
    ids = stream(bpe_transducer.loaded(PATH)[0], text, iter(lambda: dice.randint(1, 9), 0))
    assert ids == plain().encode(text, add_special_tokens=False).ids


def test_every_character(vocabulary, library):
    """Every code point of the planes in use between two letters: letters, numbers and white space are told apart as the library does."""
    points = [c for c in [*range(0x32400), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in points[at : at + 4096])
        assert bpe_transducer.Encoder(vocabulary).feed(text, last=True).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_a_stream_is_bounded(vocabulary):
    held, one = 0, bpe_transducer.PieceStream(vocabulary)
    for _ in range(400):
        one.feed(b"abcdefgh" * 64)
        held = max(held, len(one.held))
    assert held <= vocabulary.lookahead + 2 * bpe_transducer.STREAM_BYTES


def test_decoder_holds_unfinished_characters(vocabulary, library):
    dice = random.Random(5)
    known = sorted(vocabulary.bytes_of)
    for _ in range(50):
        ids = dice.choices(known[:300], k=40)  # single bytes, mostly no whole characters
        decoder, text = bpe_transducer.Decoder(vocabulary), ""
        for i in ids:
            text += decoder.feed([i])
        assert text + decoder.feed([], last=True) == library.decode(ids, skip_special_tokens=False)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, longest, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        candidates = {w: a for w, a in found.items() if len(w) > 1 and a >= least}
        covered = Counter()
        for w, a in candidates.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    covered[w[i : i + m]] = max(covered[w[i : i + m]], a)
        kept = []
        for w, a in candidates.items():
            score, k = min((2000000 * a // (found[w[:k]] + found[w[k:]]), k) for k in range(1, len(w)))
            if w not in covered or 100 * covered[w] < cover * a:
                kept.append((-score, -a, " ".join(w).encode(), found[w[:k]], found[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, longest, cover, top", [(2, 4, 80, 2000), (1, 3, 100, 20), (30, 4, 80, 5), (3, 2, 80, 2000)])
def test_phrases_edges(docs, least, longest, cover, top):
    found = phrase_mining.collocations(docs, least, longest, cover, top).collect()
    expected = brute_phrases(docs.collect(), least, longest, cover, top)
    assert sorted(map(tuple, found)) == expected and expected


def test_phrases_over_many_blocks_and_shards(docs, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SHARD_WORDS", 500)
    monkeypatch.setattr(phrase_mining, "BLOCK_BYTES", 2000)
    found = phrase_mining.collocations(docs.repartition(5), 2).collect()
    assert sorted(map(tuple, found)) == brute_phrases(docs.collect(), 2, 4, 80, 2000)


def test_phrases_of_nothing(nothing, docs):
    assert phrase_mining.collocations(nothing).count() == 0
    assert phrase_mining.collocations(docs.where("text is null or text = ''")).count() == 0


def test_phrases_query(spark, sf_dir):
    rows = queries.documents(spark, sf_dir).collect()
    assert sorted(map(tuple, queries.op13_phrase_mining(spark, sf_dir).collect())) == brute_phrases(rows, 30, 4, 80, 2000)


def test_packed_arrays_are_entropy_coded():
    """Frequent numbers cost few bits, and short arrays no more than a byte besides their own."""
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 50_000), 60_000).astype(np.int32)
    for values, ascending in ((ids, False), (np.cumsum(ids % 3 + 1, dtype=np.int32), True), (ids[:0], False), (ids[:3], False), (np.sort(ids).astype(np.int64), True)):
        packed = phrase_mining.pack(values, ascending)
        assert np.array_equal(phrase_mining.unpack(packed, values.dtype, ascending), values) and len(packed) <= values.nbytes + 1
    assert len(phrase_mining.pack(ids)) < 1.2 * len(ids)


def test_pairs_cost_less_than_whole_numbers():
    """Pairs of frequent first words, and of first words with the number 0."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50_000):
        pairs = np.unique(((np.minimum(rng.zipf(1.3, n), 60_000).astype(np.int64) - 1) << 32) | rng.integers(0, 50_000, n))
        assert np.array_equal(phrase_mining.unpack_pairs(phrase_mining.pack_pairs(pairs)), pairs)
    assert len(phrase_mining.pack_pairs(pairs)) < 0.97 * len(phrase_mining.pack(pairs, True))


def test_blocks_are_not_shuffled(docs, monkeypatch):
    """What the blocks of a length need comes to where they are stored: one side of each cogroup is dealt out by block, and not both."""
    plans, store = [], phrase_mining.cut_lineage

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(phrase_mining, "cut_lineage", stored)
    phrase_mining.mine(docs, 2)
    grouped = [plan for plan in plans if "FlatMapCoGroupsInArrow" in plan]
    assert [plan.count("Exchange hashpartitioning(block") for plan in grouped] == [1, 1, 1]


def test_shards_follow_the_language(spark, monkeypatch):
    """A small language is not cut into as many shards as a large one, which gave a row for each block and shard."""
    monkeypatch.setattr(phrase_mining, "SHARD_WORDS", 100)
    sent, count = [], phrase_mining.counted

    def counted(groups, *others, **named):
        sent.append({r.lang: r.n for r in groups.groupBy("lang").agg(F.count_distinct("shard").alias("n")).collect()})
        return count(groups, *others, **named)

    monkeypatch.setattr(phrase_mining, "counted", counted)
    words = [f"w{i % 97}" for i in range(4000)]
    rows = [(1, " ".join(words), "en"), (2, " ".join(words[:60]) + " a b a b", "fr")]
    _, found = phrase_mining.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 2)
    assert [n["fr"] for n in sent[:2]] == [1, 1] and all(n["en"] > 20 for n in sent)
    assert {tuple(r.words): r.a for r in found.where("lang = 'fr'").collect()} == {("a",): 2, ("b",): 2, ("a", "b"): 2}
