"""The corpus operators against brute-force versions, on a table of edge cases and on sf0.001."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldcal.llm import (
    content_sort, cutting_stock, fair_queue, language_model, learned_partitions, line_chunks, probminhash, queries, site_quality,
    suffix_dedup, token_store, words,
)
from tests.compare import difference, duck

PROSE = " ".join(f"word{i % 37} thing{i % 53}," for i in range(160))
TEXTS = [
    None, "", " \n ", "one", "one", "Alpha beta\ngamma delta\nlast line here\nfoo", PROSE, PROSE, PROSE + " more", "x" + PROSE + "\t end  twice",
    "a b a b a b " * 30, "é à　ü…" * 12, "long " * 20000, "B " * 70, "alpha  beta\n\n gamma",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, twin long, norm string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 1, 2, "n") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "one", "en", "s1", 3, 1, 2, "n"), (None, PROSE, None, None, 1, 1, 2, "n")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, sf_dir):
    assert difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], duck(sf_dir)) is None


def test_content_sort_edges(docs, nothing):
    rows = content_sort.content_sort(docs, blocks=4).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    assert len(rows) == docs.count() and sum(r.kept for r in rows) == len(groups)
    sizes = {hashlib.sha256(k.encode()).hexdigest(): (len(v), sorted(v, key=lambda x: (x[0], x[1], x[2] or 0))[0][2]) for k, v in groups.items()}
    assert all((r.group_size, r.keep_id) == sizes[r.text_sha256] for r in rows)
    assert content_sort.content_sort(nothing).count() == 0


def test_fair_queue_edges(docs, nothing):
    rows = fair_queue.mixed(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, fair_queue.mixed(docs.repartition(5)).collect()), key=str)
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in rows)
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    mixed = fair_queue.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert fair_queue.mixed(nothing).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + [
        "<|endoftext|> x", "abc <|endoftext|> def", "a<|ENDOFTEXT|>b <|StartOfText|>", "x <| endoftext|> <|", "<|endoftext|><|endoftext|>\ny", "a\nb\n", "É.\nÀ,\nstraße's", "\x1c a", " lead", "trail \n"]
    encoder = words.PieceEncoder(path, keep=10)
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_code_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    for n in range(len(ranks) + 1):
        assert token_store.unpack(*token_store.pack(ranks[:n]), n).tolist() == ranks[:n].tolist()


def test_token_store_edges(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_store.read_store(spark, token_store.write_store(docs, path)).collect()
    assert len(rows) == docs.count()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    ids = [r.doc_id if r.doc_id is not None else -1 for r in ordered]
    assert ids == sorted(ids)
    plain = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert token_store.read_store(spark, token_store.write_store(nothing, path)).count() == 0


def test_packing_edges(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = cutting_stock.pack_documents(docs, path).collect()
    plain = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((r.doc_id, at, zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    assert cutting_stock.pack_documents(nothing, path).count() == 0


def test_column_generation_beats_greedy():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.minimum(1023, rng.lognormal(5.5, 1, 20000).astype(int) + 1), return_counts=True)
    cost = lambda p: sum(int(cutting_stock.padded_length((a * lengths).sum())) * k for a, k in p)
    solved = cutting_stock.solve_patterns(lengths, counts)
    assert (sum(a * k for a, k in solved) == counts).all()
    assert cost(solved) <= cost(cutting_stock.greedy_patterns(lengths, counts, 1024))


def removed(texts):
    """doc_id -> (n_removed, kept bytes), window by window."""
    seen, out = {}, {}
    for i, raw in texts:
        for p in range(len(raw) - 49):
            seen[raw[p : p + 50]] = min(seen.get(raw[p : p + 50], i), i)
    for i, raw in texts:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if seen[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = (int(gone.sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def test_suffix_dedup_edges(docs, nothing):
    texts = [(i, (t or "").encode()) for i, t in enumerate(TEXTS)]
    want = removed(texts)
    rows = suffix_dedup.remove_repeats(docs, with_text=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_removed, bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_heavy_keys(spark, monkeypatch):
    """A phrase in every document, between other words, and periodic stretches; with and without buckets for heavy keys."""
    rng = np.random.default_rng(6)
    phrase = "a phrase of more than fifty bytes that each document holds once; "
    own = lambda: " ".join(f"w{x}" for x in rng.integers(0, 30, 12))
    texts = [(i, (own() + " " + phrase + own()).encode()) for i in range(25)]
    texts += [(25, b"z" * 300), (26, b"q" + b"z" * 240 + b"end"), (27, b"ab" * 120), (28, b"x" + b"ab" * 90), (29, b"abc" * 70 + texts[3][1])]
    table = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string")
    want = removed(texts)
    for heavy in (2, 65_536):
        monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
        got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table, with_text=True).collect()}
        assert got == want


def test_suffix_dedup_groups_are_bounded():
    """No entry per position of a constant text; the places of a key met often leave the buckets."""
    batch = pa.record_batch({"row": pa.array([7, 9], pa.int64()), "text": pa.array(["a" * 100_000, "b" + "a" * 50_000])})
    packed = list(suffix_dedup._emit_anchors(1)([batch]))
    assert sum(len(x) for b in packed for x in b.column("keys").to_pylist()) < 100
    rows = pa.Table.from_batches(packed).to_pandas()
    for heavy, kinds in ((1, {2, 3}), (1000, {0, 1})):
        found = suffix_dedup._repeated(heavy)(rows)
        assert set(found["kind"]) <= kinds and found["n"].sum() == 100_000 - 23 + 50_000 - 23


def test_near_classes(spark, sf_dir, docs, nothing):
    rows = {r.doc_id: r.class_id for r in queries.QUERIES["op7_probminhash"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    linked = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert linked and all(rows[a] == rows[b] for a, b in linked)
    classes = {r.doc_id: r.class_id for r in probminhash.near_classes(docs).collect()}
    assert classes[6] == classes[7] == classes[8] == 6 and classes[0] == classes[1] == classes[2] == 0 and classes[3] == classes[4] == 3
    kept = probminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert probminhash.near_classes(nothing).count() == 0


def _variants(n, base, share, seed):
    """Texts in which a few words of a base text are replaced; some are repeated whole, so that weights differ."""
    rng = np.random.default_rng(seed)
    found = []
    for i in range(n):
        words_ = [w if x > share else f"w{x:.6f}" for w, x in zip(base, rng.random(len(base)))]
        found.append(" ".join(words_ * (2 if i % 17 == 0 else 1)))
    return found


def _weighted(texts):
    doc, value, weight = probminhash.shingles(pa.array(texts, pa.large_string()))
    return [(value[doc == i], weight[doc == i]) for i in range(len(texts))]


def _roots(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_tile_links_join_what_all_pairs_join():
    texts = _variants(60, [f"a{i}" for i in range(90)], 0.03, 1) + ["x y", "x y z x y z x y z"]
    sets = _weighted(texts)
    rng = np.random.default_rng(2)
    lead = np.arange(len(texts)) % 3 == 0
    label = np.arange(len(texts))
    label[rng.choice(len(texts), 8, replace=False)] = 5
    known = [(5, i) for i in np.flatnonzero(label == 5)]
    found = probminhash.tile_links(lead, np.arange(len(texts)), label, [np.repeat(v, w) for v, w in sets], 0.8)
    alike = {(i, j) for i in np.flatnonzero(lead) for j in np.flatnonzero(~lead) if probminhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8}
    assert 0 < len(found) < len(alike)
    assert _roots(len(texts), [*known, *alike]) == _roots(len(texts), [*known, *((a, b) for a, b, _ in found)])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "TILE", 16)
    monkeypatch.setattr(probminhash, "LEADERS", 3)
    monkeypatch.setattr(probminhash, "GROWTH", 4)
    monkeypatch.setattr(probminhash, "ALL_PAIRS", 12)
    base = [f"a{i}" for i in range(80)]
    texts = [*_variants(70, base, 0.02, 3), *_variants(40, base[:60] + [f"b{i}" for i in range(30)], 0.03, 4)]
    texts += texts[:5]
    sets = _weighted(texts)
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if probminhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in probminhash.near_classes(docs).collect()}
    assert [classes[i] for i in range(len(texts))] == _roots(len(texts), alike)


def test_closed_buckets_leave_the_rounds(spark, monkeypatch):
    """Every round joined the classes to all rows of all large buckets, twice."""
    monkeypatch.setattr(probminhash, "LEADERS", 3)
    monkeypatch.setattr(probminhash, "GROWTH", 4)
    texts = [*_variants(30, [f"a{i}" for i in range(80)], 0.0, 3), *(" ".join(f"own{k} {i}" for k in range(20)) for i in range(20))]
    docs = spark.createDataFrame([(i, t if i >= 30 else f"{t} {i}") for i, t in enumerate(texts)], "doc_id long, text string")
    large = docs.select(F.when(F.col("doc_id") < 30, 1).otherwise(2).cast("long").alias("band"), F.col("doc_id").alias("rep"))
    seen, once = [], probminhash._placed
    monkeypatch.setattr(probminhash, "_placed", lambda entries, classes: seen.append(entries.groupBy("band").count().collect()) or once(entries, classes))
    _, classes = probminhash._large_links(large, docs, 0.8)
    assert {r.class_id for r in classes.collect()} == {0}
    assert [sorted(map(tuple, r)) for r in seen[:2]] == [[(1, 30), (2, 20)], [(1, 30), (2, 20)]]
    assert all([tuple(x) for x in r] == [(2, 20)] for r in seen[2:-1]) and len(seen) > 2


def test_signature_estimates_similarity():
    texts = pa.array([PROSE, PROSE + " some more words at the end of it", "x " * 12, "x " * 9 + "y y"], pa.large_string())
    doc, value, weight = probminhash.shingles(texts)
    registers = probminhash.signatures(4, doc, value, weight, 4096).astype(np.uint32)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        exact = probminhash.probability_jaccard(value[doc == i], weight[doc == i], value[doc == j], weight[doc == j])
        assert abs((registers[i] == registers[j]).mean() - exact) < 0.04


def test_line_chunks(spark, docs, nothing):
    body = "\n".join(f"shared line number {i} of the passage" for i in range(40))
    rows = spark.createDataFrame([(1, "own start\n" + body), (2, "other\nlines\n" + body + "\ntail"), (3, "nothing shared\nhere"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(rows).collect()}
    assert out[1].line_spans is None and out[3].line_spans is None and out[4].text is None
    assert len(out[2].text.split("\n")) < 20 and out[2].text.startswith("other") and out[2].text.endswith("tail")
    assert line_chunks.line_dedup(docs).count() == docs.count() and line_chunks.line_dedup(nothing).count() == 0


def _lines_left(texts):
    """Lines that stay when every run of lines goes that starts and ends with words, holds two such lines and was met in an earlier place."""
    first, out = {}, {}
    runs = []
    for i, text in texts:
        lines = text.split("\n")
        worded = [k for k, x in enumerate(lines) if x.strip()]
        for n, a in enumerate(worded):
            for b in worded[n + 1 : n + 12]:
                run = tuple(lines[a : b + 1])
                first.setdefault(run, (i, a))
                runs.append((run, i, a))
    gone = {}
    for run, i, a in runs:
        if first[run] != (i, a):
            gone.setdefault(i, set()).update(range(a, a + len(run)))
    for i, text in texts:
        left = [x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())]
        out[i] = [] if i in gone and not "".join(left).strip() else left
    return out


def test_line_chunks_take_every_repeated_run(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = ["own\nfirst shared\nsecond shared\nend", "x\ny\nfirst shared\nsecond shared", "a\n\nb\nq\n", "r\na\n\nb", "a\nb", "s\ns\ns\ns", "\na\n\nb\n "]
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = table.unionByName(made)
    texts = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)
    want = _lines_left(texts)
    assert want[10**6 + 1] == ["x", "y"] and want[10**6 + 3] == ["r"] and want[10**6 + 4] == ["a", "b"] and want[10**6 + 6] == []
    got = {r.doc_id: r for r in line_chunks.line_dedup(docs).collect()}
    assert len(got) == docs.count()
    for i, text in texts:
        assert got[i].n_lines == len(text.split("\n")) and got[i].n_removed == len(text.split("\n")) - len(want[i]), i
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(want[i]).encode()).hexdigest(), i
    assert sum(r.n_removed for r in got.values()) > 100


def test_site_quality(spark, sf_dir, docs, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = site_quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").collect()
    right = np.mean([r.kept == (r.quality == 1 and r.toxic == 0) for r in rows])
    assert right > 0.9
    assert np.mean([r.kept for r in rows if r.quality == 1 and r.toxic == 0]) > 0.97
    assert site_quality.quality(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert site_quality.filter_documents(docs, labels).columns == docs.columns
    assert site_quality.quality(nothing, labels).count() == 0


def test_language_model(spark, docs, nothing):
    rows = language_model.score_documents(docs).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for r in docs.collect() if not held(r.doc_id) for w in split(r.text))
    n, v = sum(seen.values()), len(seen)
    want = Counter((r.doc_id, len(split(r.text)), sum(seen[w] > 0 for w in split(r.text)),
                    round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in split(r.text)), 3)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in rows) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0 for r in rows)
    assert language_model.score_documents(nothing).count() == 0


@pytest.mark.parametrize("frequent", [10**6, 13, 8, 4])
def test_language_model_probabilities_sum_to_one(spark, monkeypatch, frequent):
    """Without weights the class depends on no word before it: 13 words (with the end) of which 8 come twice or more, and an unknown one."""
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(400) if i not in held][:3]
    often = {f"often{k}": n for k, n in enumerate((40, 17, 9, 5, 3, 2, 2))}
    once = [f"once{k}" for k in range(5)]
    texts = [" ".join(w for w, n in often.items() for _ in range(n)), " ".join(once), ""]
    probes = [*often, *once, "never", ""]
    rows = spark.createDataFrame([*zip(train, texts), *zip(held, probes)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in language_model.score_documents(rows, rounds=0).collect()}
    of = {w: score[i] for i, w in zip(held, probes)}
    assert sum(10 ** (of[w] - of[""]) for w in probes if w) + 10 ** of[""] == pytest.approx(1.0, abs=1e-5)
    assert all(of[w] < of[""] for w in probes if w)


def test_model_beats_base_on_held_out(spark):
    rows = [r for r in queries.QUERIES["op3_maxent_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nearest_neighbours(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY 1").fetchnumpy()
    x = np.stack(table["embedding"]).astype(float)
    rows = learned_partitions.search(spark.read.parquet(path), "vec_id % 100 = 0").collect()
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * len(rows)


def test_nearest_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [1.0], 1), (None, [1.0, 1.0], 1)]
    rows += [(i, [2.0, 0.0], 1) for i in range(100, 130)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    out = learned_partitions.search(table, "vec_id % 100 = 0").orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out if r.query_id == 0] == list(range(100, 110))
    assert [(r.vec_id, r.score) for r in out if r.query_id == 100] == [(i, 0.0) for i in range(101, 111)]
    assert learned_partitions.search(table.limit(0), "vec_id % 100 = 0").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0 and pieces.agg({"length": "max"}).first()[0] <= 1024


def test_slices_and_kept_pieces_do_not_change_signatures(monkeypatch):
    texts = [f"a{k} b c d e f g h i{k % 3} " * (k % 7) for k in range(200)] + [None, ""]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    whole = pa.Table.from_batches(probminhash._sign(probminhash.BANDS)([batch]))
    words.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(words.texts_of(batch))
    monkeypatch.setattr(probminhash, "SLICE", 100)
    cut = pa.Table.from_batches(probminhash._sign(probminhash.BANDS)([batch]))
    assert cut.equals(whole)
    assert not words._encoders


CLASHING = ["host_rate", "path_rate", "global_rate", "__evidence", "__unfit", "s_source", "line_spans", "__id", "__kept", "__twin",
            "__digest", "__turn", "__q_id", "__class", "class_id", "rep", "size", "ticket", "Host_Rate2", "__extra_0"]


def test_extra_columns_may_have_any_name(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    crowded = plain.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in CLASHING])
    for stage in (
        lambda rows: site_quality.filter_documents(rows, labels), line_chunks.remove_repeated_chunks, probminhash.drop_near_duplicates,
        fair_queue.mix_sources,
    ):
        bare, full = stage(plain), stage(crowded)
        kept = [c for c in full.columns if c not in bare.columns]
        assert kept == [c for c in CLASHING if c not in bare.columns]
        key = lambda r: repr(r)
        assert sorted(map(key, full.select(*bare.columns).collect())) == sorted(map(key, bare.collect()))
        assert all(r[n] in (None, f"{n}:{r.doc_id}") for r in full.collect() for n in kept)


def test_expected_counts_take_each_context_once(monkeypatch):
    """Against one context at a time; rows of powers follow the different contexts and not the tokens."""
    texts = pa.array(["a b a b a b c", "", "B a " * 400, "c\tä b  a"], pa.large_string())
    found = language_model.features(*language_model.tokens(texts))
    rng = np.random.default_rng(3)
    shape = (language_model.TEMPLATES, language_model.BUCKETS, language_model.CLASSES)
    weights, bias = rng.normal(0, 1, shape).astype(np.float32), rng.normal(0, 1, language_model.CLASSES).astype(np.float32)
    bias[7] = -np.inf
    plain = np.zeros(shape)
    for context in found.T:
        p = np.exp(bias + sum(weights[k, b].astype(float) for k, b in enumerate(context)))
        for k, b in enumerate(context):
            plain[k, b] += p / p.sum()
    rows, powers_of = [], language_model.class_powers
    monkeypatch.setattr(language_model, "BATCH", 3)
    monkeypatch.setattr(language_model, "class_powers", lambda powers, part: rows.append(part.shape[1]) or powers_of(powers, part))
    total = np.zeros(shape)
    language_model.add_expected(language_model.factors(weights, bias), found, total)
    assert np.allclose(total, plain, rtol=1e-5, atol=1e-6)
    assert sum(rows) == language_model.TEMPLATES * len(set(map(tuple, found.T.tolist()))) < found.shape[1]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_plain_pieces_are_tokenized_once(vocabulary):
    """Case, marks behind a word and the line before it change no tokens of the word; ids are those of the library."""
    path = public_tokenizers.path(vocabulary)
    encoder, library = words.PieceEncoder(path), Tokenizer.from_file(path)
    texts = ["Straße straße, straße%%% straße?! straße.", "x\nstraße\nstraße,### straße's straße_ straße<| a-b straße...straße", "Åre-- x&&& no!\nNo?"]
    calls, tokenize = [], encoder._tokenize
    encoder._tokenize = lambda w: calls.append(w) or tokenize(w)
    encoder.cores.clear()
    ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == len(set(calls))


def test_token_store_packs_rows_together():
    """Rows packed at once are those packed one by one, for ranks of 1 to 4 bytes; ids of two and of four bytes may meet in a batch."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32) for n in (1, 2, 3, 4, 5, 8, 0, 1000)]
    n = np.array([len(r) for r in rows])
    bounds = np.concatenate([[0], np.cumsum(n)])
    control, ends, data, data_ends = token_store.pack_all(np.concatenate(rows), bounds)
    for k, row in enumerate(rows):
        one = control[ends[k] : ends[k + 1]].tobytes(), data[data_ends[k] : data_ends[k + 1]].tobytes()
        assert one == token_store.pack(row) and token_store.unpack(*one, len(row)).tolist() == row.tolist()
    assert token_store.unpack_all(control, ends, data, data_ends, n).tolist() == np.concatenate(rows).tolist()
    blobs = [np.array([7, 9], "<u2").tobytes(), np.array([70000], "<u4").tobytes(), np.array([5], "<u2").tobytes()]
    assert token_store._stored_ids(pa.array([b"", *blobs], pa.binary())[1:], np.array([2, 1, 1])).tolist() == [7, 9, 70000, 5]
