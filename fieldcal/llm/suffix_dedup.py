"""Removal of repeated byte strings by longest previous factors.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. In the order of all suffixes, the
longest previous factor of a position is its longest common prefix with the previous or next suffix of a smaller document; it reaches
``LENGTH`` exactly when the run of suffixes that agree on that many bytes holds a smaller document. Only suffixes that can have such a factor are
ordered:

1. Every ``LENGTH``-byte window has an anchor, the ``KEY``-byte string in it with the smallest hash, so equal windows have equal anchors. Hashes of
   all anchors are dealt out in packed blocks, and those met in one document only are dropped. Anchors of one key at even distances (a
   periodic stretch) are dealt out as one entry.
2. For each anchor that is left, the bytes that windows around it can cover (its context) are taken, equal contexts once per slice of input, and
   sent to the bucket of its key. There, for each distance from window to anchor, the suffixes are sorted and runs get their smallest document.
   A key met more than ``HEAVY`` times has no bucket: its windows are grouped one by one by distance and bytes, combined before the shuffle.
3. Each document gets the windows whose smallest document is smaller than itself; their union is cut out.

Later copies of a whole text need no suffixes: all of a copy of at least ``LENGTH`` bytes goes. Texts are stored in buckets by document once, so steps
2 and 3 join to them without moving them again.

Defined results: a null text counts as empty; rows without a doc_id neither lose bytes nor make others lose them; rows that share a doc_id do not match each
other; rows that repeat both id and text are treated alike; a text shorter than ``LENGTH`` bytes is never changed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.words import ranges, slices
from fieldcal.session import cut_lineage, scratch_path

LENGTH = 50
KEY = 24
SPAN = LENGTH - KEY + 1
CONTEXT = 2 * LENGTH - KEY
#: bytes of text whose anchors make up a block of hashes; anchors whose contexts are made at once
BLOCK_BYTES = 4 << 20
CHUNK = 32_768
BUCKET_CONTEXTS = 65_536
HEAVY = 65_536
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as bytes, and their bounds."""
    column = pc.fill_null(batch.column(name).cast(pa.large_binary()), b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), bounds


def key_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KEY (= 16 + 8) bytes from each position on; the last ones run over the end and are cut off."""
    power = np.uint64(0x9E3779B97F4A7C15)
    h = mix(data.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        parts = {}
        for size in (1, 2, 4, 8):
            h = h[:-size] * power + h[size:]
            power = power * power
            parts[2 * size] = h
        eight, sixteen = parts[8], parts[16]
        return mix(sixteen[: len(data) - KEY + 1] * np.uint64(0xD6E8FEB86659FD93) + eight[16 : 16 + len(data) - KEY + 1])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The pick (minimum or maximum) of each ``width`` neighbours from a position on."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in the data and key hash of the anchors of all windows."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64)
    sizes = np.diff(bounds)
    h = key_hashes(data)
    ends = np.repeat(bounds[1:], sizes)
    here = np.arange(len(h))
    h[here + KEY > ends[: len(h)]] = TOP
    least = _sliding(h, SPAN, np.minimum)
    windows = np.arange(len(least)) + LENGTH <= ends[: len(least)]
    # a key is an anchor when it is the least of a window; windows over a border count as zero, which no key equals
    largest = np.where(windows, least, np.uint64(0))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), largest, np.zeros(SPAN - 1, np.uint64)])
    of_key = _sliding(padded, SPAN, np.maximum)[: len(h)]
    at = np.flatnonzero((of_key == h) & (h != TOP))
    return np.searchsorted(bounds, at, side="right") - 1, at, h[at]


def stretches(doc: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First anchor, distance and number of each run of neighbouring anchors with one key at even distances in a document."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.r_[False, (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])]
    gap = np.r_[0, np.diff(at)]
    first = np.flatnonzero(~same | (np.r_[False, same[:-1]] & (gap != np.r_[0, gap[:-1]])))
    number = np.diff(np.r_[first, len(at)])
    return first, np.where(number > 1, gap[np.minimum(first + 1, len(at) - 1)], 0), number


def _emit_anchors(blocks: int):
    """Packed anchors of a slice for each block of hashes: key hashes, rows and places; a stretch has place, distance and number."""
    def run(batches):
        for batch in slices(batches):
            data, bounds = _bytes(batch)
            doc, at, h = anchors(data, bounds)
            first, gap, number = stretches(doc, at, h)
            doc, at, h = doc[first], at[first], h[first]
            row = batch.column("row").to_numpy()[doc]
            place = np.column_stack([at - bounds[doc], gap, number]).astype(np.int32)
            block = (h % np.uint64(blocks)).astype(np.int64)
            for long in (False, True):
                order = np.flatnonzero((number > 1) == long)
                order = order[np.argsort(block[order], kind="stable")]
                held, cuts = np.unique(block[order], return_index=True)
                parts = np.split(order, cuts[1:]) if len(held) else []
                # five bytes besides the block are enough to drop what is met once; contexts are compared in full later
                yield pa.record_batch({
                    "block": pa.array(held, pa.int64()), "long": pa.array(np.full(len(held), long)),
                    "keys": pa.array([np.ascontiguousarray(h[p].view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes() for p in parts], pa.binary()),
                    "rows": pa.array([row[p].tobytes() for p in parts], pa.binary()),
                    "places": pa.array([(place[p] if long else place[p, 0]).tobytes() for p in parts], pa.binary()),
                })
    return run


def _repeated(heavy: int):
    """Per document the places whose key is also met in another document; apart if the key has more than ``heavy`` entries."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, 5) for b in rows["keys"]])
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        key = wide.view("<u8").ravel()
        row = np.concatenate([np.frombuffer(b, np.int64) for b in rows["rows"]])
        parts = []
        for b, long in zip(rows["places"], rows["long"]):
            found = np.frombuffer(b, np.int32)
            parts.append(found.reshape(-1, 3) if long else np.column_stack([found, np.zeros_like(found), np.ones_like(found)]))
        place = np.concatenate(parts)
        order = np.argsort(key, kind="stable")
        key, row, place = key[order], row[order], place[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        keep = np.repeat(np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts), sizes)
        kind = 2 * np.repeat(sizes > heavy, sizes) + (place[:, 2] > 1)
        row, place, kind = row[keep], place[keep], kind[keep]
        order = np.lexsort((kind, row))
        row, place, kind = row[order], place[order], kind[order]
        cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])]) if len(row) else np.empty(0, np.int64)
        lists = np.split(place, cuts[1:]) if len(cuts) else []
        return pd.DataFrame({
            "row": row[cuts], "kind": kind[cuts].astype(np.int32),
            "places": [(p if k % 2 else p[:, 0]).tobytes() for p, k in zip(lists, kind[cuts])],
            "n": np.array([int(p[:, 2].sum()) for p in lists], np.int64),
        })
    return run


def _places(batch: pa.RecordBatch, heavy: bool) -> list[np.ndarray]:
    """The places of each document, stretches written out."""
    out = []
    single, long = (batch.column(f"places{2 * heavy + k}") for k in (0, 1))
    for one, many in zip(single, long):
        runs = np.frombuffer(b"".join(many.as_py() or []), np.int32).reshape(-1, 3).astype(np.int64)
        at = np.repeat(runs[:, 0], runs[:, 2]) + ranges(np.zeros(len(runs), np.int64), runs[:, 2]) * np.repeat(runs[:, 1], runs[:, 2])
        out.append(np.concatenate([np.frombuffer(b"".join(one.as_py() or []), np.int32).astype(np.int64), at]))
    return out


def _contexts(batches, heavy: bool):
    """Per chunk of candidate anchors (of heavy or of other keys): the batch, their documents in it, places and contexts.

    A context is the bytes that windows around an anchor can cover, zero beyond the text's ends, and the two counts of real bytes.
    """
    for batch in slices(batches):
        places = _places(batch, heavy)
        if not any(len(p) for p in places):
            continue
        data, bounds = _bytes(batch)
        docs = np.repeat(np.arange(len(places)), [len(p) for p in places])
        every = np.concatenate(places)
        for at in range(0, len(every), CHUNK):
            doc, place = docs[at : at + CHUNK], every[at : at + CHUNK]
            size = np.diff(bounds)[doc]
            spots = place[:, None] + np.arange(-(SPAN - 1), LENGTH)[None]
            inside = (spots >= 0) & (spots < size[:, None])
            context = data[np.where(inside, spots + bounds[:-1][doc][:, None], 0)]
            context[~inside] = 0
            left, right = np.minimum(place, SPAN - 1), np.minimum(size - place, LENGTH)
            yield batch, doc, place, np.column_stack([context, left.astype(np.uint8), right.astype(np.uint8)])


def _digests(context: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each context."""
    words = np.zeros((len(context), 80), np.uint8)
    words[:, : context.shape[1]] = context
    words = words.view("<u8")
    out = []
    for seed in (1, 2):
        h = np.full(len(context), seed, np.uint64)
        for k in range(words.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
        out.append(h.view(np.int64))
    return np.column_stack(out)


def _chosen(owner: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each different context the place with the smallest document."""
    order = np.lexsort((owner, digest[:, 1], digest[:, 0]))
    same = np.all(digest[order][1:] == digest[order][:-1], axis=1)
    return order[np.r_[True, ~same]]


def _emit_contexts(buckets: int):
    def run(batches):
        for batch, doc, _, context in _contexts(batches, False):
            digest = _digests(context)
            owner = batch.column("doc_id").to_numpy()[doc]
            chosen = _chosen(owner, digest)
            key = _digests(np.ascontiguousarray(context[chosen, SPAN - 1 : SPAN - 1 + KEY]))[:, 0].view(np.uint64)
            yield pa.record_batch({
                "bucket": pa.array((key % np.uint64(buckets)).astype(np.int64)),
                "context": pa.array([c.tobytes() for c in context[chosen]], pa.binary()), "owner": pa.array(owner[chosen]),
            })
    return run


def _emit_windows(batches):
    """The windows around anchors of heavy keys: context, distance from window to anchor, bytes, document."""
    for batch, doc, _, context in _contexts(batches, True):
        digest = _digests(context)
        owner = batch.column("doc_id").to_numpy()[doc]
        chosen = _chosen(owner, digest)
        digest, owner, context = digest[chosen], owner[chosen], context[chosen]
        for back in range(SPAN):
            real = np.flatnonzero((context[:, -2] >= back) & (context[:, -1] >= LENGTH - back))
            start = SPAN - 1 - back
            yield pa.record_batch({
                "d1": pa.array(digest[real, 0]), "d2": pa.array(digest[real, 1]), "back": pa.array(np.full(len(real), back, np.int32)),
                "window": pa.array([c.tobytes() for c in context[real, start : start + LENGTH]], pa.binary()), "owner": pa.array(owner[real]),
            })


def _factors_of_windows(batches):
    """The smallest documents of a context's windows as runs, as from ``_previous_factors``."""
    for batch in batches:
        run_at, run_doc = [], []
        for found in batch.column("found").to_pylist():
            first = np.full(SPAN, np.iinfo(np.int64).max)
            for f in found:
                first[f["back"]] = f["least"]
            at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            run_at.append(at.tolist())
            run_doc.append(first[at].tolist())
        yield pa.record_batch({
            "d1": batch.column("d1"), "d2": batch.column("d2"),
            "run_at": pa.array(run_at, pa.list_(pa.int32())), "run_doc": pa.array(run_doc, pa.list_(pa.int64())),
        })


def _emit_records(batches):
    for batch, doc, place, context in (found for held in batches for heavy in (False, True) for found in _contexts([held], heavy)):
        digest = _digests(context)
        yield pa.record_batch({
            "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]), "row": batch.column("row").take(pa.array(doc)),
            "doc_id": batch.column("doc_id").take(pa.array(doc)), "place": pa.array(place),
        })


def _previous_factors(rows: pd.DataFrame) -> pd.DataFrame:
    """For each context the smallest document of every window around its anchor, as runs of equal documents."""
    context = np.frombuffer(b"".join(rows["context"]), np.uint8).reshape(len(rows), -1)
    owner = rows["owner"].to_numpy()
    left, right = context[:, -2].astype(int), context[:, -1].astype(int)
    first = np.full((len(rows), SPAN), np.iinfo(np.int64).max)  # for windows over a text's ends
    for back in range(SPAN):
        real = np.flatnonzero((left >= back) & (right >= LENGTH - back))
        if not len(real):
            continue
        start = SPAN - 1 - back
        suffix = np.ascontiguousarray(context[real, start : start + LENGTH]).view(f"V{LENGTH}").ravel()
        order = np.argsort(suffix, kind="stable")
        ordered = context[real[order], start : start + LENGTH]
        runs = np.flatnonzero(np.r_[True, np.any(ordered[1:] != ordered[:-1], axis=1)])
        least = np.minimum.reduceat(owner[real[order]], runs)
        first[real[order], back] = np.repeat(least, np.diff(np.r_[runs, len(real)]))
    changes = np.column_stack([np.ones(len(rows), bool), first[:, 1:] != first[:, :-1]])
    at = [np.flatnonzero(c) for c in changes]
    digest = _digests(context)
    return pd.DataFrame({
        "d1": digest[:, 0], "d2": digest[:, 1], "run_at": at, "run_doc": [f[a] for f, a in zip(first, at)],
    }).drop_duplicates(["d1", "d2"])


def _spans(batches):
    """Byte ranges of the windows around an anchor that a smaller document holds, joined where they meet."""
    for batch in batches:
        counts = pc.list_value_length(batch.column("run_at")).to_numpy(zero_copy_only=False).astype(np.int64)
        record = np.repeat(np.arange(batch.num_rows), counts)
        at = batch.column("run_at").flatten().to_numpy().astype(np.int64)
        until = np.append(at[1:], SPAN)
        until[np.cumsum(counts) - 1] = SPAN
        hit = batch.column("run_doc").flatten().to_numpy() < batch.column("doc_id").to_numpy()[record]
        record, at, until = record[hit], at[hit], until[hit]
        place = batch.column("place").to_numpy()[record]
        yield pa.record_batch({
            "row": batch.column("row").take(pa.array(record)), "start": pa.array(place - until + 1), "end": pa.array(place - at + LENGTH),
        })


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def _cut(with_text: bool):
    def run(batches):
        for batch in slices(batches):
            data, bounds = _bytes(batch)
            out = []
            for i, spans in enumerate(batch.column("spans")):
                raw = data[bounds[i] : bounds[i + 1]]
                found = spans.as_py() or []
                if batch.column("copy")[i].as_py() and len(raw) >= LENGTH:
                    found = [{"start": 0, "end": len(raw)}]
                keep = np.ones(len(raw), bool)
                starts = ends = np.empty(0, np.int64)
                if found:
                    starts, ends = merged(np.array([s["start"] for s in found]), np.array([s["end"] for s in found]))
                    keep[ranges(starts, ends - starts)] = False
                kept = raw[keep].tobytes()
                out.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            n_bytes, gone, spans, digest, kept = zip(*out)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
            } | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))
    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept (the bytes left)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    # later copies of whole texts, by digest
    slim = cut_lineage(rows.where("doc_id is not null").select(
        "row", "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")))
    blocks = (slim.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES + 1
    firsts = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = slim.join(firsts, "sha").where("doc_id > first").select("row").distinct().withColumn("copy", F.lit(True))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_{uuid.uuid4().hex}"
    marked = rows.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    marked.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("compression", "zstd").option(
        "path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)

    packed = texts.where("not copy and doc_id is not null").select("row", "text").mapInArrow(
        _emit_anchors(blocks), "block long, long boolean, keys binary, rows binary, places binary")
    repeated = packed.groupBy("block").applyInPandas(_repeated(HEAVY), "row long, kind int, places binary, n long")
    # a document's places come from all blocks; kinds: places and stretches of other keys, then of heavy keys
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col("places"))).alias(f"places{k}") for k in range(4)]
    wanted = cut_lineage(repeated.groupBy("row").agg(
        *lists, F.sum(F.when(F.col("kind") < 2, F.col("n")).otherwise(0)).alias("n"), F.max(F.col("kind") >= 2).alias("heavy")))
    total, heavy = wanted.agg(F.sum("n"), F.max("heavy")).first()
    number = max(1, int((total or 0) // BUCKET_CONTEXTS) + 1)
    held = texts.where("not copy and doc_id is not null").select("row", "doc_id", "text").join(wanted.drop("n"), "row")
    contexts = held.mapInArrow(_emit_contexts(number), "bucket long, context binary, owner long")
    factors = contexts.groupBy("bucket").applyInPandas(_previous_factors, "d1 long, d2 long, run_at array<int>, run_doc array<long>")
    if heavy:
        windows = held.where("heavy").mapInArrow(_emit_windows, "d1 long, d2 long, back int, window binary, owner long")
        least = windows.groupBy("back", "window").agg(F.min("owner").alias("least"))
        met = windows.drop("owner").join(least, ["back", "window"]).groupBy("d1", "d2").agg(F.collect_set(F.struct("back", "least")).alias("found"))
        factors = factors.unionByName(met.mapInArrow(_factors_of_windows, "d1 long, d2 long, run_at array<int>, run_doc array<long>"))
    records = held.mapInArrow(_emit_records, "d1 long, d2 long, row long, doc_id long, place long")
    spans = records.join(factors, ["d1", "d2"]).select("row", "doc_id", "place", "run_at", "run_doc").mapInArrow(_spans, "row long, start long, end long")
    spans = cut_lineage(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.join(spans, "row", "left").select("doc_id", "text", "copy", "spans").mapInArrow(_cut(with_text), schema)
