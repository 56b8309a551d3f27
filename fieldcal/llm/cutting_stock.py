"""Packing documents into sequences by column generation for the cutting-stock problem.

Documents are cut into pieces of the full sequence length and one tail. Full pieces are sequences of their own. Tails are counted by length
(a histogram of fewer than ``capacity`` rows), and a linear program over patterns (how many tails of each length share a sequence) is
solved on it: columns are priced by a knapsack dynamic program over all fill levels, since a sequence filled to a power of two
needs no padding. Pattern counts are rounded down; what is left is filled greedily, largest first. Tails are ranked within their
length (per-task counts plus a running total over tasks), and each takes the place that the patterns give its rank.

Defined results: a null text counts as empty and gives one piece with the end id; rows that repeat a doc_id, or have none, are packed
as documents of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.llm.words import encoder, ranges, slices, texts_of
from fieldcal.session import cut_lineage

CAPACITY = 1024
END_ID = 0
#: the linear program ends when its cost is within this share of the tokens to be packed, or after so many columns
GAP = 1e-4
MAX_COLUMNS = 400


def padded_length(used, capacity: int = CAPACITY):
    """Sequences are padded to the capacity unless they are filled to a power of two."""
    used = np.asarray(used)
    return np.where((used & (used - 1)) == 0, used, capacity)


def _knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of tails that fill each level exactly, and the last tail put in (-1: the level can't be reached)."""
    best = np.full(capacity + 1, -np.inf)
    last = np.full(capacity + 1, -1, np.int64)
    best[0] = 0.0
    for level in range(1, capacity + 1):
        n = np.searchsorted(lengths, level, side="right")
        if n:
            options = best[level - lengths[:n]] + value[:n]
            k = int(np.argmax(options))
            if options[k] > -np.inf:
                best[level], last[level] = options[k], k
    return best, last


def _column(last: np.ndarray, lengths: np.ndarray, level: int) -> np.ndarray:
    pattern = np.zeros(len(lengths), np.int64)
    while level:
        pattern[last[level]] += 1
        level -= lengths[last[level]]
    return pattern


def greedy_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that use up ``counts``: the largest tails that fit, as often as all of them are there."""
    left, out = counts.copy(), []
    while left.sum():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            take = min(room // lengths[k], left[k])
            pattern[k], room = take, room - take * lengths[k]
            if room < lengths[0]:
                break
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left = left - times * pattern
    return out


def _start(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A first basis with its solution and inverse: largest tails first, each pattern used (in fractions) until one length is used up.

    Later patterns do not hold that length, so the basis is triangular in this order and its inverse comes row by row.
    """
    order = []
    left = counts.astype(float)
    columns, x = [np.zeros(0)] * len(lengths), np.zeros(len(lengths))
    open_ = np.ones(len(lengths), bool)
    while open_.any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        for k in np.flatnonzero(open_)[::-1]:
            take = min(room // lengths[k], int(left[k]) + 1)
            pattern[k], room = take, room - take * lengths[k]
            if room < lengths[0]:
                break
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        k = held[int(np.argmin(ratio))]
        columns[k], x[k] = pattern, ratio.min()
        left = np.maximum(left - ratio.min() * pattern, 0.0)
        left[k], open_[k] = 0.0, False
        order.append(k)
    inverse = np.zeros((len(lengths), len(lengths)))
    basis = np.array(columns)
    for k in order:
        row = np.zeros(len(lengths))
        row[k] = 1.0
        for j in np.flatnonzero(basis[:, k]):
            if j != k:
                row -= basis[j, k] * inverse[j]
        inverse[k] = row / basis[k, k]
    return columns, x, inverse


def solve_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP,
                   max_columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Patterns with their numbers of sequences, which together hold ``counts`` tails of ``lengths`` (ascending) exactly."""
    if not len(lengths):
        return []
    columns, x, inverse = _start(lengths, counts, capacity)
    cost = padded_length((np.array(columns) * lengths).sum(axis=1), capacity).astype(float)
    dual = np.einsum("i,ij->j", cost, inverse)
    demand = float((lengths * counts).sum())
    levels = np.arange(capacity + 1)
    price = padded_length(levels, capacity).astype(float)
    for _ in range(max_columns):
        if cost @ x <= demand * (1 + gap):
            break
        best, last = _knapsack(dual, lengths, capacity)
        gain = best - price
        gain[0] = -np.inf
        level = int(np.argmax(gain))
        if gain[level] <= 1e-7 * capacity:
            break
        pattern = _column(last, lengths, level)
        held = np.flatnonzero(pattern)  # a pattern holds few lengths; a whole matrix product would cost more
        direction = (inverse[:, held] * pattern[held]).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1.0), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * direction, 0.0)
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        dual = dual + (price[level] - dual[held] @ pattern[held]) * row
        inverse -= np.outer(direction, row)
        inverse[out] = row
        cost[out], columns[out] = price[level], pattern
    left = counts.copy()
    solved = []
    for k in np.argsort(-x):
        if x[k] > 0:
            used = columns[k] > 0
            times = min(int(x[k] + 1e-6), int((left[used] // columns[k][used]).min()))
            if times > 0:
                solved.append((columns[k], times))
                left = left - times * columns[k]
    return solved + greedy_patterns(lengths, left, capacity)


def places(lengths: np.ndarray, patterns: list[tuple[np.ndarray, int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that go to one pattern, sorted by key = length and first rank."""
    key, copies, sequence, offset = [], [], [], []
    taken = np.zeros(len(lengths), np.int64)
    first = 0
    for pattern, times in patterns:
        at = 0
        for k in np.flatnonzero(pattern):
            key.append((int(lengths[k]) << 48) + int(taken[k]))
            copies.append(int(pattern[k]))
            sequence.append(first)
            offset.append(at)
            taken[k] += int(pattern[k]) * times
            at += int(pattern[k]) * int(lengths[k])
        first += times
    order = np.argsort(np.array(key, np.int64))
    named = {"key": key, "copies": copies, "sequence": sequence, "offset": offset}
    return {n: np.array(v, np.int64)[order] for n, v in named.items()} | {"sequences": np.int64(first)}


def _measure(path: str, end_id: int, capacity: int):
    """Tokenize: per document its tokens, the checksum of each piece, and its place among the task's full pieces and tails."""

    def run(batches):
        shard, tails, full = TaskContext.get().partitionId(), np.zeros(capacity, np.int64), 0
        for batch in slices(batches):
            ids, bounds = encoder(path).encode(texts_of(batch))
            n = np.diff(bounds) + 1
            sums = []
            for a, b in zip(bounds, bounds[1:]):
                raw = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                sums.append([zlib.crc32(raw[i : i + capacity].tobytes()) for i in range(0, len(raw), capacity)])
            before, order = full + np.cumsum(n // capacity) - n // capacity, []
            for tail in (n % capacity).tolist():
                order.append(int(tails[tail]))
                tails[tail] += 1
            full += int((n // capacity).sum())
            yield pa.record_batch({
                "shard": pa.array(np.full(len(n), shard, np.int32)), "doc_id": batch.column("doc_id").cast(pa.int64()),
                "doc_tokens": pa.array(n, pa.int64()), "tail": pa.array(n % capacity, pa.int64()),
                "tail_order": pa.array(order, pa.int64()), "full_before": pa.array(before, pa.int64()),
                "sums": pa.array(sums, pa.list_(pa.int64())),
            })
    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    measured = cut_lineage(docs.select("doc_id", "text").mapInArrow(
        _measure(tokenizer, end_id, capacity),
        "shard int, doc_id long, doc_tokens long, tail long, tail_order long, full_before long, sums array<long>"))
    counts = measured.groupBy("shard", "tail").agg(F.count("*").alias("n"))
    histogram = counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).orderBy("tail").collect()  # fewer rows than the capacity
    lengths, demand = np.array([r["tail"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64)
    where = spark.sparkContext.broadcast(places(lengths, solve_patterns(lengths, demand, capacity), capacity))

    by_length = Window.partitionBy("tail").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    bases = counts.select("shard", "tail", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("tail_base"))
    full = measured.groupBy("shard").agg(F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("n"))
    full = full.select("shard", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("full_base"))
    ranked = measured.join(bases, ["shard", "tail"]).join(full, "shard").select(
        "doc_id", "doc_tokens", "sums", "tail", (F.col("tail_base") + F.col("tail_order")).alias("tail_rank"),
        (F.col("full_base") + F.col("full_before")).alias("full_rank"))

    def assign(batches):
        at = where.value
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            tail, rank, full_rank = (batch.column(c).to_numpy() for c in ("tail", "tail_rank", "full_rank"))
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            part = ranges(np.zeros(len(n), np.int64), pieces)
            length = np.minimum(n[doc] - part * capacity, capacity)
            sequence, offset = at["sequences"] + full_rank[doc] + part, np.zeros(len(doc), np.int64)
            ends = np.flatnonzero(length < capacity)
            if len(ends):
                d = doc[ends]
                run = np.searchsorted(at["key"], (tail[d] << 48) + rank[d], side="right") - 1
                inside = rank[d] - (at["key"][run] & ((1 << 48) - 1))
                sequence[ends] = at["sequence"][run] + inside // at["copies"][run]
                offset[ends] = at["offset"][run] + inside % at["copies"][run] * tail[d]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": pa.array(part * capacity),
                "length": pa.array(length), "ids_crc32": batch.column("sums").flatten(), "doc_tokens": pa.array(n[doc]),
                "sequence_id": pa.array(sequence), "offset": pa.array(offset),
            })

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)
