"""Approximate nearest neighbours by learned partitions.

A neighbour graph of at most ``SAMPLE`` vectors (those with the smallest hash) is cut into parts of equal size, refined by moving vertices to the part of
most of their neighbours under a size limit. A small classifier (one hidden layer) learns the parts from the vectors; its targets are the parts
of a vertex and its neighbours. Every vector of the table is indexed under its most probable part; a query is routed to its most probable
parts and ranked exactly against all their vectors, in blocks. The number of parts probed is the smallest that finds ``TARGET`` of
the neighbours of held-out sample vectors.

Equal vectors are one entry that holds as many of its smallest ids as a query can need; large parts are split into blocks by hash, on both
sides, so neither a common vector nor a crowded part meets in one task.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose dimension is not the
most frequent one; rows that repeat id and vector count once; rows without an id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import cut_lineage

SAMPLE = 12_288
PART_ROWS = 4096
MAX_PARTS = 256
NEIGHBOURS = 10
HIDDEN = 128
TARGET = 0.97
ROW_BLOCK, QUERY_BLOCK = 4096, 512


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 1024):
        d = norms[None] - 2 * x[start : start + 1024] @ x.T
        d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
        out[start : start + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng, rounds: int = 8) -> np.ndarray:
    """Part of each row: halving along directions of spread, then moves along the graph that keep every part within 5 % of its share."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = rng.standard_normal(x.shape[1])
        for _ in range(8):  # power iteration
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    sizes = np.bincount(label, minlength=parts)
    limit = math.ceil(len(x) / parts * 1.05)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int64)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[i].argmax())
            if sizes[to] < limit:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def train_classifier(x: np.ndarray, target: np.ndarray, rng, hidden: int = HIDDEN, epochs: int = 20) -> list[np.ndarray]:
    """Weights of a network with one hidden layer, by Adam on minibatches; ``target`` are distributions over parts."""
    w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
         rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            p = softmax(h @ w[2] + w[3])
            error = (p - target[rows]) / len(rows)
            back = (error @ w[2].T) * (h > 0)
            step += 1
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate([x[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0)]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    x = x / (model["scale"] + 1e-30)
    return softmax(np.maximum(x @ model["w0"] + model["w1"], 0) @ model["w2"] + model["w3"])


def fit(x: np.ndarray, parts: int, target: float = TARGET, seed: int = 7) -> dict:
    """Classifier weights, the scale of the vectors and the number of parts to probe."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    scale = np.sqrt((x * x).sum(axis=1).mean())
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return {"scale": scale, "w0": np.zeros((x.shape[1], 1)), "w1": np.zeros(1), "w2": np.zeros((1, 1)), "w3": np.zeros(1), "probes": 1}
    held = np.arange(len(x)) % 10 == 0
    seen, asked = x[~held] / scale, x[held] / scale
    graph = neighbour_graph(seen, NEIGHBOURS)
    label = balanced_parts(seen, graph, parts, rng)
    goal = np.zeros((len(seen), parts))
    np.add.at(goal, (np.repeat(np.arange(len(seen)), NEIGHBOURS), label[graph].ravel()), 1.0 / (NEIGHBOURS + 1))
    goal[np.arange(len(seen)), label] += 1.0 / (NEIGHBOURS + 1)
    w = train_classifier(seen, goal, rng)
    model = {"scale": scale, "w0": w[0], "w1": w[1], "w2": w[2], "w3": w[3]}
    home = probabilities(model, x[~held]).argmax(axis=1)
    d = (seen * seen).sum(axis=1)[None] - 2 * asked @ seen.T
    nearest = np.argpartition(d, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
    order = np.argsort(-probabilities(model, x[held]), axis=1)
    place = np.argsort(order, axis=1)
    reached = place[np.arange(len(asked))[:, None], home[nearest]]
    share = np.array([(reached < m).mean() for m in range(1, parts + 1)])
    return model | {"probes": int(np.argmax(share >= min(target, share.max()))) + 1}


def _fit_task(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, **fit(np.stack(rows.sort_values("gid")["embedding"].to_numpy()), parts))
        return pd.DataFrame({"model": [out.getvalue()]})
    return run


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """gid, ids, embedding: the distinct usable vectors, each with its ``keep`` smallest ids; gid is the smallest."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    usable = usable.where(F.size("embedding") == (common["d"] if common else 0))
    # a limit per group is applied before the shuffle, so a common vector sends few rows per task
    rank = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return usable.withColumn("place", rank).where(F.col("place") <= keep).groupBy("embedding").agg(
        F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("gid"), "ids", "embedding")


def _route(model, probes: int | None):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            p = probabilities(model.value, flat.reshape(batch.num_rows, -1))
            best = np.argsort(-p, axis=1, kind="stable")[:, : probes or 1].astype(np.int32)
            parts = pa.array(best.tolist(), pa.list_(pa.int32())) if probes else pa.array(best[:, 0])
            yield batch.append_column("part", parts)
    return run


def _block(keep: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"qid": [], "gid": [], "ids": [], "score": []})
        x, q = np.stack(rows["embedding"].to_numpy()), np.stack(asked["embedding"].to_numpy())
        d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * np.einsum("qd,xd->qx", q, x)
        k = min(keep, len(x)) - 1
        limit = np.partition(d, k, axis=1)[:, k]
        # rounding of the expanded form must not decide
        at, of = np.nonzero(d <= (limit + 1e-9 * (1 + np.abs(limit)))[:, None])
        score = np.sqrt(((q[at] - x[of]) ** 2).sum(axis=1))
        gid = rows["gid"].to_numpy()
        order = np.lexsort((gid[of], score, at))
        at, of, score = at[order], of[order], score[order]
        first = np.searchsorted(at, at)
        near = np.arange(len(at)) - first < keep
        return pd.DataFrame({"qid": asked["qid"].to_numpy()[at[near]], "gid": gid[of[near]], "ids": rows["ids"].to_numpy()[of[near]], "score": score[near]})
    return run


def search(vectors: DataFrame, is_query, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row that meets ``is_query`` (a condition on vec_id), itself left out."""
    spark = vectors.sparkSession
    keep = k + 1
    found = cut_lineage(entries(vectors, keep))
    total = found.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    parts = min(MAX_PARTS, -(-total // PART_ROWS))
    chosen = found.select("gid", "embedding").orderBy(F.xxhash64("gid"), "gid").limit(sample)
    blob = chosen.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_fit_task(parts), "model binary").first()["model"]  # one task, at most `sample` rows
    with np.load(io.BytesIO(blob)) as stored:
        model = {name: stored[name] for name in stored.files}
    probes = int(model["probes"])
    shared = spark.sparkContext.broadcast(model)
    index = cut_lineage(found.mapInArrow(_route(shared, None), "gid long, ids array<long>, embedding array<double>, part int"))

    asked_rows = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    asked_rows = cut_lineage(asked_rows.join(found.select("gid", "embedding"), "embedding").select("query_id", "gid"))
    asked = found.join(asked_rows.select("gid").distinct(), "gid").select(F.col("gid").alias("qid"), "embedding")
    asked = asked.mapInArrow(_route(shared, probes), "qid long, embedding array<double>, part array<int>")
    asked = cut_lineage(asked.select("qid", "embedding", F.explode("part").alias("part")))
    # one row per part
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("row_blocks")).join(
        asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks")), "part")
    sizes = F.broadcast(cut_lineage(sizes))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = index.join(sizes, "part").withColumn("i", F.pmod(F.xxhash64("gid"), F.col("row_blocks"))).withColumn("j", spread("query_blocks"))
    right = asked.join(sizes, "part").withColumn("j", F.pmod(F.xxhash64("qid"), F.col("query_blocks"))).withColumn("i", spread("row_blocks"))
    key = ["part", "i", "j"]
    near = left.select(*key, "gid", "ids", "embedding").groupBy(*key).cogroup(right.select(*key, "qid", "embedding").groupBy(*key)).applyInPandas(
        _block(keep), "qid long, gid long, ids array<long>, score double")
    by_score = [F.col("score"), F.col("vec_id")]
    near = near.select("qid", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*by_score))).where(F.col("place") <= keep)
    pairs = asked_rows.join(near, F.col("gid") == F.col("qid")).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
