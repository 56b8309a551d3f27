"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence of a document is the probability that it is unfit: a logistic regression on shape features (shares of repeated words, capitals,
symbols, and so on) for low quality, and naive Bayes over a learned word list (words and word beginnings) for toxicity. Both are fitted on at most ``SAMPLE``
labelled rows, those with the smallest hash of the doc_id. Evidence is summed over hosts (``source``) and paths (``source`` and ``lang``);
a host's rate is shrunk toward the global rate and a path's toward its host's, with strengths from the variance between sites
(method of moments). A document's log odds are its own evidence plus the log odds of its path against the global rate.

Defined results: a null text counts as empty; a null source or lang is a site of its own; labels that are null or contradict each other leave
their row out of the sample; without labelled rows nothing is rejected; rows that repeat are judged alike; other columns are kept by ``filter_documents``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.llm.columns import apart
from fieldcal.llm.words import release, slices, texts_of, words_of
from fieldcal.session import cut_lineage

SAMPLE = 8000
#: a word or beginning enters the list when in so many toxic sample rows, with such a log odds ratio; the list holds so many at most
MIN_ROWS, MIN_WEIGHT, LIST = 12, 4.5, 4096
BEGINNINGS = (4, 5, 6)
REJECT = 0.5
RIDGE = 1.0
#: bounds of the strength of a prior, in documents
STRENGTH = (1.0, 1e6)


def terms(word: str) -> list[str]:
    """A word, and its beginnings marked with a star."""
    word = word.lower().strip(".,;:!?\"'()[]#%$&*|")
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if word else []


def shape_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Features per text, and its words as from ``words_of``."""
    index, distinct, bounds = words_of(texts)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    size = np.fromiter(map(len, distinct), float, len(distinct))
    upper = np.fromiter((w.isupper() for w in distinct), float, len(distinct))
    symbols = np.fromiter((sum(not c.isalnum() for c in w[-3:]) >= 2 or not any(map(str.isalnum, w)) for w in distinct), float, len(distinct))
    digits = np.fromiter((any(map(str.isdigit, w)) for w in distinct), float, len(distinct))
    per = np.maximum(n, 1)
    share = lambda value: np.bincount(doc, value[index], len(n)) / per
    same = np.zeros(len(index))
    same[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.bincount(np.unique(doc * np.int64(len(distinct) + 1) + index) // (len(distinct) + 1), minlength=len(n)) / per
    columns = [
        np.bincount(doc, same, len(n)) / per, share(upper), share(symbols), share(digits), share(size) / 10, kinds, np.log1p(n) / 10,
        (n == 0).astype(float),
    ]
    return np.column_stack(columns), index, distinct, bounds


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights (intercept first) by Newton steps; elimination is written out since the matrix is tiny."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        gradient = (x * (p - y)[:, None]).sum(axis=0) + ridge * w
        hessian = np.einsum("ni,n,nj->ij", x, p * (1 - p), x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _evidence_of_sample(batches):
    """Per labelled row its features, then per task the rows with each term."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    seen = set()
    for batch in slices(batches):
        x, index, distinct, bounds = shape_features(texts_of(batch))
        toxic = batch.column("toxic").to_pylist()
        yield pa.record_batch({
            "x": pa.array(x.tolist(), pa.list_(pa.float64())), "quality": batch.column("quality").cast(pa.int32()),
            "toxic": batch.column("toxic").cast(pa.int32()), "term": pa.nulls(len(x), pa.string()), "n": pa.nulls(len(x), pa.int64()),
        })
        found = [terms(w) for w in distinct]
        for i, text in enumerate(texts_of(batch).to_pylist()):
            if hash(text) not in seen:
                seen.add(hash(text))
                counts[toxic[i]].update({t for k in set(index[bounds[i] : bounds[i + 1]].tolist()) for t in found[k]})
    for label, counted in counts.items():
        yield pa.record_batch({
            "x": pa.nulls(len(counted), pa.list_(pa.float64())), "quality": pa.nulls(len(counted), pa.int32()),
            "toxic": pa.array([label] * len(counted), pa.int32()), "term": pa.array(list(counted), pa.string()),
            "n": pa.array(list(counted.values()), pa.int64()),
        })


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The document model, from at most ``sample`` labelled rows. None without usable labels."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("q2"), F.min("toxic").alias("toxic"), F.max("toxic").alias("t2"))
    chosen = one.where("quality = q2 and toxic = t2").select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = cut_lineage(chosen.withColumnRenamed("doc_id", "l_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "quality", "toxic")
    seen = cut_lineage(rows.mapInArrow(_evidence_of_sample, "x array<double>, quality int, toxic int, term string, n long"))
    features = seen.where("term is null").select("x", "quality", "toxic").collect()  # the sample's rows
    if not features:
        return None
    x = np.array([r["x"] for r in features])
    low = np.array([r["quality"] == 0 for r in features], float)
    rows_of = {k: sum(r["toxic"] == k for r in features) for k in (0, 1)}
    side = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0))
    weight = F.log((F.col("pos") + 0.5) / (rows_of[1] + 1)) - F.log((F.col("neg") + 0.5) / (rows_of[0] + 1))
    listed = (
        seen.where("term is not null").groupBy("term").agg(side(1).alias("pos"), side(0).alias("neg"))
        .where(F.col("pos") >= MIN_ROWS).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.col("pos")), "term").limit(LIST).collect()
    )
    prior = math.log((rows_of[1] + 0.5) / (rows_of[0] + 0.5))
    return {"w": fit_logistic(x, low), "words": {r["term"]: r["weight"] for r in listed}, "prior": prior}


def _score(model):
    def run(batches):
        release()
        m = model.value
        for batch in slices(batches):
            x, index, distinct, bounds = shape_features(texts_of(batch))
            z = m["w"][0] + (x * m["w"][1:]).sum(axis=1)
            words = m["words"]
            weight = np.fromiter((max((words.get(t, 0.0) for t in terms(w)), default=0.0) for w in distinct), float, len(distinct))
            hits = np.flatnonzero(weight[index])
            doc = np.repeat(np.arange(len(x)), np.diff(bounds))[hits]
            pairs = np.unique(doc * np.int64(len(distinct) + 1) + index[hits])
            toxic = m["prior"] + np.bincount(pairs // (len(distinct) + 1), weight[pairs % (len(distinct) + 1)], len(x))
            fine = 1 / (1 + np.exp(np.clip(z, -30, 30))) / (1 + np.exp(np.clip(toxic, -30, 30)))
            yield batch.append_column("__evidence", pa.array(1 - fine))
    return run


def with_evidence(docs: DataFrame, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__evidence", T.DoubleType())])
    return docs.mapInArrow(_score(shared), schema)


def log_odds(p):
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, mean: float) -> float:
    """How many documents the prior of sites with ``n`` documents and ``bad`` expected unfit ones is worth."""
    spread = F.pow(F.col("bad") / F.col("n") - mean, 2)
    row = rates.agg(F.sum(F.col("n") * spread), F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    if not row[1] or row[1] < 2:
        return STRENGTH[1]
    scale = row[2] - row[3] / row[2]
    between = (row[0] - (row[1] - 1) * mean * (1 - mean)) / scale if scale > 0 else 0.0
    return STRENGTH[1] if between <= 0 else min(max(mean * (1 - mean) / between - 1, STRENGTH[0]), STRENGTH[1])


def site_posteriors(scored: DataFrame) -> DataFrame:
    """One row per path: s_source, s_lang, host_rate, path_rate, global_rate."""
    paths = cut_lineage(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("__evidence").alias("bad")))
    total = paths.agg(F.sum("bad"), F.sum("n")).first()
    mean = min(max((total[0] or 0.0) / (total[1] or 1), 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("source").alias("h_source"), ((F.col("bad") + of_host * mean) / (F.col("n") + of_host)).alias("host_rate"))
    return paths.join(hosts, F.col("source").eqNullSafe(F.col("h_source"))).select(
        F.col("source").alias("s_source"), F.col("lang").alias("s_lang"), "host_rate",
        ((F.col("bad") + of_path * F.col("host_rate")) / (F.col("n") + of_path)).alias("path_rate"), F.lit(mean).alias("global_rate"),
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with __evidence, host_rate, path_rate, __unfit (posterior probability)."""
    model = fit(docs, labels)
    if model is None:
        zero = F.lit(0.0)
        return docs.select("*", zero.alias("__evidence"), zero.alias("host_rate"), zero.alias("path_rate"), zero.alias("__unfit"))
    scored = with_evidence(docs, model)
    # evidence is computed twice, once for the sites and once for the rows: cheaper than moving the texts
    sites = cut_lineage(site_posteriors(with_evidence(docs.select("source", "lang", "text"), model)))
    same = F.col("source").eqNullSafe(F.col("s_source")) & F.col("lang").eqNullSafe(F.col("s_lang"))
    odds = log_odds(F.col("__evidence")) + log_odds(F.col("path_rate")) - log_odds(F.col("global_rate"))
    return scored.join(sites, same).withColumn("__unfit", 1 / (1 + F.exp(-odds))).drop("s_source", "s_lang", "global_rate")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return apart(docs, lambda rows: judge(rows, labels).where(F.col("__unfit") < REJECT).select(*rows.columns))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, evidence, host_rate, path_rate, unfit, kept."""
    return judge(docs.select("doc_id", "source", "lang", "text"), labels).select(
        "doc_id", F.col("__evidence").alias("evidence"), "host_rate", "path_rate", F.col("__unfit").alias("unfit"),
        (F.col("__unfit") < REJECT).alias("kept"),
    )
