"""A hashed maximum-entropy language model with a class-factored softmax.

Words are counted over all training texts. Frequent words (at most ``FREQUENT``) fall into ``CLASSES - 1`` classes of about equal mass by rank;
all other words, known or not, are the last class. The probability of a token is that of its class given the two tokens before it, times that
of the word in its class. Class weights belong to hashed features: the token before (n-gram), the one before that (skip), both together, and
a bias. They are trained by distributed updates over all training texts: every task sums the expected class counts of each feature under the
current weights, and the driver moves each weight along the gradient (observed less expected), scaled by the expected count. In the last
class all unknown words together have a share that grows with the number of words seen once, and known words share the rest by their counts;
classes without words are closed. So the probabilities of all known words and of "unknown" sum to 1 for every size of the vocabulary.

Defined results: a null text counts as empty and consists of the end token; a null doc_id counts as the text "" for the choice of held-out rows;
rows that repeat are scored each; without training rows all tokens are unknown; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.words import slices, texts_of, words_of
from fieldcal.session import cut_lineage

FREQUENT = 1 << 16
CLASSES = 64
BUCKETS = 4096
TEMPLATES = 3
ROUNDS = 3
RATE = 0.5
PRIOR = 20.0
BATCH = 1 << 11
FAN_IN = 64
#: cannot be a word, since it is white space
END = "\n"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words in lower case (A-Z only) with an end token after each text, as from ``words_of``."""
    index, distinct, bounds = words_of(texts, lower=True)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(index) + len(n), len(distinct), np.int64)
    out[np.arange(len(index)) + doc] = index
    return out, [*distinct, END], bounds + np.arange(len(bounds))


def features(index: np.ndarray, distinct: list[str], bounds: np.ndarray) -> np.ndarray:
    """For every token the buckets of its features, one row per template."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    hashed = np.append(hashed, np.uint64(1))  # before the text
    one = np.insert(index[:-1], 0, len(distinct)) if len(index) else index
    one[bounds[:-1]] = len(distinct)  # every text has a token
    two = np.insert(one[:-1], 0, len(distinct)) if len(index) else index
    two[bounds[:-1]] = len(distinct)
    mixed = mix(hashed)
    both = mixed[one] + (hashed * np.uint64(0x9E3779B97F4A7C15))[two]
    bucket = lambda x: (x % np.uint64(BUCKETS)).astype(np.uint16)
    return np.stack([bucket(mixed)[one], bucket(mix(hashed + np.uint64(1)))[two], bucket(mix(both + np.uint64(2)))])


def factors(weights: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
    """Powers of every bucket's weights, whose product over the templates is the power of a class. Steps are clipped, so products stay far
    from the limits of a float."""
    return [np.exp(weights[k] + bias if k == 0 else weights[k]) for k in range(TEMPLATES)]


def class_powers(powers: list[np.ndarray], found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the classes and their sum, for a batch of contexts."""
    e = powers[0].take(found[0], axis=0)
    for k in range(1, TEMPLATES):
        e *= powers[k].take(found[k], axis=0)
    return e, e @ np.ones(CLASSES, e.dtype)


def add_expected(powers: list[np.ndarray], found: np.ndarray, total: np.ndarray) -> None:
    """Add the expected class counts of every feature bucket. A context that occurs several times is computed once. Each template takes
    the contexts in the order of its own buckets, so that a bucket is summed over a stretch of rows just computed."""
    context = (found[0].astype(np.int64) * BUCKETS + found[1]) * BUCKETS + found[2]
    context, times = np.unique(context, return_counts=True)
    rest, last = np.divmod(context, BUCKETS)
    found = np.stack([*np.divmod(rest, BUCKETS), last]).astype(np.uint16)
    times = times.astype(np.float32)
    for k in range(TEMPLATES):
        order = np.argsort(found[k], kind="stable")
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            part = found[:, some]
            p, total_power = class_powers(powers, part)
            share = times[some] / total_power
            bounds = np.flatnonzero(np.diff(part[k], prepend=-1, append=BUCKETS).astype(bool))
            for bucket, start, end in zip(part[k][bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                total[k, bucket] += share[start:end] @ p[start:end]


def _count(batches):
    for batch in slices(batches):
        index, distinct, _ = tokens(texts_of(batch))
        yield pa.record_batch({"word": pa.array(distinct, pa.string()), "n": pa.array(np.bincount(index, minlength=len(distinct)), pa.int64())})


def _classes(model, distinct: list[str]) -> np.ndarray:
    get, last = model["class_of"].get, CLASSES - 1
    return np.fromiter((get(w, last) for w in distinct), np.int64, len(distinct))


def _observed(model):
    """Class counts of every feature bucket."""
    def run(batches):
        total = np.zeros((TEMPLATES, BUCKETS * CLASSES))
        for batch in slices(batches):
            index, distinct, bounds = tokens(texts_of(batch))
            found, classes = features(index, distinct, bounds), _classes(model.value, distinct)[index]
            for k in range(TEMPLATES):
                total[k] += np.bincount(found[k].astype(np.int64) * CLASSES + classes, minlength=BUCKETS * CLASSES)
        yield from _blocks(total.reshape(TEMPLATES, BUCKETS, CLASSES))
    return run


def _expected(model):
    """Expected class counts of every feature bucket under the current weights."""
    def run(batches):
        m = model.value
        powers, total = factors(m["weights"], m["bias"]), np.zeros((TEMPLATES, BUCKETS, CLASSES))
        for batch in slices(batches):
            add_expected(powers, features(*tokens(texts_of(batch))), total)
        yield from _blocks(total)
    return run


def _blocks(total: np.ndarray):
    """A task's sums as blocks of 256 buckets."""
    task = TaskContext.get().partitionId()
    flat = total.reshape(-1, 256, CLASSES).astype(np.float32)
    yield pa.record_batch({
        "block": pa.array(range(len(flat)), pa.int32()), "task": pa.array([task] * len(flat), pa.int32()),
        "sums": pa.array([b.tobytes() for b in flat], pa.binary()),
    })


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in rows["sums"])
    return pd.DataFrame({"block": rows["block"].iloc[:1], "task": rows["task"].iloc[:1] // FAN_IN, "sums": [total.astype(np.float32).tobytes()]})


def _total(texts: DataFrame, of_task) -> np.ndarray:
    """Sums over all tasks, added in two levels; the result has a fixed size."""
    schema = "block int, task int, sums binary"
    sums = texts.mapInArrow(of_task, schema)
    sums = sums.groupBy("block", F.expr(f"task div {FAN_IN}").alias("group")).applyInPandas(lambda rows: _add(rows), schema)
    sums = sums.groupBy("block").applyInPandas(_add, schema)
    out = np.zeros((TEMPLATES * BUCKETS // 256, 256, CLASSES))
    for row in sums.collect():  # a fixed number of blocks
        out[row["block"]] = np.frombuffer(row["sums"], np.float32).reshape(256, CLASSES)
    return out.reshape(TEMPLATES, BUCKETS, CLASSES)


def frequent_words(vocabulary: DataFrame, most: int = FREQUENT) -> list:
    """The words of the highest count levels that hold at most ``most`` words together."""
    level = F.floor(F.log2("c") * 16)
    room, least = most, None
    for row in vocabulary.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 16 levels per power of two
        if row["count"] > room:
            break
        room, least = room - row["count"], row["level"]
    if least is None:
        return []
    return vocabulary.where(level >= least).orderBy(F.desc("c"), "word").collect()


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[dict, DataFrame]:
    """The model (of fixed size) and the vocabulary (word, c) of the training texts."""
    spark = texts.sparkSession
    vocabulary = cut_lineage(texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    row = vocabulary.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n, v, once = row[0] or 0, row[1], row[2]
    top = frequent_words(vocabulary, FREQUENT)
    counts = np.array([r["c"] for r in top], float)
    mass = counts.sum()
    # classes of equal mass in the order of frequency; the first words are classes of their own
    upto = np.cumsum(counts) - counts
    place = np.minimum((upto / max(mass, 1) * (CLASSES - 1)).astype(int), CLASSES - 2)
    class_mass = np.bincount(place, counts, CLASSES) if len(top) else np.zeros(CLASSES)
    class_mass[CLASSES - 1] = n - mass
    # the last class is open to unknown words even if it holds no known one; no word can fall into any other class without mass
    open_mass = np.where(class_mass > 0, class_mass + 1, 0.0)
    open_mass[CLASSES - 1] = n - mass + 1
    with np.errstate(divide="ignore"):
        bias = np.log(open_mass / open_mass.sum())
    # words seen once are all in the last class if any known word is; alone in it they have half of it
    unknown = (once + 1) / (n - mass + once + 2) if n > mass else 1.0
    model = {
        "n": n, "v": v, "class_of": {r["word"]: int(k) for r, k in zip(top, place)}, "count_of": {r["word"]: r["c"] for r in top},
        "class_mass": class_mass, "tail_mass": n - mass, "unknown": unknown, "bias": bias.astype(np.float32),
        "weights": np.zeros((TEMPLATES, BUCKETS, CLASSES), np.float32),
    }
    if n:
        observed = _total(texts, _observed(spark.sparkContext.broadcast(model)))
        for k in range(rounds):
            if k == 0:  # without weights every feature expects the classes in their overall shares
                expected = observed.sum(axis=2, keepdims=True) * np.exp(bias)
            else:
                expected = _total(texts, _expected(spark.sparkContext.broadcast(model)))
            step = RATE * (observed - expected) / (expected + PRIOR)
            model["weights"] = (model["weights"] + np.clip(step, -2, 2)).astype(np.float32)
    return model, vocabulary


def _score(model):
    def run(batches):
        m = model.value
        powers = factors(m["weights"], m["bias"])
        task, row = TaskContext.get().partitionId(), 0
        with np.errstate(divide="ignore"):
            in_class = np.log10(m["class_mass"])
        for batch in slices(batches):
            index, distinct, bounds = tokens(texts_of(batch))
            found, kind = features(index, distinct, bounds), _classes(m, distinct)
            count = np.fromiter((m["count_of"].get(w, 0) for w in distinct), float, len(distinct))
            tail = kind == CLASSES - 1
            word = np.where(tail, 0.0, np.log10(np.maximum(count, 1)) - np.where(tail, 0.0, in_class[kind]))
            base, classes = np.log10(count + 1)[index], kind[index]
            score = word[index]
            exponent = sum(m["weights"][k][found[k], classes] for k in range(TEMPLATES)) + m["bias"][classes]
            for at in range(0, len(index), BATCH):
                _, total_power = class_powers(powers, found[:, at : at + BATCH])
                score[at : at + BATCH] += (exponent[at : at + BATCH] - np.log(total_power)) / math.log(10)
            known = (~tail)[index]
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(n)), n)
            sums = [np.bincount(doc, x, len(n)) for x in (base * known, score, known.astype(float))]
            # words outside the broadcast list, with their number in each text
            pairs, times = np.unique(doc[~known] * np.int64(len(distinct)) + index[~known], return_counts=True)
            ends = np.searchsorted(pairs // len(distinct), np.arange(len(n) + 1)).astype(np.int32)
            words = pa.array(distinct, pa.string()).take(pa.array(pairs % len(distinct)))
            yield pa.record_batch({
                "row": pa.array((task << 40) + row + np.arange(len(n))), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(n, pa.int64()), "known": pa.array(sums[2].astype(np.int64)), "base": pa.array(sums[0]), "part": pa.array(sums[1]),
                "tail": pa.ListArray.from_arrays(pa.array(ends), words), "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())),
            })
            row += len(n)
    return run


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (key % 7 == 2).alias("held_out"))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = split(docs)
    model, vocabulary = train(rows.where(~F.col("held_out")).select("text"), rounds)
    n, v, tail_mass, unknown = (model[k] for k in ("n", "v", "tail_mass", "unknown"))
    scored = cut_lineage(rows.mapInArrow(
        _score(spark.sparkContext.broadcast(model)),
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double, tail array<string>, times array<int>"))
    words = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("word"), F.col("w.times").alias("times"))
    met = words.join(vocabulary, "word", "left")
    c, times = F.coalesce(F.col("c"), F.lit(0)), F.col("times")
    # without tail mass no known word is met here
    in_tail = F.when(c > 0, F.log10(c) + F.lit(math.log10((1 - unknown) / tail_mass) if tail_mass else 0.0)).otherwise(F.lit(math.log10(unknown)))
    tails = met.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("t_known"), F.sum(times * F.log10(c + 1)).alias("t_base"), F.sum(times * in_tail).alias("t_part"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.drop("tail", "times").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("t_known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("part") + zero("t_part")).alias("score"),
    )
