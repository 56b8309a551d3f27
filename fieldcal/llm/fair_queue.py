"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document of a source gets a place in the source's shuffled order, which is repeated up to ``REPEATS`` times, and a virtual
finish time: the source's words up to and with it, divided by the source's target. Turns are taken in the order of finish time, over
all sources, until the budget (the words of all sources together) is used up.

Running totals are two-level: rows fall into buckets of equal hash range, bucket sums are accumulated, then rows within a bucket.
Buckets are sized by row count, so a source with a third of all rows is many buckets, never one task. The global order is cut the same
way: words are summed by step of virtual time, and only the step in which the budget runs out is put in exact order.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without words has target 0
and is not taken; rows that repeat id, source and text are separate rows; an empty table gives no rows; other columns are kept by
``mix_sources`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.llm.columns import apart
from fieldcal.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BUCKET_ROWS = 8192
STEP_WORDS = 1 << 22
LAST_TIME = 4.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_rows, source_size, target.

    Sources are ordered by cap per weight; the first one whose cap (``repeats`` times its size) does not bind fixes the common factor
    for itself and all after it, those before it are capped.
    """
    total = sized.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("cap", F.col("source_size") * repeats).select(
        "*",
        F.sum("source_size").over(everything).alias("budget"), F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(by_cap), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)).alias("weight_before"),
    ).withColumn("factor", (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    free = F.col("factor") * F.col("weight") < F.col("cap")
    common = F.max(F.when(free, F.col("factor"))).over(everything)
    return level.withColumn("common", common).select(
        "source", "source_rows", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def finish_time(turn: Column | int) -> Column:
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.when(F.col("target") > 0, (turn * F.col("source_size") + F.col("served")) / F.col("target"))


def fair_queue(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, digest, twin, size, source_size, target, copies (turns within the budget).

    ``twin`` numbers the rows that share doc_id, source and text. Equal input gives equal output, however it is dealt out.
    """
    same = Window.partitionBy("doc_id", "source", "digest").orderBy("doc_id")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    sized = cut_lineage(sized.withColumn("twin", F.row_number().over(same)))
    ticket = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    spread = F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long")
    targets = source_targets(sized, weights, repeats).withColumnRenamed("source", "t_source")
    rows = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        .withColumn("ticket", ticket)
        .withColumn("bucket", F.floor(spread * F.ceil(F.col("source_rows") / BUCKET_ROWS) / F.lit(float(2**32))))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"),
    )
    order = ["ticket", "doc_id", "digest", "twin"]
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queue = (
        rows.withColumn("within", F.sum("size").over(within))
        .join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("served", F.col("base") + F.col("within"))
        .select("doc_id", "source", "digest", "twin", "ticket", "size", "source_size", "target", "served")
    )
    queue = cut_lineage(queue)
    last = _last_turn(queue, repeats)
    copies = F.lit(0)
    for turn in range(repeats) if last is not None else ():
        place = F.struct(finish_time(turn).alias("finish"), _row_key().alias("key"), F.lit(turn).alias("turn"))
        copies = copies + F.when(finish_time(turn).isNotNull() & (place <= last), 1).otherwise(0)
    return queue.withColumn("copies", copies.cast("long")).drop("ticket", "served")


def _row_key() -> Column:
    """The order of rows with equal finish time, by the columns of the window over a bucket."""
    return F.struct(
        F.col("ticket"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"),
        F.col("digest"), F.col("twin").cast("long").alias("twin"),
    )


def _last_turn(queue: DataFrame, repeats: int) -> Column | None:
    """The place (finish, row key, turn) of the last turn within the budget, None when nothing is taken."""
    budget = queue.agg(F.sum("size")).first()[0] or 0
    if budget == 0:
        return None
    turns = queue.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
    turns = turns.select("size", "turn", finish_time(F.col("turn")).alias("finish"), _row_key().alias("key")).where("finish is not null and size > 0")
    steps = -(-budget // STEP_WORDS)
    stepped = turns.withColumn("step", F.floor(F.least(F.col("finish"), F.lit(LAST_TIME)) * steps))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    totals = stepped.groupBy("step").agg(F.sum("size").alias("step_size")).withColumn("total", F.sum("step_size").over(upto))
    over = totals.where(F.col("total") > budget).orderBy("step").first()
    place = F.struct("finish", "key", "turn")
    if over is None:
        found = turns.agg(F.max(place)).first()[0]
    else:
        room = budget - (over["total"] - over["step_size"])
        run = Window.orderBy("finish", "key", "turn").rowsBetween(Window.unboundedPreceding, 0)
        inside = stepped.where(F.col("step") == over["step"]).withColumn("run", F.sum("size").over(run))
        found = inside.where(F.col("run") <= room).agg(F.max(place)).first()[0]
        if found is None:
            found = stepped.where(F.col("step") < over["step"]).agg(F.max(place)).first()[0]
    if found is None:
        return None
    return F.struct(
        F.lit(found["finish"]).alias("finish"),
        F.struct(F.lit(found["key"]["ticket"]).alias("ticket"), *[
            F.lit(found["key"][c]).cast("long").alias(c) for c in ("doc_id", "digest", "twin")]).alias("key"),
        F.lit(found["turn"]).alias("turn"),
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as many times as the queue takes it, with the columns of ``docs``."""
    return apart(docs, lambda rows: _mixed_rows(rows, weights, repeats, seed))


def _mixed_rows(docs: DataFrame, weights, repeats: int, seed: str) -> DataFrame:
    names = docs.columns
    queue = fair_queue(docs, weights, repeats, seed).select(
        F.col("doc_id").alias("__q_id"), F.col("source").alias("__q_source"), F.col("digest").alias("__q_digest"),
        F.col("twin").alias("__q_twin"), F.col("copies").alias("__q_copies"),
    ).where("__q_copies > 0")
    same = Window.partitionBy("doc_id", "source", "__digest").orderBy("doc_id")
    rows = docs.withColumn("__digest", F.xxhash64("text")).withColumn("__twin", F.row_number().over(same))
    match = (
        F.col("doc_id").eqNullSafe(F.col("__q_id")) & F.col("source").eqNullSafe(F.col("__q_source"))
        & (F.col("__digest") == F.col("__q_digest")) & (F.col("__twin") == F.col("__q_twin"))
    )
    return rows.join(queue, match).withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__q_copies").cast("int")))).select(*names)


def mixed(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    return fair_queue(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ticket
  FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
    ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM total),
level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::BIGINT::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS factor
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT source, source_size,
    coalesce(least(cap::DOUBLE, max(CASE WHEN factor * weight < cap THEN factor END) OVER () * weight), 0.0) AS target
  FROM level),
served AS (
  SELECT s.doc_id, s.source, s.size, s.ticket, t.source_size, t.target,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ticket, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, (turn * source_size + served)::DOUBLE / target AS finish
  FROM served, (SELECT unnest([0, 1, 2]) AS turn) WHERE target > 0),
run AS (
  SELECT doc_id, sum(size) OVER (ORDER BY finish, ticket, doc_id, turn ROWS UNBOUNDED PRECEDING) AS run FROM turns),
copies AS (SELECT doc_id, count(*) AS n FROM run WHERE run <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(s.size * coalesce(c.n, 0) AS BIGINT) AS taken, s.source,
  CAST(coalesce(c.n, 0) AS BIGINT) AS copies
FROM served s LEFT JOIN copies c ON s.doc_id = c.doc_id
"""
