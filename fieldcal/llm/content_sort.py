"""Exact duplicates by sorting content; DataFrame functions only.

Texts count as equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Normalised texts are dealt out by
range (splitters that Spark samples from a bounded head of the content and a digest), sorted externally, and neighbours are
compared in full by the window that follows the sort. A text that makes up more than a ``blocks``-th of all rows is cut into
salted blocks first; their best rows are compared in full once more.

Defined results: a null text counts as empty, all empty texts are one group; a null ``doc_id`` sorts last; rows that repeat
both id and text stand side by side in one group, and exactly one of them is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import cut_lineage

WHITE_SPACE = " \t\n\x0b\x0c\r"
HEAD_CHARS = 32
BLOCKS = 4096


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_sort(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        "doc_id", normalised(F.col("text")).alias("norm"),
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
    ).withColumn("digest", F.xxhash64("norm"))

    # fewer than `blocks` digests can each hold more than a blocks-th of the rows, so this table is bounded
    share = max(1, docs.count() // blocks)
    hot = (
        docs.select(F.xxhash64(normalised(F.col("text"))).alias("digest")).groupBy("digest").count()
        .where(F.col("count") > share)
        .select("digest", F.ceil(F.col("count") / share).alias("pieces"))
    )
    hot = cut_lineage(hot)
    salted = rows.join(F.broadcast(hot), "digest", "left").select(
        "doc_id", "norm", "chars", "digest", F.substring("norm", 1, HEAD_CHARS).alias("head"),
        F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(-1)).alias("salt"),
    )
    best_first = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    block = Window.partitionBy("head", "digest", "salt", "norm").orderBy(*best_first)
    dealt = salted.repartitionByRange("head", "digest", "salt")
    placed = dealt.select(
        "doc_id", "salt",
        F.row_number().over(block).alias("place"),
        F.first("doc_id").over(block).alias("block_id"),
        F.first("chars").over(block).alias("block_chars"),
        F.count("*").over(Window.partitionBy("head", "digest", "salt", "norm")).alias("block_size"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("salt") >= 0, F.col("norm")).alias("norm"),
    )
    # the texts of hot groups are needed for the best row of each block only
    slim = cut_lineage(placed.withColumn("norm", F.when(F.col("place") == 1, F.col("norm"))))

    # at most 2 * blocks rows
    heads = slim.where((F.col("place") == 1) & (F.col("salt") >= 0))
    whole = Window.partitionBy("norm")
    group = whole.orderBy(F.col("block_chars").desc(), F.col("block_id").asc_nulls_last(), "salt")
    merged = heads.select(
        "text_sha256", "salt", F.first("block_id").over(group).alias("hot_id"), F.first("salt").over(group).alias("hot_salt"),
        F.sum("block_size").over(whole).alias("hot_size"),
    )
    rows = slim.drop("norm", "block_chars").join(F.broadcast(merged), ["text_sha256", "salt"], "left")
    best = F.when(F.col("salt") >= 0, F.col("salt") == F.col("hot_salt")).otherwise(F.lit(True))
    return rows.select(
        "doc_id", F.when(F.col("salt") >= 0, F.col("hot_id")).otherwise(F.col("block_id")).alias("keep_id"),
        F.coalesce("hot_size", "block_size").alias("group_size"), ((F.col("place") == 1) & best).alias("kept"), "text_sha256",
    )


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm,
    coalesce(length(text), 0) AS chars
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM rows
"""
