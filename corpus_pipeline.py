"""The corpus pipeline: quality, line dedup, near dedup, mixing, packing.

Each stage gets what its predecessor kept, with the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers

from fieldcal.llm import cutting_stock, fair_queue, line_chunks, probminhash, site_quality
from fieldcal.session import cut_lineage, ship_package


def quality(spark, docs, sf_dir):
    """Documents judged unfit go."""
    ship_package(spark)
    return site_quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """Repeated chunks of lines are taken out of the texts; documents stay."""
    ship_package(spark)
    return line_chunks.remove_repeated_chunks(docs).drop("line_spans")


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates stays."""
    ship_package(spark)
    return probminhash.drop_near_duplicates(docs)


def mix(spark, docs, sf_dir):
    """Sources are mixed to their target weights; a document is repeated as often as the queue takes it."""
    ship_package(spark)
    return fair_queue.mix_sources(docs)


def pack(spark, docs, sf_dir):
    """Documents are cut and packed into sequences."""
    ship_package(spark)
    return cutting_stock.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
#: SQL cannot express the fitted classifier, the signatures and the linear program
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
