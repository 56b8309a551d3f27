"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers

from fieldcal.llm import bpe_transducer, content_sort, cutting_stock, fair_queue, language_model, learned_partitions, line_chunks, merkle_manifest, phrase_mining, probminhash, site_quality, suffix_dedup, token_store

def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark, sf_dir):
    path = token_store.write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, path, digest_only=True)


def op2_learned_partitions(spark, sf_dir):
    return learned_partitions.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")


def op3_maxent_lm(spark, sf_dir):
    return language_model.score_documents(documents(spark, sf_dir))


def op4_line_chunks(spark, sf_dir):
    return line_chunks.line_dedup(documents(spark, sf_dir))


def op5_site_quality(spark, sf_dir):
    return site_quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_probminhash(spark, sf_dir):
    return probminhash.near_classes(documents(spark, sf_dir))


def op8_weighted_fair_queue(spark, sf_dir):
    return fair_queue.mixed(documents(spark, sf_dir))


def op9_content_sort(spark, sf_dir):
    return content_sort.content_sort(documents(spark, sf_dir))


def op10_cutting_stock(spark, sf_dir):
    return cutting_stock.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.manifest(documents(spark, sf_dir))


def op12_bpe_transducer(spark, sf_dir):
    return bpe_transducer.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_phrase_mining(spark, sf_dir):
    return phrase_mining.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_line_chunks": op4_line_chunks,
    "op5_site_quality": op5_site_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_probminhash": op7_probminhash,
    "op8_weighted_fair_queue": op8_weighted_fair_queue,
    "op9_content_sort": op9_content_sort,
    "op10_cutting_stock": op10_cutting_stock,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_phrase_mining": op13_phrase_mining,
}
ORACLES = {
    "op8_weighted_fair_queue": fair_queue.ORACLE,
    "op9_content_sort": content_sort.ORACLE,
    "op13_phrase_mining": phrase_mining.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
