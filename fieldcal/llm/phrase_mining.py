"""Phrase collocations by set-oriented mining over sorted occurrence relations.

Occurrences of length k are a relation of (block, place, phrase), in order of place; a block is some texts of one language, read
together, in which every word has a place, and a gap of one place parts pieces. Length 1 are the frequent words. Length k + 1 comes
from merge-joining length k with itself one place further, which gives the last word. The groups (phrase, last word) are counted within
the block, then over all blocks; infrequent groups fall away, and the others are semi-joined to the blocks before the next length is
extended.

Blocks are stored once, in buckets, and never shuffled: a block gets one bit for each group that it sent and the numbers of the frequent
ones, of all lengths so far, and builds the relation from them again. Groups travel by shard of their hash, as one row of packed arrays
for each block and shard; the shards of a language grow with its occurrences of that length, so a task counts a bounded share of the
groups, and a frequent group is one entry a block.

Frequent words and phrases get dense numbers below 2^31, so a group is one 64-bit integer, exactly. Scores take the counts of both
parts of each cut, which are frequent if the whole is; products are decimals.

Defined results: a null text has no words; a null language is ``und``; every row counts, repeated or not, and ids are not looked at; a
language without candidates has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.llm.words import listed, slices, texts_of
from fieldcal.session import cut_lineage, scratch_path

LEAST = 30
LONGEST = 4
COVER = 80
TOP = 2000
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 21
CHUNK_BITS = 12
UNKNOWN = "und"
#: groups of a block in one shard of its language's shards, ascending; keys are words or pairs
GROUPS = "block long, lang string, shard int, shards int, keys binary, counts binary"
#: frequent groups of a shard: all of them with their counts where block is null, else which of the groups of a block they are, and their numbers
COUNTED = "block long, lang string, shard int, shards int, size long, total long, keys binary, counts binary, flags binary, numbers binary"


def _table() -> np.ndarray:
    """Bytes as the splitter sees them: 32 between words, 10 between pieces, A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9] = 32
    table[[10, 11, 12, 13, *b".,;:!?"]] = 10
    return table


TABLE = _table()


def squeeze(raw: bytes) -> bytes:
    """``raw`` by zstd, if that is shorter: shuffles compress without entropy coding, which leaves most of a byte plane as it is."""
    small = pa.compress(raw, codec="zstd", asbytes=True) if raw else raw
    return b"\1" + len(raw).to_bytes(8, "little") + small if len(small) + 8 < len(raw) else b"\0" + raw


def expand(raw: bytes) -> bytes:
    return pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), codec="zstd", asbytes=True) if raw[0] else raw[1:]


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as byte planes, ascending ones as differences: high bytes are then mostly zeros, which compress to nothing."""
    values = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    width = values.dtype.itemsize
    return squeeze(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(expand(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if ascending else values


def pack_pairs(pairs: np.ndarray) -> bytes:
    """Ascending pairs: differences of the first parts, and of the last ones where the first is the same."""
    first, last = pairs >> 32, pairs & 0xFFFFFFFF
    step = np.diff(first, prepend=0)
    return pack(np.concatenate([step, np.where(step == 0, np.diff(last, prepend=0), last)]))


def unpack_pairs(raw: bytes) -> np.ndarray:
    step, rest = unpack(raw, np.int64).reshape(2, -1)
    upto = np.cumsum(rest)
    starts = np.flatnonzero(step != 0)
    before = np.zeros(len(step), np.int64)
    before[starts] = np.diff((upto - rest)[starts], prepend=0)
    return (np.cumsum(step) << 32) | (upto - np.cumsum(before))


def words_and_places(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Index into the distinct words of every word, the distinct words in ascending order, and the place of every word."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    raw = np.insert(TABLE[data], offsets - offsets[0], 10)  # a gap before, between and after the texts
    parts = raw == 10
    gap = parts | (raw == 32)
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    if len(first) == 0:
        return np.zeros(0, np.int32), [], np.zeros(0, np.int32)
    seen = np.cumsum(parts, dtype=np.int32)[first]
    places = np.arange(len(first), dtype=np.int32) + np.cumsum(np.diff(seen, prepend=seen[:1]) > 0, dtype=np.int32)
    # words and the gaps between them by turns
    bounds = np.column_stack([first, last]).reshape(-1)
    spans = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    encoded = spans.take(pa.array(np.arange(0, len(spans), 2))).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return rank[encoded.indices.to_numpy(zero_copy_only=False)], listed(encoded.dictionary.take(order)), places


def _read(batches):
    """Blocks of one language: distinct words with their counts, and the sorted relation of all words."""
    base, number = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, limit=BLOCK_BYTES):
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            index, words, places = words_and_places(texts_of(batch.filter(pc.equal(langs, lang))))
            counts = np.bincount(index, minlength=len(words)).astype(np.int64)
            yield pa.record_batch({
                "block": pa.array([base + number], pa.int64()), "lang": pa.array([lang], pa.string()), "n": pa.array([len(index)], pa.int64()),
                "distinct": pa.array([b"\n".join(words)], pa.binary()), "counts": pa.array([pack(counts)], pa.binary()),
                "places": pa.array([pack(places, True)], pa.binary()), "words": pa.array([pack(index)], pa.binary()),
            })
            number += 1


def _by_shard(shard: np.ndarray):
    """Every shard that a block has groups in, and which ones."""
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]))


def _word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards


def _pair_shards(pairs: np.ndarray, shards: int) -> np.ndarray:
    """Pairs of one first part with near last ones stay together: they differ little, however many shards there are."""
    return ((pairs >> CHUNK_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % shards


def _batch(rows: list[dict], like: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in map(str.split, like.split(", "))]))


def _word_groups(batches):
    for batch in batches:
        for row in batch.to_pylist():
            words = row["distinct"].split(b"\n") if row["distinct"] else []
            counts = unpack(row["counts"], np.int64)
            rows = [{
                "block": row["block"], "lang": row["lang"], "shard": shard, "shards": row["shards"],
                "keys": squeeze(b"\n".join([words[i] for i in at])), "counts": pack(counts[at]),
            } for shard, at in _by_shard(_word_shards(words, row["shards"]))]
            yield _batch(rows, GROUPS)


def _numbers(shard: np.ndarray, frequent: list[dict]) -> np.ndarray:
    """Global numbers of the groups of a block, -1 for those that are not frequent."""
    numbers = np.full(len(shard), -1, np.int32)
    own = dict(_by_shard(shard))
    for row in frequent:
        at = own[row["shard"]]
        flags = np.unpackbits(np.frombuffer(expand(row["flags"]), np.uint8), count=len(at))
        numbers[at[flags == 1]] = unpack(row["numbers"], np.int32, True) + row["base"]
    return numbers


def merge_join(places: np.ndarray, phrases: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences that another one follows a place further, with the last word of that one: places and groups."""
    follows = np.flatnonzero(np.diff(places) == 1)
    return places[follows], (phrases[follows].astype(np.int64) << 32) | last[follows + 1]


def longer(row: dict, lists: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and groups of the next length in a block, from its words and its frequent groups of every length so far."""
    words = row["distinct"].split(b"\n") if row["distinct"] else []
    number = _numbers(_word_shards(words, lists[0][0]["shards"]), lists[0])
    phrases, places = number[unpack(row["words"], np.int32)], unpack(row["places"], np.int32, True)
    kept = phrases >= 0
    places, phrases = places[kept], phrases[kept]
    places, pairs = merge_join(places, phrases, phrases)
    for frequent in lists[1:]:
        groups, which = np.unique(pairs, return_inverse=True)
        phrases = _numbers(_pair_shards(groups, frequent[0]["shards"]), frequent)[which]
        kept = phrases >= 0
        places, pairs = merge_join(places[kept], phrases[kept], (pairs[kept] & 0xFFFFFFFF).astype(np.int32))
    return places, pairs


def _pair_groups(k: int):
    """Groups of length k + 1 of a block, by the shards of its language."""
    def run(key, blocks: pa.Table, frequent: pa.Table) -> pa.Table:
        lists, out = [[] for _ in range(k)], []
        for item in frequent.to_pylist():
            lists[item["length"] - 1].append(item)
        # a block without frequent groups of some length has no longer ones
        for row in blocks.to_pylist() if all(lists) else []:
            pairs, counts = np.unique(longer(row, lists)[1], return_counts=True)
            shards = lists[-1][0]["next"]
            out += [{
                "block": row["block"], "lang": row["lang"], "shard": shard, "shards": shards, "keys": pack_pairs(pairs[at]), "counts": pack(counts[at].astype(np.int64)),
            } for shard, at in _by_shard(_pair_shards(pairs, shards))]
        return pa.Table.from_batches([_batch(out, GROUPS)])
    return run


def _count(least: int, worded: bool):
    """Total of every group of a shard; the frequent ones by number, and which of the groups of each block they are."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if worded:
            lists = [expand(r["keys"]).split(b"\n") for r in rows]
            sizes = [len(x) for x in lists]
            encoded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
            order = pc.sort_indices(encoded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            keys, which = listed(encoded.dictionary.take(order)), rank[encoded.indices.to_numpy(zero_copy_only=False)]
        else:
            lists = [unpack_pairs(r["keys"]) for r in rows]
            sizes = [len(x) for x in lists]
            keys, which = np.unique(np.concatenate(lists), return_inverse=True)
        del lists
        counts = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, which, counts)
        frequent = np.flatnonzero(totals >= least)
        number = np.full(len(keys), -1, np.int32)
        number[frequent] = np.arange(len(frequent), dtype=np.int32)
        same = {name: rows[0][name] for name in ("lang", "shard", "shards")}
        out = [same | {
            "size": len(frequent), "total": int(totals[frequent].sum()), "counts": pack(totals[frequent]),
            "keys": squeeze(b"\n".join([keys[i] for i in frequent])) if worded else pack_pairs(keys[frequent]),
        }] if len(frequent) else []
        for row, end, size in zip(rows, np.cumsum(sizes), sizes):
            numbers = number[which[end - size : end]]
            kept = numbers >= 0
            if kept.any():
                out.append(same | {"block": row["block"], "flags": squeeze(np.packbits(kept).tobytes()), "numbers": pack(numbers[kept], True)})
        return pa.Table.from_batches([_batch(out, COUNTED)])
    return run


def shards_of(words) -> Column:
    """Shards of a language for so many occurrences."""
    return F.greatest(F.lit(1), F.ceil(words / SHARD_WORDS)).cast("int")


def counted(groups: DataFrame, least: int, worded: bool = False) -> DataFrame:
    """Frequent groups of every shard, stored, with ``base``: what to add to the numbers of the shard, and ``next``: shards of the next length."""
    found = cut_lineage(groups.groupBy("lang", "shard").applyInArrow(_count(least, worded), COUNTED))
    heads = found.where("block is null").select("lang", "shard", "size", "total")
    placed = cut_lineage(heads.repartitionByRange("lang", "shard").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("part").agg(F.sum("size").alias("total"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(
        placed.withColumn("upto", F.sum("size").over(within))
        .join(parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")), "part")
        .join(heads.groupBy("lang").agg(shards_of(F.sum("total")).alias("next")), "lang")
        .select("lang", "shard", "next", (F.col("before") + F.col("upto") - F.col("size")).alias("base")))
    return found.join(bases, ["lang", "shard"])


def _words(batches):
    for batch in batches:
        for row in batch.to_pylist():
            words = expand(row["keys"]).decode().split("\n")
            yield pa.record_batch({
                "lang": pa.array([row["lang"]] * len(words), pa.string()), "id": pa.array(row["base"] + np.arange(len(words))),
                "word": pa.array(words, pa.string()), "a": pa.array(unpack(row["counts"], np.int64)),
            })


def _pairs(batches):
    for batch in batches:
        for row in batch.to_pylist():
            pairs = unpack_pairs(row["keys"])
            yield pa.record_batch({
                "id": pa.array(row["base"] + np.arange(len(pairs))), "first": pa.array(pairs >> 32), "last": pa.array(pairs & 0xFFFFFFFF),
                "a": pa.array(unpack(row["counts"], np.int64)),
            })


@contextmanager
def by_block(df: DataFrame):
    """``df`` stored in buckets of its blocks: what is sent to the blocks goes to where they lie. The table leaves the catalog at the end, its
    files stay in the shared folder."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Words of each language (lang, n), and its frequent phrases of up to ``longest`` words (lang, words, a)."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    with by_block(rows.mapInArrow(_read, "block long, lang string, n long, distinct binary, counts binary, places binary, words binary")) as read:
        totals = cut_lineage(read.groupBy("lang").agg(F.sum("n").alias("n")))
        sized = read.select("block", "lang", "distinct", "counts").join(totals.select("lang", shards_of(F.col("n")).alias("shards")), "lang")
        groups = counted(sized.mapInArrow(_word_groups, GROUPS), least, worded=True)
        vocabulary = cut_lineage(groups.where("block is null").select("lang", "base", "keys", "counts").mapInArrow(_words, "lang string, id long, word string, a long"))
        blocks = read.select("block", "lang", "distinct", "words", "places").groupBy("block")
        sent = None
        shorter = vocabulary.select("lang", F.array("word").alias("words"), "id", "a")
        found = shorter.select("lang", "words", "a")
        for k in range(1, longest):
            lists = groups.where("block is not null").select("block", F.lit(k).alias("length"), "shard", "shards", "next", "base", "flags", "numbers")
            sent = lists if sent is None else sent.unionByName(lists)
            groups = counted(blocks.cogroup(sent.groupBy("block")).applyInArrow(_pair_groups(k), GROUPS), least)
            pairs = groups.where("block is null").select("base", "keys", "counts").mapInArrow(_pairs, "id long, first long, last long, a long")
            heads = shorter.select(F.col("id").alias("first"), "lang", F.col("words").alias("head"))
            tails = vocabulary.select(F.col("id").alias("last"), "word")
            shorter = cut_lineage(pairs.join(heads, "first").join(tails, "last").select("lang", F.concat("head", F.array("word")).alias("words"), "id", "a"))
            found = found.unionByName(shorter.select("lang", "words", "a"))
    return totals, found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """The contract's rows: lang, rank, phrase, a, l, r, n, score."""
    totals, counts = mine(docs, least, longest)
    size = F.size("words")
    candidates = counts.where(size > 1)
    # every cut, with the counts of its parts
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("words").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    # whole numbers of up to 27 digits; the quotient is at most 1,000,000
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div cast(l + r as decimal(20, 0))")
    weighed = cuts.withColumn("score", score.cast("long"))
    lowest = weighed.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer candidate may cover every shorter one within it
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))
    inside = candidates.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(parts).alias("words"))
    covered = inside.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covered, ["lang", "words"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    phrases = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # ranked within slices of a language first, so no task sorts a whole language
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    first = phrases.withColumn("place", F.row_number().over(sliced)).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS m FROM worded))),
counts AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY ALL),
kept AS (
  SELECT b.* FROM lowest b LEFT JOIN covered c ON b.lang = c.lang AND b.phrase = c.phrase
  WHERE c.longer IS NULL OR 100 * c.longer::HUGEINT < 80 * b.a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""
