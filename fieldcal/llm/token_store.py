"""Token-ID store: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Texts are encoded once into a temporary table, and tokens are counted over the whole corpus. Then every id is replaced by its rank
by frequency (most frequent first) and written with 1 to 4 bytes; two bits of a control byte tell the size, four ids to a control byte.
A store is a folder with ``ranks`` (rank, token), ``shards`` (shard, base: ids in all shards before it) and ``rows``, range-sorted by
doc_id: shard, place, doc_id, start (ids before it in the shard), n_tokens, control, data. Decoding looks the sizes up in a table
of 256 control bytes.

Defined results: a null text counts as empty and holds the end id only; a null doc_id sorts first; rows that repeat a doc_id are stored
one after the other; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcal.llm.words import encoder, ranges, slices, texts_of
from fieldcal.session import cut_lineage, scratch_path

END_ID = 1
#: bytes of ids packed or unpacked at a time
BATCH_BYTES = 2 << 20
#: sizes in bytes of the four ids of a control byte
SIZES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack_all(ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes with their bounds and data bytes with theirs, of documents whose ranks lie one after the other."""
    ranks, n = ranks.astype("<u4"), np.diff(bounds)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    ends = np.concatenate([[0], np.cumsum(-(-n // 4))])
    padded = np.zeros((int(ends[-1]), 4), np.uint8)
    padded.reshape(-1)[ranges(4 * ends[:-1], n)] = code
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control, ends, ranks.view(np.uint8).reshape(-1, 4)[used], np.concatenate([[0], np.cumsum(code + np.int64(1))])[bounds]


def unpack_all(control: np.ndarray, ends: np.ndarray, data: np.ndarray, data_ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of documents one after the other."""
    sizes = SIZES[control].reshape(-1)[ranges(4 * ends[:-1], n)]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if not np.array_equal(upto[np.concatenate([[0], np.cumsum(n)])], data_ends):
        raise ValueError("data bytes do not match the control bytes")
    starts = upto[:-1]
    ranks = data[starts].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(sizes > k)
        ranks[some] |= data[starts[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    control, _, data, _ = pack_all(ranks, np.array([0, len(ranks)]))
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of one document."""
    one = lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return unpack_all(*one(control), *one(data), np.array([n]))


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the bounds of its values."""
    blobs = blobs.cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _blobs(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])


def _stored_ids(blobs: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all rows; a row has two bytes an id, or four."""
    raw, bounds = _flat(blobs)
    wide = np.diff(bounds) != 2 * n
    if wide.any() and not wide.all():
        return np.concatenate([raw[a:b].view("<u4" if w else "<u2") for a, b, w in zip(bounds[:-1], bounds[1:], wide)])
    return raw.view("<u4" if wide.any() else "<u2")


def _encode(path: str, end_id: int):
    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in slices(batches):
            ids, bounds = encoder(path).encode(texts_of(batch))
            seen = np.bincount(ids, minlength=end_id + 1)
            seen[end_id] += batch.num_rows
            if len(seen) > len(counts):
                counts = np.pad(counts, (0, len(seen) - len(counts)))
            counts[: len(seen)] += seen
            ended, ends = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            # two bytes are enough for most vocabularies; the width is told by the length
            ended = ended.astype("<u4" if ended.max(initial=0) > 0xFFFF else "<u2")
            blobs = _blobs(ended, ends * ended.itemsize)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()),
                "ids": blobs, "token": pa.nulls(len(blobs), pa.int64()), "n": pa.nulls(len(blobs), pa.int64()),
            })
        token = np.flatnonzero(counts)
        yield pa.record_batch({
            "doc_id": pa.nulls(len(token), pa.int64()), "n_tokens": pa.nulls(len(token), pa.int64()),
            "ids": pa.nulls(len(token), pa.binary()), "token": pa.array(token, pa.int64()), "n": pa.array(counts[token], pa.int64()),
        })
    return run


def _recode(ranks):
    def run(batches):
        shard, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "ids", BATCH_BYTES):
            n = batch.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            packed = pack_all(ranks.value[_stored_ids(batch.column("ids"), n)], np.concatenate([[0], ends]))
            control, data = _blobs(*packed[:2]), _blobs(*packed[2:])
            yield pa.record_batch({
                "shard": pa.array(np.full(len(n), shard, np.int32)), "place": pa.array(np.arange(place, place + len(n))),
                "doc_id": batch.column("doc_id"), "start": pa.array(start + ends - n), "n_tokens": batch.column("n_tokens"),
                "control": control, "data": data,
            })
            place += len(n)
            start += int(ends[-1]) if len(n) else 0
    return run


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` into a store and return its folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    encoded = cut_lineage(docs.select("doc_id", "text").mapInArrow(
        _encode(tokenizer, end_id), "doc_id long, n_tokens long, ids binary, token long, n long"))
    # one row per token of the vocabulary
    counted = encoded.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").collect()
    tokens = np.array([r["token"] for r in counted], np.int64)
    rank_of = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.uint32)
    rank_of[tokens] = np.arange(len(tokens), dtype=np.uint32)
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(tokens)], "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)
    ordered = encoded.where("token is null").select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    rows = ordered.mapInArrow(
        _recode(ranks), "shard int, place long, doc_id long, start long, n_tokens long, control binary, data binary")
    rows.write.option("compression", "zstd").parquet(f"{path}/rows")
    totals = spark.read.parquet(f"{path}/rows").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")
    return path


def read_store(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int; left out with ``digest_only``), ids_crc32, in files of ascending doc_id."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # one row per token of the vocabulary
    token_of = np.zeros(len(ranks), np.uint32)
    token_of[[r["rank"] for r in ranks]] = [r["token"] for r in ranks]
    tokens = spark.sparkContext.broadcast(token_of)

    def decode(batches):
        for batch in slices(batches, "data", BATCH_BYTES):
            n = batch.column("n_tokens").to_numpy()
            ids = tokens.value[unpack_all(*_flat(batch.column("control")), *_flat(batch.column("data")), n)].astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(n)])
            out = {
                "doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64()),
            }
            if not digest_only:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.record_batch(out)

    shards = spark.read.parquet(f"{path}/shards")  # one row per shard
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    return rows.select("doc_id", "start", "n_tokens", "control", "data").mapInArrow(decode, schema)
