"""Line dedup by content-defined chunks of lines.

A chunk goes from a line that holds words to the next such line, with the blank lines between them; one begins at every line with words, so
chunks overlap and every boundary depends on content only. Chunks are grouped by hash and bytes; a hash whose members all hold the same bytes, in
more than one place, is a repeated chunk. The first place (smallest doc_id, then line) of a chunk is not removed on its account, all other
places are. A run of lines that starts and ends with words, holds at least two such lines and was met in an earlier place is the union of its
chunks, each met in an earlier place; so what goes is exactly the union of all repeated runs of two lines or more. Every line that goes still
stands in an earlier place: going from a place to the first place of its chunk leads to a line that stays.

Defined results: a null text stays null; an empty text has one empty line and is not changed; a null doc_id sorts last; rows that repeat
both doc_id and text count as one document and are treated alike; a document that loses lines and has only white space left loses that too
and keeps its row with an empty text.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.columns import apart
from fieldcal.llm.words import slices, texts_of
from fieldcal.session import cut_lineage


def chunks_of(text: str) -> list[tuple[int, int, str]]:
    """(first line, number of lines, content) of the chunks that may be removed."""
    lines = text.split("\n")
    worded = [i for i, line in enumerate(lines) if line.strip()]
    return [(a, b - a + 1, "\n".join(lines[a : b + 1])) for a, b in zip(worded, worded[1:])]


def _emit(with_body: bool):
    def run(batches):
        for batch in slices(batches):
            rows, at, n, body = [], [], [], []
            for i, text in enumerate(texts_of(batch).to_pylist()):
                for first, size, content in chunks_of(text):
                    rows.append(i)
                    at.append(first)
                    n.append(size)
                    body.append(content)
            keys = pa.array(rows, pa.int64())
            out = {
                "doc_id": batch.column("doc_id").cast(pa.int64()).take(keys), "twin": batch.column("twin").take(keys),
                "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()),
                "digest": pa.array([xxhash.xxh3_128_digest(x.encode()) for x in body], pa.binary()),
            }
            if with_body:
                out["body"] = pa.array(body, pa.string())
            yield pa.record_batch(out)
    return run


def _runs(batches):
    """The chunks of a document joined to runs of lines."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            found = sorted((s["at"], s["at"] + s["n"]) for s in spans)
            runs = [list(found[0])]
            for at, end in found[1:]:
                if at <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([at, end])
            out.append([{"at": at, "n": end - at} for at, end in runs])
        spans = pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "twin": batch.column("twin"), "spans": spans})


def removed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, twin (hash of the text), spans (array of first line and number of lines, ascending and apart) of the documents that lose lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")
    schema = "doc_id long, twin long, at int, n int, digest binary"
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "twin", "at")
    bodies = rows.mapInArrow(_emit(True), schema + ", body string").groupBy("digest", "body").agg(
        F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = bodies.groupBy("digest").agg(F.count("*").alias("contents"), F.min("first").alias("first"), F.max("last").alias("last"))
    repeated = cut_lineage(repeated.where("contents = 1 and first != last").select("digest", "first"))
    members = rows.mapInArrow(_emit(False), schema)
    later = members.join(repeated, "digest").where(~place.eqNullSafe(F.col("first")))
    # a row that repeats another row repeats its spans
    spans = later.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    return spans.mapInArrow(_runs, "doc_id long, twin long, spans array<struct<at:int,n:int>>")


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated chunks, with ``line_spans`` (removed runs of lines, null where nothing was removed), which takes the
    place of a given column of that name."""
    return apart(docs, _without_repeated)


def _without_repeated(docs: DataFrame) -> DataFrame:
    spans = removed_chunks(docs).select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin"), F.col("spans").alias("line_spans"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__twin"))
    joined = docs.join(spans, match, "left").drop("__id", "__twin")
    lines = F.split("text", "\n", -1)
    # what stays is before, between and after the runs
    starts = F.concat(F.array(F.lit(0)), F.transform("line_spans", lambda s: s["at"] + s["n"]))
    ends = F.concat(F.transform("line_spans", lambda s: s["at"]), F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"]))), "\n")
    joined = joined.withColumn("__kept", F.when(F.col("line_spans").isNotNull(), kept))
    blank = F.col("__kept").isNotNull() & ~F.col("__kept").rlike(r"\S")
    every = F.array(F.struct(F.lit(0).alias("at"), F.size(lines).alias("n")))
    return joined.withColumn("line_spans", F.when(blank, every).otherwise(F.col("line_spans"))).withColumn(
        "text", F.when(blank, F.lit("")).otherwise(F.coalesce("__kept", "text"))).drop("__kept")


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines), n_spans, kept_sha256."""
    rows = remove_repeated_chunks(docs.select("doc_id", "text"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    gone = F.coalesce(F.aggregate("line_spans", F.lit(0), lambda n, s: n + s["n"]), F.lit(0))
    left = F.when(F.col("text") == "", F.when(gone > 0, 0).otherwise(1)).otherwise(lines)
    return rows.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(left + gone).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"),
        F.coalesce(F.size("line_spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
