"""Near duplicates by ProbMinHash signatures, banding and verification.

A document is the multiset of its ``SHINGLE``-word shingles; a shingle's weight is its count. For every shingle a Poisson process with the weight as
rate sends arrivals to random registers; a register keeps the shingle of its earliest arrival, and a shingle stops once its next arrival
is later than all registers. Two registers agree with probability equal to the probability Jaccard similarity. Documents with equal shingles
are one text; texts that share a band of registers and at least ``FLOOR`` of all registers are compared exactly, and those at ``THRESHOLD`` or more are linked. Classes are the
connected components.

Within a band's bucket up to ``ALL_PAIRS`` texts are all paired. A larger bucket works in rounds: some of its texts, taken from outside the
class that is largest in the bucket, meet every text of the bucket that is not yet in their class; links found merge classes before the next
round. It is done when all texts outside its largest class have had their turn, so two texts of a bucket either share a class or have been
compared: no link is lost. Buckets with the same largest class share their leaders and members, so that a text is shipped once for all bands in
which it meets that class. Leaders and members meet as tiles of bounded size, in which whole shingle sets are compared; a tile returns only the
links that join classes it still saw apart, so neither copies nor texts that are merely alike become one row per pair.

Defined results: a null text counts as empty; a text of 1 to ``SHINGLE`` words has all its words as its one shingle, and all texts without words are
equal; words are white-space separated and compared in lower case; rows that repeat a doc_id and text are one member; rows without a doc_id
are classes of their own and always stay; other columns are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.columns import apart
from fieldcal.llm.components import components
from fieldcal.llm.words import ranges, release, slices, texts_of, words_of
from fieldcal.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
BANDS = 32
ALL_PAIRS = 48
SEED = 0x5EED
#: leaders of a large bucket in the first round; each further round takes ``GROWTH`` times as many
LEADERS, GROWTH = 32, 16
#: a tile has about so many leaders and members at most, or so many bytes of shingles of each (or a single longer text)
TILE, TILE_BYTES = 512, 4 << 20
#: text whose shingles a task holds at a time; a word takes about a dozen 8-byte numbers meanwhile
SLICE = 1 << 20
#: a pair with fewer equal registers than this share is not compared exactly; with 128 registers a pair at 0.8 falls below it with probability
#: 8e-8, of the order of the 5e-8 with which it shares no band
FLOOR = 0.6


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their counts, text by text: text number (ascending), shingle hash (ascending within a text), count."""
    index, distinct, bounds = words_of(pc.utf8_lower(texts))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), SEED) for w in distinct), np.uint64, len(distinct))
    words = hashes[index]
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = ranges(bounds[:-1], count)
    value = np.zeros(len(at), np.uint64)
    ends = bounds[1:][doc]
    for k in range(size):
        here = at + k
        held = np.zeros(len(at), np.uint64)
        inside = here < ends
        held[inside] = words[here[inside]]
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + held + np.uint64(k + 1))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(first)
    return doc[starts], value[starts], np.diff(np.append(starts, len(doc)))


def signatures(n: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of ``n`` documents (all ones for one without shingles).

    A register holds the arrival time (as the bits of a 32-bit float, which sort like the time) before 32 bits of the shingle's hash.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(n * registers, none)
    active = np.arange(len(doc))
    state = value.copy()
    time = np.zeros(len(doc))
    while len(active):
        state[active] = mix(state[active] + np.uint64(0x9E3779B97F4A7C15))
        drawn = state[active]
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        time[active] -= np.log(uniform) / weight[active]
        register = (mix(drawn) % np.uint64(registers)).astype(np.int64)
        key = (time[active].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (value[active] >> np.uint64(32))
        np.minimum.at(table, doc[active] * registers + register, key)
        last = table.reshape(n, registers).max(axis=1)
        # the next arrival is later still, so a shingle that is past all registers of its document is done
        active = active[key <= last[doc[active]]]
    return table.reshape(n, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted elements)."""
    if not len(a) and not len(b):
        return 1.0
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    total = 0.0
    for ratio in np.unique(y / x):
        # scaled so that the two weights of an element with this ratio agree
        base = np.maximum(x, y / ratio).sum() + only_a + only_b / ratio
        total += x[y / x == ratio].sum() / base
    return float(total)


def _sign(bands: int):
    def run(batches):
        release()
        for batch in slices(batches, limit=SLICE):
            n = batch.num_rows
            doc, value, weight = shingles(texts_of(batch))
            table = signatures(n, doc, value, weight) if len(doc) else np.full((n, REGISTERS), np.uint64(0xFFFFFFFFFFFFFFFF))
            keys = np.ascontiguousarray(table.astype(np.uint32)).reshape(n, bands, -1)
            starts = np.searchsorted(doc, np.arange(n + 1))
            content, band = [], []
            for i in range(n):
                a, b = starts[i], starts[i + 1]
                content.append(xxhash.xxh3_128_digest(value[a:b].tobytes() + weight[a:b].astype("<i8").tobytes()))
                # a text without words has no band: all such texts are equal already
                band.append([xxhash.xxh3_64_intdigest(keys[i, k].tobytes(), k) - 2**63 for k in range(bands)] if b > a else [])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "content": pa.array(content, pa.binary()),
                "bands": pa.array(band, pa.list_(pa.int64())), "registers": pa.array([row.tobytes() for row in table.astype("<u4")], pa.binary()),
            })
    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "text_a", SLICE):
                # a leader's text comes many times
                both = pa.concat_arrays([texts_of(part, "text_a"), texts_of(part, "text_b")]).dictionary_encode()
                doc, value, weight = shingles(both.dictionary)
                at = np.searchsorted(doc, np.arange(len(both.dictionary) + 1))
                sets = [(value[i:j], weight[i:j]) for i, j in zip(at, at[1:])]
                index = both.indices.to_numpy().reshape(2, -1)
                like = [probability_jaccard(*sets[x], *sets[y]) for x, y in zip(*index)]
                found = pa.record_batch({"a": part.column("a"), "b": part.column("b"), "similarity": pa.array(like, pa.float64())})
                yield found.filter(pa.array([x >= threshold - 1e-12 for x in like], pa.bool_()))
    return run


def _alike(batches):
    """Pairs whose registers agree often enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= FLOOR, pa.bool_()))


def _linked(pairs: DataFrame, signed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs at the threshold or above. ``signed`` and ``texts`` have one row per node."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(signed.select(F.col("doc_id").alias(end), F.col("registers").alias(name)), end)
    pairs = pairs.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}")), end)
    rows = pairs.select("a", "b", "text_a", "text_b")
    return cut_lineage(rows.mapInArrow(_verify(threshold), "a long, b long, similarity double"))


def _sets(batches):
    """Shingles of each text as 64-bit numbers in ascending order, each as often as it occurs."""
    release()
    for batch in slices(batches, limit=SLICE):
        doc, value, weight = shingles(texts_of(batch))
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield pa.record_batch({
            "rep": batch.column("rep"),
            "shingles": pa.array([np.repeat(value[i:j], weight[i:j]).astype("<u8").tobytes() for i, j in zip(at, at[1:])], pa.binary()),
        })


def tile_links(lead: np.ndarray, rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, float]]:
    """Links (a < b, similarity) between leaders and the other rows that join labels; after them, no leader has a text at the threshold
    under another label."""
    if not len(sets):
        return []
    size = np.array([len(x) for x in sets])
    distinct, element = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
    runs = np.flatnonzero(first)
    weight = np.diff(np.append(runs, len(row))).astype(float)
    row, element = row[runs], element[runs]
    starts = np.searchsorted(row, np.arange(len(sets) + 1))
    label, found, own = label.copy(), [], np.zeros(len(distinct))
    for k in np.flatnonzero(lead):
        mine = slice(starts[k], starts[k + 1])
        others = np.flatnonzero(~lead & (label != label[k]) & (size > 0))
        if not len(others) or not size[k]:
            continue
        own[element[mine]] = weight[mine]
        length = np.diff(starts)[others]
        at = ranges(starts[others], length)
        here, theirs = own[element[at]], weight[at]
        cuts = np.cumsum(length) - length
        common = np.add.reduceat(np.minimum(here, theirs), cuts)
        like = common / (size[k] + size[others] - common)
        # with unequal counts of common shingles: at most the overlap of the shares, and exactly only where that is enough
        uneven = np.add.reduceat(((here > 0) & (here != theirs)).astype(float), cuts) > 0
        most = np.add.reduceat(np.minimum(here / size[k], theirs / np.repeat(size[others], length)), cuts)
        own[element[mine]] = 0
        for i in np.flatnonzero(np.where(uneven, most, like) >= threshold - 1e-12):
            j = others[i]
            if label[j] == label[k]:
                continue
            other = slice(starts[j], starts[j + 1])
            exact = probability_jaccard(element[mine], weight[mine], element[other], weight[other]) if uneven[i] else float(like[i])
            if exact >= threshold - 1e-12:
                found.append((int(min(rep[k], rep[j])), int(max(rep[k], rep[j])), exact))
                label[label == label[j]] = label[k]
    return found


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lead, rep, label = (table.column(c).to_numpy() for c in ("lead", "rep", "class_id"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        found = tile_links(lead, rep, label, sets, threshold) if lead.any() else []
        a, b, like = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(like, pa.float64())})
    return run


def _placed(entries: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return entries.withColumn("class_id", F.col("rep"))
    return entries.join(classes, "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))


def _large_links(large: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Links and classes of buckets with many texts (band, rep)."""
    wanted = large.select("rep").distinct()
    sets = cut_lineage(texts.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "text").mapInArrow(_sets, "rep long, shingles binary"))
    large = cut_lineage(large.join(sets.groupBy("rep").agg(F.sum(F.length("shingles")).alias("bytes")), "rep"))
    links = classes = asked = None
    take = LEADERS
    while True:
        placed = cut_lineage(_placed(large, classes))
        main = placed.groupBy("band", "class_id").agg(F.count("*").alias("n")).groupBy("band").agg(
            F.max_by("class_id", F.struct("n", -F.col("class_id"))).alias("main"), F.count("*").alias("classes"))
        # a bucket of one class is done
        placed = cut_lineage(placed.join(main.where("classes > 1").select("band", "main"), "band"))
        waiting = placed.where("class_id != main").select("band", "main", "rep", "bytes")
        if asked is not None:
            waiting = waiting.join(asked, ["band", "rep"], "left_anti")
        waiting = cut_lineage(waiting)
        turns = cut_lineage(waiting.select("main", "rep", "bytes").distinct().groupBy("main").agg(
            F.count("*").alias("waiting"), F.sum("bytes").alias("waiting_bytes")))
        if turns.isEmpty():
            return links, classes
        # a bucket without waiting texts is done for good, as classes only merge
        placed = cut_lineage(placed.join(waiting.select("band").distinct(), "band", "left_semi"))
        large = placed.select("band", "rep", "bytes")
        # buckets with the same largest class meet as one region, so a text of many of them is shipped once
        inside = cut_lineage(placed.select("main", "rep", "bytes", "class_id").distinct())
        whole = inside.groupBy("main").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"))
        # a share of the waiting by hash: no order within a region is needed, and regions choose the same texts
        share = F.least(F.lit(1.0), F.lit(take) / F.col("waiting"))
        drawn = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
        leaders = cut_lineage(waiting.join(turns, "main").where(drawn < share).select("band", "main", "rep"))
        tiles = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES, F.lit(1.0))).cast("int")
        at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sized = inside.join(turns.join(whole, "main"), "main").select(
            "main", "rep", "class_id", tiles(F.col("n"), F.col("all_bytes")).alias("rows"),
            tiles(share * F.col("waiting"), share * F.col("waiting_bytes")).alias("columns"))
        members = sized.select("main", "rep", "class_id", F.lit(False).alias("lead"), at(1, "rows").alias("row"), every("columns").alias("column"))
        led = sized.join(leaders.select("main", "rep").distinct(), ["main", "rep"]).select(
            "main", "rep", "class_id", F.lit(True).alias("lead"), at(2, "columns").alias("column"), every("rows").alias("row"))
        fresh = cut_lineage(members.unionByName(led).join(sets, "rep").groupBy("main", "row", "column").applyInArrow(
            _meet(threshold), "a long, b long, similarity double"))
        links = fresh if links is None else links.unionByName(fresh)
        classes = _merged(classes, fresh)
        leaders = leaders.select("band", "rep")
        asked = leaders if asked is None else asked.unionByName(leaders)
        take *= GROWTH


def _merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """rep, class_id (smallest rep) of all reps with a link, after the links (a, b) joined the classes found so far."""
    if classes is None:
        return components(links).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = classes.select(F.col("rep").alias(end), "class_id")
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("class_id", end)).drop("class_id")
    # the new links run between classes, so this graph is much smaller than the first
    roots = cut_lineage(components(ends))
    reps = classes.unionByName(links.select(F.explode(F.array("a", "b")).alias("rep")).join(classes, "rep", "left_anti").distinct().select(
        "rep", F.col("rep").alias("class_id")))
    merged = reps.join(roots, F.col("class_id") == F.col("node"), "left")
    return cut_lineage(merged.select("rep", F.coalesce("root", "class_id").alias("class_id")))


def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, rep: the smallest doc_id with the same shingles), links that formed the classes (a < b: reps, similarity), and the
    class of each linked rep (rep, class_id)."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut_lineage(rows.mapInArrow(_sign(bands), "doc_id long, content binary, bands array<long>, registers binary"))
    reps = signed.groupBy("content").agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(signed.join(reps, "content").select("doc_id", "rep", "bands"))
    entries = members.where("doc_id = rep").select(F.col("rep"), F.explode("bands").alias("band")).distinct()
    sizes = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut_lineage(entries.join(sizes, "band"))
    small = buckets.where(F.col("n") <= ALL_PAIRS).select("band", "rep")
    first = small.alias("x").join(small.alias("y"), "band").where("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    large = buckets.where(F.col("n") > ALL_PAIRS).select("band", "rep")
    links, classes = (None, None) if large.isEmpty() else _large_links(large, rows, threshold)
    if classes is not None:
        for end in ("a", "b"):
            first = first.join(classes.select(F.col("rep").alias(end), F.col("class_id").alias(f"class_{end}")), end, "left")
        first = first.where("coalesce(class_a, a) != coalesce(class_b, b)").select("a", "b")
    fresh = _linked(cut_lineage(first.distinct()), signed, rows, threshold)
    links, classes = fresh if links is None else links.unionByName(fresh), _merged(classes, fresh)
    return members.select("doc_id", "rep").distinct(), links, classes


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per doc_id: doc_id, class_id (smallest doc_id of its class), rep, n_links (links of its rep among those that formed the
    classes; inside a class that was known already no further ones are looked for)."""
    members, links, classes = near_links(docs, threshold)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degrees = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    # smallest member ids are reps, so a class's smallest rep is its smallest doc_id
    info = members.select("rep").distinct().join(classes, "rep", "left").join(degrees, "rep", "left").select(
        F.col("rep"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(info, "rep").select("doc_id", "class_id", "rep", "n_links")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class; rows without an id stay."""
    classes = near_classes(docs, threshold)
    dropped = cut_lineage(classes.groupBy("doc_id").agg(F.min("class_id").alias("__class")).where("doc_id != __class").select(
        F.col("doc_id").alias("__id")))
    return apart(docs, lambda rows: rows.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti"))
