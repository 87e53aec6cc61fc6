"""Near-duplicate documents by banded MinHash, odd sketches and confirmation on full shingle sets.

A document's set are its distinct word shingles.  Equal sets form classes, of which only one representative goes on.
Its MinHash samples give band keys, and are folded into an odd sketch: a parity bitmap in which every sample flips one
bit.  The population count of two sketches' XOR estimates their similarity, most precisely where it is high, and
decides which banded candidates are worth fetching; those are confirmed on the full sets.  Candidates come in rounds:

1. every member of a bucket with the bucket's smallest member;
2. in buckets whose members are not connected yet, stars around the members with most likely partners;
3. in buckets that are still open, every pair of members of different components that the sketches do not rule out is
   checked where the members meet, so that only links leave the task.

Only the last round decides what is linked, so no pair that could join two components is left out; the first two keep it
small, and copies are never paired with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, flat_bytes, hash_partitions, materialize, sub_batches, table
from ._components import components
from ._text import distinct, intersection_sizes, mix, shingles, word_hashes

BANDS, ROWS = 40, 4
#: Samples that the sketch folds; the first BANDS * ROWS of them also make the bands.
SAMPLES = 480
SKETCH_BITS = 1024
#: Members of a bucket, and shingles of its members, that are compared in one piece; larger buckets are compared as
#: pairs of such blocks, each in a task of its own.
BLOCK, BLOCK_SHINGLES = 4096, 1_000_000
#: Bytes of text whose shingles are made at once (some 50 bytes of memory for each); one text may exceed it.
TEXT_BYTES = 500_000

_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def sketch_limit(similarity: float, deviations: float = 5.0) -> int:
    """The largest XOR population count that a pair of at least this similarity shows, but for a chance of about 1e-7.

    Two sets of similarity s differ in about 2 k (1 - s) of 2 k samples, and m differing samples leave
    n / 2 (1 - (1 - 2 / n) ** m) odd bits of n.  The spread of both steps is added ``deviations`` times.
    """
    differing = 2 * SAMPLES * (1 - similarity) + deviations * 2 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    odd = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)
    return math.ceil(odd + 0.25 * deviations * math.sqrt(odd))


def text_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*word_hashes(raw, offsets), width))


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, the text's hash and the text; a row is told by the first two, so an id may stand on several texts."""
    return docs.select(column(doc_id).cast("long").alias("_id"), F.xxhash64(column(text)).alias("_hash"), column(text).alias("_text"))


def signatures(named: DataFrame, width: int) -> DataFrame:
    """Of every row: _id, _hash, n_shingles, the set's 128-bit fingerprint (f1, f2), band keys and odd sketch (both null if empty)."""

    def run(batches):
        for batch in batches:
            for lo, hi in sub_batches(batch.column(2), TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                values, bounds = text_sets(*flat_bytes(part.column(2)), width)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                starts = bounds[:-1][full]
                fingerprint = np.zeros((2, len(size)), np.uint64)
                least = np.zeros((len(full), SAMPLES), np.uint64)
                if len(full):
                    for k in range(2):
                        fingerprint[k, full] = np.add.reduceat(mix(values ^ _SALTS[k]), starts)
                    for j in range(SAMPLES):
                        least[:, j] = np.minimum.reduceat(values * _FACTORS[j], starts)
                samples = mix(least ^ _SALTS)
                keys = mix((samples[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64) ^ _SALTS[:BANDS])
                bit = np.arange(len(full))[:, None] * SKETCH_BITS + (samples % np.uint64(SKETCH_BITS)).astype(np.int64)
                parity = (np.bincount(bit.ravel(), minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(parity).view("<i8").reshape(len(full), SKETCH_BITS // 64)
                present = size > 0
                ends = np.concatenate(([0], np.cumsum(present)))

                def lists(rows, present=present, ends=ends):
                    return pa.ListArray.from_arrays(pa.array((ends * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel().view("<i8")), mask=pa.array(~present))

                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.array(fingerprint[0].view("<i8")), pa.array(fingerprint[1].view("<i8")), lists(keys), lists(sketch)],
                    names=["_id", "_hash", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return named.mapInArrow(run, "_id long, _hash long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _sketch_passes(similarity: float):
    """Whether the sketches and sizes of sides a and b allow the similarity."""
    odd = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (odd <= sketch_limit(similarity)) & (F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b"))


def _texts(named: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): the text of each class in ``nodes``, that of its representative row."""
    wanted = classes.select("node", "_id", "_hash").join(nodes, "node", "left_semi")
    # a representative's id and text may stand on several rows: one of them is enough; neither side is bounded
    return named.join(wanted.hint("merge"), ["_id", "_hash"]).select("node", F.col("_text").alias("text")).dropDuplicates(["node"])


def confirm(pairs: DataFrame, named: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets have 100 * intersection >= percent * union."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = materialize(_texts(named, classes, nodes), "texts")
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            both = pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3)))
            size = np.cumsum(both.to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 2 * TEXT_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                sets = [text_sets(*flat_bytes(part.column(k)), width) for k in (2, 3)]
                shared = intersection_sizes(*sets[0], *sets[1])
                union = np.diff(sets[0][1]) + np.diff(sets[1][1]) - shared
                part = part.select([0, 1]).filter(pa.array(100 * shared >= percent * union))
                if len(part):
                    yield part
                lo = hi

    links = materialize(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links", [texts, pairs])
    return links


def _stars(node, inverse, likely):
    """Pairs that connect the likely partners of a bucket: pivot by pivot, each with one member of every other component."""
    label = inverse.copy()
    while True:
        likely &= label[:, None] != label[None, :]
        partners = likely.sum(axis=1)
        pivot = int(partners.argmax())
        if not partners[pivot]:
            return
        j = np.flatnonzero(likely[pivot])
        j = j[np.unique(label[j], return_index=True)[1]]
        yield np.maximum(node[j], node[pivot]), np.minimum(node[j], node[pivot])
        label[np.isin(label, label[j])] = label[pivot]


def _dealt(members: DataFrame, blocks) -> DataFrame:
    """Rows of every bucket dealt to pairs of blocks: all members of block lo and of block hi meet under (key, lo, hi)."""
    rows = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "size", "mass")
    return rows.repartition(hash_partitions(members.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")


def _groups(batches, columns: int):
    """(key, columns) of every (key, lo, hi); the first three columns are the name, lists become arrays of rows."""
    group, name = [], None
    for batch in batches:
        ids = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]))
        values = []
        for k in range(3, columns):
            column = batch.column(k)
            if pa.types.is_list(column.type):
                values.append(column.flatten().to_numpy().reshape(len(ids), -1))
            else:
                values.append(column.to_numpy(zero_copy_only=False))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(ids[lo]) != name:
                if group:
                    yield name[0], [np.concatenate(c) for c in zip(*group, strict=True)]
                group, name = [], tuple(ids[lo])
            group.append([v[lo:hi] for v in values])
    if group:
        yield name[0], [np.concatenate(c) for c in zip(*group, strict=True)]


def _pair_batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _allowed(i, j, n, sketch, similarity, limit):
    j = j[np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i])]
    return j[np.bitwise_count((sketch[j] ^ sketch[i]).view(np.uint64)).sum(axis=1) <= limit] if len(j) else j


def _likely_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Second round: pairs (a, b) that connect the likely partners of each bucket."""
    dealt = _dealt(members, F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")).select("key", "lo", "hi", "block", "node", "comp", "n", "sketch")
    limit = sketch_limit(similarity, 0.5)

    def run(batches):
        for _, (block, node, comp, n, sketch) in _groups(batches, 8):
            _, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
            likely = np.zeros((len(node), len(node)), bool)
            # pairs within the largest component are never needed, so its members are only met from outside
            for i in np.flatnonzero(inverse != count.argmax()):
                j = np.flatnonzero((inverse != inverse[i]) & ((block != block[i]) | (block.min() == block.max())))
                j = _allowed(i, j, n, sketch, similarity, limit)
                likely[i, j] = likely[j, i] = True
            for a, b in _stars(node, inverse, likely):
                yield _pair_batch(a, b)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _remaining_links(members: DataFrame, similarity: float, width: int, percent: int) -> DataFrame:
    """Last round: the confirmed links between different components of each bucket.

    Every pair that the sketches do not rule out is checked on the full sets, once, in the first bucket that both share;
    pairs that links of the same task have already connected are passed over.  ``members`` has the texts.
    """
    dealt = _dealt(members, F.ceil(F.col("mass") / F.lit(BLOCK_SHINGLES)).cast("int")).select("key", "lo", "hi", "block", "node", "comp", "n", "sketch", "bands", "text")
    limit = sketch_limit(similarity)

    def run(batches):
        for key, (block, node, comp, n, sketch, bands, text) in _groups(batches, 10):
            _, label, count = np.unique(comp, return_inverse=True, return_counts=True)
            main, across, order = count.argmax(), block.min() != block.max(), np.arange(len(node))
            first = label.copy()
            sets: dict[int, np.ndarray] = {}

            def members_sets(wanted, sets=sets, text=text):
                new = [k for k in wanted if k not in sets]
                for at in range(0, len(new), 64):
                    part = new[at : at + 64]
                    values, bounds = text_sets(*flat_bytes(pa.array([text[k] for k in part], pa.large_string())), width)
                    sets.update((k, values[bounds[x] : bounds[x + 1]]) for x, k in enumerate(part))
                return [sets[k] for k in wanted]

            for i in np.flatnonzero(first != main):
                other = (label != label[i]) & ((first == main) | (order > i))
                if across:
                    other &= block != block[i]
                j = _allowed(i, np.flatnonzero(other), n, sketch, similarity, limit)
                if len(j):
                    j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == key]
                for at in range(0, len(j), 1024):
                    part = j[at : at + 1024]
                    part = part[label[part] != label[i]]
                    if not len(part):
                        continue
                    own, others = members_sets([i])[0], members_sets(part.tolist())
                    size = np.array([len(x) for x in others])
                    values = np.concatenate(others)
                    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    shared = np.add.reduceat((own[place] == values).astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))
                    linked = part[100 * shared >= percent * (size + len(own) - shared)]
                    if len(linked):
                        yield _pair_batch(node[linked], np.full(len(linked), node[i]))
                        label[np.isin(label, label[linked])] = label[i]

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """Of every row: _id, _hash, n_shingles, node (its component; null for rows that are linked with nothing), least (the
    component's smallest id) and n_links (of its class)."""
    similarity = percent / 100
    named = _named(docs, text, doc_id)
    found = materialize(signatures(named, width), "signatures")
    usable = found.where(F.col("_id").isNotNull() & (F.col("n_shingles") > 0))
    # a class is named by a number of its own: the smallest id may stand on several texts
    facts = (F.min(F.struct("_id", "_hash")).alias("r"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    grouped = usable.groupBy("f1", "f2").agg(*facts)
    classes = materialize(grouped.select("f1", "f2", F.monotonically_increasing_id().alias("node"), F.col("r._id").alias("_id"), F.col("r._hash").alias("_hash"), F.col("n_shingles").alias("n"), "bands", "sketch"), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass")).where("size > 1")
    members = materialize(banded.drop("n").join(buckets, "key"), "members")

    def sketched(pairs, side):
        facts = classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        return pairs.join(facts, side)

    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    stars = sketched(sketched(stars, "a"), "b").where(_sketch_passes(similarity)).select("a", "b")
    links = confirm(materialize(stars, "candidates"), named, classes, width, percent)
    comps = components(links)
    for last in (False, True):
        placed = members.join(comps.select("node", F.col("component").alias("comp")), "node", "left")
        placed = materialize(placed.withColumn("comp", F.coalesce("comp", "node")), "placed", [members] if last else [])
        still = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
        opened = placed.join(still, "key", "left_semi").join(classes.select("node", "n", "sketch", "bands"), "node").select("key", "size", "mass", "node", "comp", "n", "sketch", "bands")
        if not last:
            more = confirm(materialize(_likely_pairs(opened, similarity), "candidates", [placed]), named, classes, width, percent)
        else:
            opened = materialize(opened, "opened", [placed])
            texts = _texts(named, classes, opened.select("node").distinct())
            more = materialize(_remaining_links(opened.join(texts, "node"), similarity, width, percent), "links", [opened])
        if not more.isEmpty():
            comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), [comps])
            links = links.union(more)
    links = links.distinct()
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))

    of_class = classes.select("f1", "f2", "node", "_id").join(comps, "node", "left").join(degree, "node", "left")
    of_class = materialize(of_class.select("f1", "f2", "_id", F.coalesce("component", "node").alias("node"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named", [classes, comps])
    least = of_class.groupBy("node").agg(F.min("_id").alias("least"))
    of_class = of_class.join(least, "node").select("f1", "f2", "node", "least", "n_links")
    usable = F.when(F.col("_id").isNotNull() & (F.col("n_shingles") > 0), F.lit(True))
    rows = found.select("_id", "_hash", "n_shingles", F.when(usable, F.col("f1")).alias("f1"), F.when(usable, F.col("f2")).alias("f2"))
    return rows.join(of_class, ["f1", "f2"], "left").drop("f1", "f2")


def link_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id, n_links and kept.

    Rows are linked when 100 * intersection >= ``percent`` * union of their sets; ``component_id`` is the smallest id
    that can be reached, ``kept`` whether it is the row's own.  ``n_links`` counts the links of the
    row's class that were confirmed on the way.
    A null or empty text, or one without words, has an empty set and is linked with nothing; a row with a null id too
    (its component is null and it is kept); repeated rows fall in one class; rows that share an id but not a text are
    linked by their texts alone; an empty table gives no row.  Other columns of ``docs`` are not used.  ``doc_id`` must
    be a whole number.
    """
    kind = docs.schema[doc_id].dataType
    rows = _linked(docs, text, doc_id, width, percent)
    component = F.coalesce("least", "_id")
    return rows.select(F.col("_id").cast(kind).alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, one of every component: that with the smallest id (of several texts with it, that with the
    smallest hash; of equal rows, one).  Rows without words or without an id stay; of those, equal texts with one id once.
    """
    names = docs.columns
    linked = _linked(docs, text, doc_id, width, percent).where("_id is not null")
    grouped = linked.where("node is not null").groupBy("node").agg(F.min(F.struct("_id", "_hash")).alias("r")).select("r._id", "r._hash")
    chosen = materialize(grouped.union(linked.where("node is null").select("_id", "_hash")).distinct(), "chosen")
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, of = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = rows.where(F.col(own).isNotNull()).withColumns({"_id": F.col(own).cast("long"), "_hash": F.xxhash64(of)})
    one = keyed.join(chosen, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
    return one.union(rows.where(F.col(own).isNull())).toDF(*names)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document; empty and null texts are linked with nothing, repeated rows repeat."""
    return link_near_duplicates(table(spark, sf_dir, "documents"))
