"""Removal of long repeated substrings with a distributed, sparse enhanced suffix array.

Suffixes are kept at anchors only: of every ``length``-byte window, the position of its smallest gram (a minimizer).  Equal
windows have their anchor at the same offset, so all occurrences of a repeat of at least ``length`` bytes meet among the
suffixes that begin with one anchor's gram.  A suffix is its context: the bytes right of the anchor, by which it is
sorted, and those left of it, which tell whether a repeat extends to the left.  Anchors whose gram stands at one place
in the whole corpus are dropped by narrow counts, and equal contexts become one class with a count before any text is
moved.  Each gram's classes form a slice of the suffix array; a stack scan over their common prefixes walks its interval
tree.  The members of an interval are ordered by what lies left of them, and a second scan tests their left extensions:
a set of members that neither all extend alike to the left nor all to the right is the group of a maximal repeat, and is
given with all its occurrences.  A slice that is too large for one task falls into parts by what pairs must share on
either side; members without a partner in a part go, small parts are scanned, and what stays large after a few rounds is
settled by its ``length``-byte strings, one count for each; see ``_split``.  Work and rows stay linear in the members.

Texts are told apart by 128 bits, contexts by 128 bits besides the 64 of their gram; inside a slice bytes are compared.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, flat_bytes, hash_partitions, materialize, sub_batches, table, write_once
from ._text import BYTE_VALUE, mix, powers

GRAM = 32
#: Members of one slice that a task scans (about 15 MB); larger slices are split first, in so many rounds.
SLICE, ROUNDS = 32_768, 3
_POSITION_BITS = np.uint64(24)
#: Bytes of text that are worked on at once, however long a text is.
_CHUNK = 1 << 18
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)
#: A second table of byte values: contexts are hashed by two independent functions.
_OTHER_VALUE = np.random.default_rng(20240518).integers(1, 1 << 63, 256, dtype=np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    with np.errstate(over="ignore"):
        while len(_INVERSES) < n:
            _INVERSES = np.concatenate((_INVERSES, _INVERSES * (_INVERSES[-1] * _INVERSE)))
    return _INVERSES[:n]


class _Hashes:
    """Polynomial hashes of any substring of ``raw`` from one prefix sum."""

    def __init__(self, raw: np.ndarray, values: np.ndarray = BYTE_VALUE):
        self._sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * powers(len(raw)), out=self._sum[1:])
        self._inverse = _inverses(len(raw) + 1)

    def grams(self, size: int) -> np.ndarray:
        n = len(self._sum) - size
        return mix((self._sum[size:] - self._sum[:n]) * self._inverse[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return mix(value ^ mix((end - start).astype(np.uint64)))


def _minimizers(hashes: _Hashes, first: int, owner_end: np.ndarray, length: int) -> np.ndarray:
    """Positions of the minimizers of the windows that start at ``first``, first + 1, ... and end within their text.

    ``owner_end`` has, for each of these windows, the end of its text.
    """
    mask = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    width, n = length - GRAM + 1, len(owner_end)
    least = hashes.grams(GRAM)[first : first + n + width - 1]
    least &= ~mask
    least |= np.arange(len(least), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    inside = owner_end - (first + np.arange(n)) >= length
    at = first + (least[:n] & mask).astype(np.int64)[inside]
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def chunk_anchors(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Chunk by chunk: (hashes, second bytes of the chunk, its start, text index and position of its anchors)."""
    last, n_starts = -1, len(raw) - length + 1
    for lo in range(0, max(n_starts, 0), _CHUNK):
        hi = min(lo + _CHUNK, n_starts)
        begin, stop = max(0, lo - length), min(len(raw), hi + 2 * length)
        data = raw[begin:stop]
        a, b = np.searchsorted(offsets, [lo, hi - 1], side="right") - 1
        bounds = np.clip(offsets[a : b + 2], lo, hi)
        owner_end = np.repeat(offsets[a + 1 : b + 2], np.diff(bounds)) - begin
        hashes = _Hashes(data)
        at = begin + _minimizers(hashes, lo - begin, owner_end, length)
        at = at[at > last]
        if len(at):
            last = int(at[-1])
            yield hashes, data, begin, np.searchsorted(offsets, at, side="right") - 1, at


def anchor_grams(texts: DataFrame, length: int) -> DataFrame:
    """gram (its hash) of every anchor of ``texts`` (t, u, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi in sub_batches(batch.column(0), _CHUNK):
                raw, offsets = flat_bytes(batch.column(0).slice(lo, hi - lo))
                for hashes, _, begin, _, at in chunk_anchors(raw, offsets, length):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.spans(at - begin, at - begin + GRAM).view("<i8"))], names=["gram"])

    return texts.select("text").mapInArrow(run, "gram long")


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """gram, c1 and c2 (hashes of the context and its extents), t, u, place (position, left and right extent)."""

    def run(batches):
        for batch in batches:
            for lo, hi in sub_batches(batch.column(2), _CHUNK):
                raw, offsets = flat_bytes(batch.column(2).slice(lo, hi - lo))
                names = [batch.column(k).to_numpy()[lo:hi] for k in range(2)]
                for hashes, data, begin, which, at in chunk_anchors(raw, offsets, length):
                    left = np.minimum(at - offsets[which], length - GRAM)
                    right = np.minimum(offsets[which + 1] - at, length)
                    start, end, extent = at - left - begin, at + right - begin, mix(left.astype(np.uint64))
                    c1 = mix(hashes.spans(start, end) ^ extent)
                    c2 = mix(_Hashes(data, _OTHER_VALUE).spans(start, end) ^ extent)
                    gram = hashes.spans(at - begin, at - begin + GRAM)
                    place = (at - offsets[which]) << 16 | left << 8 | right
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view("<i8")) for x in (gram, c1, c2)] + [pa.array(n[which]) for n in names] + [pa.array(place)], names=["gram", "c1", "c2", "t", "u", "place"]
                    )

    return texts.select("t", "u", "text").mapInArrow(run, "gram long, c1 long, c2 long, t long, u long, place long")


def _contexts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """gram, c1, c2, k, left (reversed: from the anchor outwards) and right, of every class in ``reps``."""
    asked = reps.groupBy("t", "u").agg(F.collect_list(F.struct("gram", "c1", "c2", "k", "place")).alias("asked"))
    names = ["gram", "c1", "c2", "k"]

    def run(batches):
        for batch in batches:
            for lo, hi in sub_batches(batch.column(0), _CHUNK):
                raw, offsets = flat_bytes(batch.column(0).slice(lo, hi - lo))
                asked = batch.column(1).slice(lo, hi - lo)
                rows = asked.flatten()
                owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
                place = rows.field("place").to_numpy()
                at = offsets[owner] + (place >> 16)
                left, right = place >> 8 & 255, place & 255
                data = raw.tobytes()
                for i in range(0, len(rows), 5_000):
                    cut = slice(i, i + 5_000)
                    lefts = [data[x:y][::-1] for x, y in zip((at[cut] - left[cut]).tolist(), at[cut].tolist(), strict=True)]
                    rights = [data[x:y] for x, y in zip(at[cut].tolist(), (at[cut] + right[cut]).tolist(), strict=True)]
                    part = rows.slice(i, 5_000)
                    yield pa.RecordBatch.from_arrays([part.field(k) for k in names] + [pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=[*names, "left", "right"])

    return texts.join(asked.hint("merge"), ["t", "u"]).select("text", "asked").mapInArrow(run, "gram long, c1 long, c2 long, k long, left binary, right binary")


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _intervals(prefix: list[int]):
    """Stack scan: (depth, first, last) of every interval of a sorted list whose neighbours share ``prefix``, inner ones first."""
    stack: list[tuple[int, int]] = []  # (depth, first member) of the open intervals
    for i, depth in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


class _Lefts:
    """Left contexts of one slice, ordered once: any members' order and what neighbours in it share."""

    #: From so many members on, neighbours' common prefixes come from range minima instead of comparisons.
    MANY = 64

    def __init__(self, lefts: list[bytes]):
        self._lefts, self._levels = lefts, None
        if len(lefts) >= self.MANY:
            order = sorted(range(len(lefts)), key=lefts.__getitem__)
            self._order = np.array(order)
            self._rank = np.empty(len(order), np.int64)
            self._rank[self._order] = np.arange(len(order))
            level = np.array([_common_prefix(lefts[x], lefts[y]) for x, y in zip(order, order[1:])], np.int16)
            self._levels = [level]
            while 1 << len(self._levels) < len(order):
                half = 1 << len(self._levels) - 1
                level = np.minimum(level[:-half], level[half:])
                self._levels.append(level)

    def ordered(self, first: int, last: int) -> tuple[list[int], list[int]]:
        if self._levels is None or last - first < self.MANY:
            members = sorted(range(first, last + 1), key=self._lefts.__getitem__)
            return members, [_common_prefix(self._lefts[x], self._lefts[y]) for x, y in zip(members, members[1:])]
        rank = np.sort(self._rank[first : last + 1])
        gap = np.diff(rank)
        shared, level = np.empty(len(gap), np.int16), np.frexp(gap)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            shared[at] = np.minimum(self._levels[k][rank[at]], self._levels[k][rank[at + 1] - (1 << k)])
        return self._order[rank].tolist(), shared.tolist()


def _extended(rights: list[bytes], lefts: list[bytes], length: int):
    """The first scan: (right, first, last, members by their left contexts, what neighbours share), where a repeat is long enough."""
    prefix, contexts = [_common_prefix(a, b) for a, b in zip(rights, rights[1:])], _Lefts(lefts)
    for right, first, last in _intervals(prefix):
        members, shared = contexts.ordered(first, last)
        if max(shared) + right >= length:
            yield right, first, members, shared, prefix[first:last]


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int):
    """Groups (members, left, right) of one slice's maximal repeats of at least ``length`` bytes around the anchor.

    ``rights`` are in order; ``lefts`` are reversed left contexts.  An interval of the first scan holds the members that
    share ``right`` bytes; among them, ordered by their left contexts, an interval of the second scan holds those that
    share ``left`` bytes and do not all extend alike (left diversity, which an interval has by its nature).  It is
    maximal to the right too if its members do not lie in one child of the first interval.
    """
    for right, first, members, shared, prefix in _extended(rights, lefts, length):
        child, of = 0, {first: 0}
        for j, depth in enumerate(prefix):
            child += depth == right
            of[first + j + 1] = child
        # how many members up to a place come from another child than their neighbour
        changes = [0]
        for x, y in zip(members, members[1:]):
            changes.append(changes[-1] + (of[x] != of[y]))
        for left, a, b in _intervals(shared):
            if left + right >= length and changes[b] > changes[a]:
                yield members[a : b + 1], left, right


def covered(rights: list[bytes], lefts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Of every member, how far left and right the groups of ``maximal_repeats`` reach that it is in (0, 0 if in none).

    All of a member's groups lie around its anchor, so together they cover one span.
    """
    left_reach, right_reach = np.zeros(len(rights), np.int64), np.zeros(len(rights), np.int64)
    for members, left, right in maximal_repeats(rights, lefts, length):
        left_reach[members] = np.maximum(left_reach[members], left)
        right_reach[members] = np.maximum(right_reach[members], right)
    return list(zip(left_reach.tolist(), right_reach.tolist(), strict=True))


_COVER = "gram long, c1 long, c2 long, left int, right int"


def _scan(slices: DataFrame, length: int, named: bool) -> DataFrame:
    """Of all slices (gram, s1, s2, c1, c2, left, right): the members of every group with its name, or what each member's groups cover."""
    ordered = slices.repartition(hash_partitions(slices.sparkSession), "gram", "s1", "s2").sortWithinPartitions("gram", "s1", "s2", "right", "left")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())[: 6 if named else 5]
    names = ["gram", "c1", "c2", "left", "right", "repeat"][: len(kinds)]

    def scan(gram, group):
        rights, lefts = [g[3] for g in group], [g[2] for g in group]
        if not named:
            yield from ((gram, *g[:2], left, right) for g, (left, right) in zip(group, covered(rights, lefts, length), strict=True) if right)
            return
        for members, left, right in maximal_repeats(rights, lefts, length):
            name = hashlib.blake2b(lefts[members[0]][:left][::-1] + rights[members[0]][:right] + left.to_bytes(2, "big"), digest_size=16).digest()
            yield from ((gram, *group[m][:2], left, right, name) for m in members)

    def groups(batches):
        group, last = [], None
        for batch in batches:
            for gram, s1, s2, c1, c2, left, right in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (gram, s1, s2) != last:
                    yield last, group
                    group, last = [], (gram, s1, s2)
                group.append((c1, c2, left, right))
        yield last, group

    def run(batches):
        rows = (row for name, group in groups(batches) if len(group) > 1 for row in scan(name[0], group))
        while part := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return ordered.select("gram", "s1", "s2", "c1", "c2", "left", "right").mapInArrow(run, _COVER + (", repeat binary" if named else ""))


def _split(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Slices of at most SLICE members for the scan, and the members of groups that are too large for it (or None).

    A pair that shares a ``length``-byte string around the anchor shares, for some offset, so many bytes to the left and
    the rest to the right.  A slice stands for a range of offsets: its members share at least the first of them to the
    left and what the last one leaves to the right.  A slice that is too large falls into two, one for each half of its
    offsets, whose members share more on one side or the other; a member without a partner there goes.  What is still
    too large after ROUNDS has its strings counted, offset by offset: equal ones are a group.
    """
    columns = ["gram", "s1", "s2", "c1", "c2", "left", "right"]
    sliced = contexts.withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    small = sliced.where(F.col("k") <= SLICE).select(*columns)
    large = sliced.where(F.col("k") > SLICE).select(*columns, F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    if large.isEmpty():
        return small, None
    key = ["gram", "s1", "s2"]

    def named(left, right):
        return [F.xxhash64(F.lit(seed), "gram", left, F.substring("left", F.lit(1), left), F.substring("right", F.lit(1), right)) for seed in (1, 2)]

    def partnered(rows, name, replaces=()):
        rows = materialize(rows, name, replaces)
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        return materialize(rows.join(sizes, key), name, [rows])

    def shared(rows, lo, hi):
        left, right = lo, length - hi
        s1, s2 = named(left, right)
        fits = rows.where((left <= F.octet_length("left")) & (right <= F.octet_length("right")))
        return fits.select("gram", s1.alias("s1"), s2.alias("s2"), "c1", "c2", "left", "right", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    lo, hi = F.col("lo"), F.col("hi")
    middle = F.floor((lo + hi) / 2).cast("int")
    steps = []
    for _ in range(ROUNDS):
        parts = partnered(shared(large.where("lo < hi"), lo, middle).union(shared(large.where("lo < hi"), middle + 1, hi)).union(large.where("lo = hi").select(*columns, "lo", "hi")), "parts")
        steps.append(parts)
        small = small.union(parts.where(F.col("k") <= SLICE).select(*columns))
        large = parts.where(F.col("k") > SLICE).select(*columns, "lo", "hi")
    offset = F.col("offset")
    windows = large.withColumn("offset", F.explode(F.sequence("lo", "hi"))).where((offset <= F.octet_length("left")) & (length - offset <= F.octet_length("right")))
    s1, s2 = named(offset, length - offset)
    found = partnered(windows.select("gram", s1.alias("s1"), s2.alias("s2"), "c1", "c2", offset.cast("int").alias("left"), (length - offset).cast("int").alias("right")), "windows")
    return small, found.select("gram", "c1", "c2", "left", "right", F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("s1", "s2")))).alias("repeat"))


class _Index:
    """The steps that the scan and its readers share: distinct texts, places of anchors, classes of equal contexts."""

    def __init__(self, once: DataFrame, length: int):
        self.length = length
        # joins are merge joins at every size: none of these sides is bounded
        again = materialize(anchor_grams(once, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
        self.places = materialize(anchors(once, length).join(again.hint("merge"), "gram", "left_semi"), "places", [again])
        least = F.min(F.struct("t", "u", "place"))
        classes = self.places.groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), least.alias("r")).select("gram", "c1", "c2", "n", "r.t", "r.u", "r.place")
        self.classes = materialize(classes, "classes")
        slices = materialize(self.classes.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "slices")
        self.contexts = materialize(_contexts(once, self.classes.join(slices.hint("merge"), "gram")), "contexts", [slices])

    def members(self, named: bool) -> DataFrame:
        """gram, c1, c2, left, right: the classes of every group and the repeat's extent around the anchor.

        With ``named`` each group has its name in ``repeat``; without, a class has what all groups of its slice that
        hold it cover.  A class that stands more than once is a group by itself: its whole context repeats.
        """
        small, found = _split(self.contexts, self.length)
        whole = self.classes.where("n > 1").select(
            "gram", "c1", "c2", F.shiftright("place", 8).bitwiseAND(255).cast("int").alias("left"), F.col("place").bitwiseAND(255).cast("int").alias("right"),
            F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("c1", "c2")))).alias("repeat"),
        )
        out = _scan(small, self.length, named)
        return reduce(DataFrame.union, (x.select(*out.columns) for x in (out, whole, found) if x is not None))


def _distinct_texts(docs: DataFrame, text: str) -> str:
    """Name of a new table of the distinct texts (t, u, text, copies), bucketed by their 128-bit name (t, u).

    Each distinct text is shuffled once; joins that need texts read the table without another exchange.
    """
    spark = docs.sparkSession
    name = f"rippleframe_texts_{uuid.uuid4().hex}"
    distinct = _named(docs, text).groupBy("t", "u").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    try:
        write_once(spark, lambda: distinct.write.option("compression", "zstd").bucketBy(hash_partitions(spark), "t", "u").sortBy("t", "u").saveAsTable(name))
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    return name


def _named(docs: DataFrame, text: str) -> DataFrame:
    value = F.coalesce(column(text), F.lit(""))
    return docs.select(value.alias("text")).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})


def repeat_groups(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """Every occurrence of every maximal repeat: repeat (its name), n_bytes, t and u (the text's name) and start.

    A repeat is named once for each anchor it is found around, and seen at most ``length`` bytes to the right and
    ``length`` - 32 to the left of it.  ``t`` and ``u`` are ``xxhash64(text)`` and ``xxhash64(1, text)``; an occurrence is
    given once for each distinct text.  Texts shorter than ``length``, null ones and an empty table have no repeat.
    """
    spark = docs.sparkSession
    name = _distinct_texts(docs, text)
    try:
        index = _Index(spark.table(name).select("t", "u", "text"), length)
        found = index.places.join(index.members(named=True).hint("merge"), ["gram", "c1", "c2"])
        position = F.shiftright("place", 16)
        return materialize(found.select("repeat", (F.col("left") + F.col("right")).alias("n_bytes"), "t", "u", (position - F.col("left")).alias("start")), "occurrences", [index.places, index.classes, index.contexts])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_spans(once: DataFrame, length: int = 200) -> DataFrame:
    """(t, u, spans): of every text of ``once`` (t, u, text; each text once) the spans that repeats of ``length`` cover.

    Spans are [start, end) in bytes and may overlap.  Texts that nothing covers have no row.
    """
    index = _Index(once, length)
    # all groups of a class lie around its anchor, so they cover one span
    cover = index.members(named=False).groupBy("gram", "c1", "c2").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    cover = materialize(cover, "cover", [index.classes, index.contexts])
    position = F.shiftright("place", 16)
    spans = index.places.join(cover.hint("merge"), ["gram", "c1", "c2"]).select("t", "u", (position - F.col("left")).alias("start"), (position + F.col("right")).alias("end"))
    return materialize(spans.groupBy("t", "u").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans", [index.places, cover])


def cut_repeats(docs: DataFrame, text: str = "text", length: int = 200, with_bytes: bool = True) -> DataFrame:
    """(t, u, n_bytes, n_removed, n_spans, kept_sha256, kept) of every distinct text, named by t and u (128 bits).

    A byte is removed when a ``length``-byte string that covers it also starts anywhere else in the input, in the same
    text or another row, judged on the input.  ``kept`` has the remaining bytes (binary; left out on request).  A null
    text is empty; texts shorter than ``length`` keep everything; rows with equal texts lose everything if they are long
    enough; an empty table gives no row; other columns are not used.  ``length`` is from 64 to 255.  However long a text
    is, beyond its own bytes and spans it takes memory for a chunk of it at a time.
    """
    spark = docs.sparkSession
    name = _distinct_texts(docs, text)

    def run(batches):
        for batch in batches:
            for lo, hi in sub_batches(batch.column(2), 4 << 20):
                part = batch.slice(lo, hi - lo)
                raw, offsets = flat_bytes(part.column(2))
                rows = [[], [], [], [], []]
                for i, copies in enumerate(part.column(4).to_pylist()):
                    whole = raw[offsets[i] : offsets[i + 1]]
                    spans = part.column(3)[i].values
                    if copies > 1 and len(whole) >= length:
                        start, end = np.array([0]), np.array([len(whole)])
                    elif spans is None:
                        start = end = np.zeros(0, np.int64)
                    else:
                        start, end = spans.field("start").to_numpy(), spans.field("end").to_numpy()
                        order = np.argsort(start, kind="stable")
                        start, end = start[order], np.maximum.accumulate(end[order])
                    first = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
                    start, end = start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)] if len(start) else end
                    left = b"".join(whole[a:b].tobytes() for a, b in zip([0, *end.tolist()], [*start.tolist(), len(whole)], strict=True))
                    for values, value in zip(rows, (len(whole), len(whole) - len(left), len(start), hashlib.sha256(left).hexdigest(), left), strict=True):
                        values.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)][: 5 if with_bytes else 4]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["t", "u", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 7 if with_bytes else 6])

    schema = "t long, u long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    try:
        once = spark.table(name)
        spans = repeated_spans(once.select("t", "u", "text"), length)
        joined = once.join(spans.hint("merge"), ["t", "u"], "left").select("t", "u", "text", "spans", "copies")
        return materialize(joined.mapInArrow(run, schema), "cut", [spans])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 200 bytes remove of every document; null texts are empty, repeated rows repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs, with_bytes=False)
    value = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(value).alias("t"), F.xxhash64(F.lit(1), value).alias("u")).join(cut, ["t", "u"], "left").drop("t", "u")
