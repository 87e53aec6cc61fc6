"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A copy of an m-character item with at most k edits keeps at least m - q + 1 - q k of the item's q-grams, and their
diagonals (text position less item position) span at most k + 1 values.  The scan counts, for every text and item, the
shared q-grams in diagonal bands of k + 1; two neighbouring bands overlap any span of that size, so a region whose two
bands together stay below the bound holds no copy.  Regions that meet it are verified by a banded alignment.

The benchmark goes to the executors in blocks of about ``BLOCK_CHARS`` characters, one pass over the documents each; a
pass is written before the next block is sent, so that one block at a time is held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, kept_columns, materialize, sub_batches, table
from ._text import mix, powers
from .repeats import _inverses

Q = 10
#: The length of q-grams for items that are too short for ``Q`` and their edit budget.
SHORT_Q = 5
EDIT_SHARE = 0.08
#: Pairs of a text's and an item's position that are held at once, and bands whose hits are counted at once.
PAIRS, BAND_COUNTS = 1 << 20, 1 << 22
#: Benchmark characters that are indexed at once.
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes)), out=total[1:])
    n = len(codes) - q + 1
    return mix((total[q:] - total[:n]) * _inverses(len(codes))[:n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class ItemIndex:
    """q-grams of a block of items: sorted, with the places (item, position) of each.

    Only items are taken that share at least one q-gram with every copy within their edit budget.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, edit_share: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = (edit_share * size).astype(np.int64)
        self.bound = size - q + 1 - q * self.budget
        #: A shift that keeps diagonals non-negative.
        self.shift = int(size.max()) if len(size) else 0
        gram = [_grams(_codes(t), q) for t in self.texts]
        count = np.array([len(g) for g in gram], np.int64)
        flat = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(gram)), count)
        position = np.concatenate([np.arange(c) for c in count]) if gram else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.position = item[order].astype(np.int32), position[order].astype(np.int32)
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.seen = np.zeros(1 << 21, bool)
        self.seen[self.grams >> np.uint64(43)] = True
        # how often an item has a gram: the runs of equal items in each gram's list
        gram_of = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        run = np.flatnonzero(np.concatenate(([True], (gram_of[1:] != gram_of[:-1]) | (self.item[1:] != self.item[:-1])))) if len(flat) else np.zeros(0, np.int64)
        self.run_item, self.run_size = self.item[run].astype(np.int64), np.diff(np.append(run, len(flat)))
        self.run_first = np.searchsorted(gram_of[run], np.arange(len(self.grams) + 1)) if len(run) else np.zeros(1, np.int64)

    @classmethod
    def build(cls, items: list[tuple[int, str]], q: int, edit_share: float) -> list[ItemIndex]:
        """An index of the items that ``q`` suits, and one of shorter q-grams for the others of at least SHORT_Q characters."""
        suits = lambda t, q: len(t) - q + 1 - q * int(edit_share * len(t)) >= 1
        items = [(i, normalise(t)) for i, t in items]
        lists = [[x for x in items if suits(x[1], q)], [x for x in items if not suits(x[1], q) and suits(x[1], SHORT_Q)]]
        return [cls(own, n, edit_share) for own, n in zip(lists, (q, SHORT_Q), strict=True) if own]

    @staticmethod
    def _expanded(first: np.ndarray, count: np.ndarray, size: int):
        """Pieces of at most ``size`` of: (which entry, place in its list) of all entries' lists, one after the other."""
        ends = np.cumsum(count)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, size):
            index = np.arange(lo, min(lo + size, int(ends[-1])))
            which = np.searchsorted(ends, index, side="right")
            yield which, first[which] + index - (ends[which] - count[which])

    def _likely(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The pairs (text * number of items + item) that share enough q-grams anywhere; nothing is paired by position."""
        n_grams = len(self.grams)
        both, times = np.unique(text * n_grams + place, return_counts=True)
        gram = both % n_grams
        kept: list[np.ndarray] = [np.zeros(0, np.int64)]
        # texts one by one, so a text's pairs are all in one count
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(both // n_grams) > 0, [True]))) if len(both) else []
        lo = 0
        while lo < len(cuts) - 1:
            hi = lo + 1
            weight = int((self.run_first[gram[cuts[lo] : cuts[hi]] + 1] - self.run_first[gram[cuts[lo] : cuts[hi]]]).sum())
            while hi < len(cuts) - 1 and weight < PAIRS:
                weight += int((self.run_first[gram[cuts[hi] : cuts[hi + 1]] + 1] - self.run_first[gram[cuts[hi] : cuts[hi + 1]]]).sum())
                hi += 1
            part = slice(cuts[lo], cuts[hi])
            total: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for which, run in self._expanded(self.run_first[gram[part]], self.run_first[gram[part] + 1] - self.run_first[gram[part]], PAIRS):
                pair = np.concatenate((total[0], both[part][which] // n_grams * len(self.ids) + self.run_item[run]))
                hits = np.concatenate((total[1], times[part][which] * self.run_size[run]))
                names, inverse = np.unique(pair, return_inverse=True)
                total = names, np.bincount(inverse, weights=hits, minlength=len(names)).astype(np.int64)
            kept.append(total[0][total[1] >= self.bound[total[0] % len(self.ids)]])
            lo = hi
        return np.concatenate(kept)

    def regions(self, codes: np.ndarray, offsets: np.ndarray):
        """(text, item, first diagonal) of all pairs of bands that meet the bound; diagonals count from the text's start.

        Positions are paired in pieces of PAIRS, and hits counted for so many pairs of a text and an item at once that
        their bands stay within BAND_COUNTS (one pair may exceed it: its bands grow with the text alone).
        """
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(43)]) if len(grams) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.grams, grams[at]), max(len(self.grams) - 1, 0))
        if not len(at):
            return
        same = self.grams[place] == grams[at]
        at, place = at[same], place[same]
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + self.q <= offsets[text + 1]
        at, place, text = at[inside], place[inside], text[inside]
        likely = np.sort(self._likely(text, place))
        n_items, size = len(self.ids), np.diff(offsets)
        bands = (size[likely // n_items] + self.shift) // (self.budget[likely % n_items] + 1) + 2
        group = np.concatenate(([0], np.cumsum(bands))) // BAND_COUNTS
        for g in np.unique(group[:-1]):
            own = likely[group[:-1] == g]
            base = np.concatenate(([0], np.cumsum(bands[group[:-1] == g])))
            hits = np.zeros(int(base[-1]), np.int64)
            there = np.isin(text, own // n_items)
            at_, place_, text_ = at[there], place[there], text[there]
            for which, index in self._expanded(self.first[place_], self.first[place_ + 1] - self.first[place_], PAIRS):
                item = self.item[index].astype(np.int64)
                pair = text_[which] * n_items + item
                slot = np.minimum(np.searchsorted(own, pair), len(own) - 1)
                keep = np.flatnonzero(own[slot] == pair)
                slot, item, t = slot[keep], item[keep], text_[which[keep]]
                band = (at_[which[keep]] - offsets[t] - self.position[index[keep]] + self.shift) // (self.budget[item] + 1)
                hits += np.bincount(base[slot] + band, minlength=len(hits))
            # two neighbouring bands of a pair; every pair has an empty last band
            both = hits.copy()
            both[:-1] += hits[1:]
            slot = np.repeat(np.arange(len(own)), np.diff(base))
            for k in np.flatnonzero((both >= self.bound[own[slot] % n_items]) & (hits > 0)).tolist():
                pair = int(own[slot[k]])
                yield pair // n_items, pair % n_items, (k - int(base[slot[k]])) * int(self.budget[pair % n_items] + 1) - self.shift


def align(item: str, text: str, first: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best copy of ``item`` in ``text`` on diagonals first .. first + 2 budget + 1, or None.

    Row by row over the item's characters; a cell stands for a diagonal, and moves off the band are not allowed.
    """
    width = 2 * (budget + 1)
    # copies may drift off the two bands by up to the budget before and after the hits that were counted
    lo, width = first - budget, width + 2 * budget
    exact = text.find(item, max(0, lo), max(0, lo) + len(item) + width)
    if exact >= 0:
        return exact, exact + len(item), 0
    m = len(item)
    infinite = m + width + 1
    codes = np.full(m + width + 1, -1, np.int64)
    a, b = max(lo, 0), min(lo + m + width, len(text))
    if b <= a:
        return None
    codes[a - lo : b - lo] = _codes(text[a:b])
    pattern = _codes(item).astype(np.int64)
    diagonal = np.arange(width)
    # a copy may begin on any diagonal: the row before the first character costs nothing inside the text
    diagonal = np.arange(width)
    cost = np.where((diagonal + lo >= 0) & (diagonal + lo <= len(text)), 0, infinite)
    end = int(_rows(cost, codes, pattern, len(text) - lo, budget)[0])
    if end < 0:
        return None
    # only for a copy that is there: the same rows again, each cell with the diagonal its alignment begins on
    _, edits, begin = _rows(cost, codes, pattern, len(text) - lo, budget, track=True)
    return begin + lo, end + lo + m, edits


def _rows(cost: np.ndarray, codes: np.ndarray, pattern: np.ndarray, room: int, budget: int, track: bool = False) -> tuple[int, int, int]:
    """(best last diagonal or -1, edits, its first diagonal if tracked); stops when every cell is above the budget."""
    width = len(cost)
    infinite = len(pattern) + width + 1
    diagonal = np.arange(width)
    begin = diagonal.copy()
    drop = np.full(width, infinite)
    for i in range(len(pattern)):
        best = cost + (codes[i : i + width] != pattern[i])  # keep or replace
        if room - i < width:
            best[max(room - i, 0) :] = infinite
        drop[:-1] = cost[1:]
        drop[:-1] += 1  # the item's character is missing: one diagonal back
        if track:
            source = np.where(drop < best, np.append(begin[1:], 0), begin)
        np.minimum(best, drop, out=best)
        # additional characters of the text: running minimum along the row
        best -= diagonal
        low = np.minimum.accumulate(best)
        if track:
            begin = source[np.maximum.accumulate(np.where(best == low, diagonal, 0))]
        low += diagonal
        cost = low
        if i % 8 == 7 and cost.min() > budget:
            return -1, 0, 0
    end = int(cost.argmin())
    edits = int(cost[end])
    return (end, edits, int(begin[end])) if edits <= budget else (-1, 0, 0)


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns ``keep`` of every row and ``matches``: array of (item_id, start, end, edits), one for each item found.

    A match is a stretch of the text (positions in the normalised text) within edit_share * length edits of a whole
    item, both lower-cased and with single spaces; of several copies of one item the best is given.  Null or empty
    texts match nothing; items that are null or shorter than ``SHORT_Q`` characters match nothing; an empty benchmark leaves
    every list empty; repeated rows give repeated results; an empty table gives no row; a column of ``keep`` that is
    called matches goes out as matches_input.  ``item_id`` must be a whole number.
    """
    spark = docs.sparkSession
    items = benchmark.select(column(item_id).cast("long").alias("i"), column(item_text).alias("t")).where("t is not null and i is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-total // block_chars))
    columns, names, schema = kept_columns(docs, keep, ["matches", "_text"])
    schema = f"{schema}, matches array<struct<item_id:bigint,start:int,end:int,edits:int>>".removeprefix(", ")
    source, held = docs.select(*columns, column(text).alias("_text")), None
    for block in range(n_blocks):
        last = block == n_blocks - 1
        chosen = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex.build(sorted((r["i"], r["t"]) for r in chosen.toLocalIterator()), q, edit_share))
        out = _scan(source, index, names, schema if last else f"{schema}, _text string", block > 0, last)
        if last:
            return out
        source = materialize(out, "scanned", [held] if held is not None else [])
        held = source
        index.unpersist()


def _scan(source: DataFrame, index, keep: list[str], schema: str, later: bool, last: bool) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        indexes = index.value
        for batch in batches:
            for lo, hi in sub_batches(batch.column(batch.num_columns - 1), 2_000_000):
                part = batch.slice(lo, hi - lo)
                values = part.column(part.num_columns - 1)
                matches = [list(x or ()) for x in part.column(len(keep)).to_pylist()] if later else [[] for _ in range(len(values))]
                texts = [normalise(t) for t in values.to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                codes = _codes("".join(texts))
                for items in indexes:
                    best: dict[tuple[int, int], tuple] = {}
                    for t, i, first in items.regions(codes, offsets):
                        known = best.get((t, i))
                        if known and known[2] == 0:
                            continue
                        found = align(items.texts[i], texts[t], first, int(items.budget[i]))
                        if found and (known is None or found[2] < known[2]):
                            best[t, i] = found
                    for (t, i), (start, end, edits) in sorted(best.items()):
                        matches[t].append({"item_id": items.ids[i], "start": start, "end": end, "edits": edits})
                columns = [*part.columns[: len(keep)], pa.array(matches, kind)]
                yield pa.RecordBatch.from_arrays(columns if last else [*columns, values], names=[*keep, "matches"] if last else [*keep, "matches", "_text"])

    return source.mapInArrow(run, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every document: whether it holds a benchmark item, which ones, and whether it is kept.

    Null and empty texts hold none and are kept; repeated rows repeat.
    """
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("matches", lambda m: m["item_id"])
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), (F.size("matches") == 0).alias("kept"), F.size("matches").cast("long").alias("n_items"), ids.alias("item_ids"))
