"""Phrase collocations by pivot partitioning.

Words have one order for each language, from frequent to rare; a phrase belongs to its rarest word, its *pivot*.  A map
pass rewrites every piece of text into fragments, one for each pivot in it: the words near the pivot's occurrences, cut
where a rarer word stands.  Equal fragments of a batch become one with a weight.  Fragments are routed to their pivot,
where the phrases that contain it are counted locally; every phrase is counted by one pivot alone, so what is not
frequent there never leaves its task.  Pivots with many fragments are dealt to several tasks by fragment, and their
phrases' partial counts are added up afterwards.

The order comes from exact counts in a fixed number of bins of word hashes: an array of known size, whatever the corpus.
A bin is an upper bound of its words' counts, so a word of a bin below the threshold is infrequent and cuts fragments.
Bins only decide which task counts a phrase; words themselves are compared as strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import column, flat_bytes, hash_partitions, materialize, sub_batches, table
from ._text import BYTE_VALUE, mix, powers

#: Bins of word hashes (8 bytes each): what every task gets.
BINS = 1 << 18
#: Characters of text that one map step rewrites at once; a piece without a break in it may exceed them.
TEXT_CHARS = 500_000
#: Bytes of fragments that are counted at once.
MINE_BYTES = 2_000_000
#: A pivot that may have more than this part of an average task's words is dealt to several tasks.
HOT_SHARE = 1.0
#: Phrases of one pivot whose counts wait for the pivot's end; beyond that they go out as parts and are added up later.
HELD = 400_000
#: Words of a phrase at most, occurrences of a candidate, per cent at which a longer phrase replaces it, rows of a language.
MAX_WORDS, MIN_COUNT, COVERED, TOP = 4, 30, 80, 2000

_BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in _BREAKS]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _word_values(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit value of every word (non-empty byte ranges)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    value = BYTE_VALUE[raw[np.repeat(start, size) + within]] * powers(int(size.max()))[within]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def _lang_values(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8")) for x in langs], np.uint64)


def _ranges(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """The byte ranges of ``raw`` as strings."""
    ends = np.cumsum(size)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[index].tobytes()))


class _Words:
    """Words of many texts, a space after each, with their values and pieces."""

    def __init__(self, texts: pa.Array, lang_value: np.ndarray):
        raw, offsets = flat_bytes(texts)
        inside = ~_GAP[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        border = offsets[(offsets > 0) & (offsets < len(raw))]
        begins[border] = inside[border]
        ends[border - 1] = inside[border - 1]
        start = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - start
        self.text = np.searchsorted(offsets, start, side="right") - 1
        #: Words are of one piece if neither a break nor a text's end stands between them.
        self.piece = np.cumsum(_BREAK[raw])[start] + self.text if len(start) else np.zeros(0, np.int64)
        placed = np.cumsum(self.size + 1)
        self.start = placed - self.size - 1
        self.raw = np.full(int(placed[-1]) if len(placed) else 0, 32, np.uint8)
        letters = np.repeat(start, self.size) + np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.raw[np.arange(len(letters)) + np.repeat(np.arange(len(start)), self.size)] = _FOLD[raw[letters]]
        self.value = mix(_word_values(self.raw, self.start, self.size) ^ lang_value[self.text])


def _cut(text: str) -> list[str]:
    """A text in parts of about TEXT_CHARS, cut behind breaks only."""
    parts, at = [], 0
    while len(text) - at > TEXT_CHARS:
        cut = max(text.rfind(c, at, at + TEXT_CHARS) for c in _BREAKS)
        if cut < 0:
            after = [x for x in (text.find(c, at + TEXT_CHARS) for c in _BREAKS) if x >= 0]
            cut = min(after) if after else len(text) - 1
        parts.append(text[at : cut + 1])
        at = cut + 1
    return [*parts, text[at:]]


def _batches(batches):
    """(languages, texts) of bounded size from batches of (lang, text); a null language is ``und``."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und")
        for lo, hi in sub_batches(batch.column(1), TEXT_CHARS):
            lang, text = langs.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
            if hi - lo > 1:
                yield lang, text
            else:
                for part in _cut(text[0].as_py() or ""):
                    yield lang, pa.array([part])


def _lang_ids(lang: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = lang.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS) -> DataFrame:
    """(lang, bin, n): words of every language (bin null) and of every bin (lang null), all of them counted."""

    def run(batches):
        for langs, texts in _batches(batches):
            names, ids = _lang_ids(langs)
            words = _Words(texts, _lang_values(names)[ids])
            per_lang = np.bincount(ids[words.text], minlength=len(names))
            per_bin = np.bincount((words.value % np.uint64(bins)).astype(np.int64), minlength=bins)
            there = np.flatnonzero(per_bin)
            yield pa.RecordBatch.from_arrays([
                pa.array(names + [None] * len(there), pa.string()),
                pa.array([None] * len(names) + there.tolist(), pa.int64()),
                pa.array(np.concatenate((per_lang, per_bin[there])), pa.int64()),
            ], names=["lang", "bin", "n"])

    rows = docs.select(column(lang).cast("string"), column(text)).mapInArrow(run, "lang string, bin long, n long")
    return rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fragments(docs: DataFrame, counts: np.ndarray, limit: float, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, pivot, part, parts, fragment, weight): every piece of text, rewritten for each of its pivots.

    ``counts`` are the words of each bin.  A word is *rarer* than another if its bin has fewer words (of equal bins: if
    its value is greater).  A fragment of a pivot is a run of words that are not rarer than it, within ``max_words`` - 1
    words of an occurrence; windows of the same pivot that overlap are one fragment, so no phrase in it counts twice.
    """
    reach = max_words - 1

    def rewrite(words: _Words, lang_ids: np.ndarray, names: list[str]) -> pa.Table:
        n, value = len(words.start), words.value
        count = counts[(value % np.uint64(len(counts))).astype(np.int64)]
        frequent = count >= min_count
        edges = []
        for step in (-1, 1):
            extent, open_ = np.zeros(n, np.int64), frequent.copy()
            for d in range(1, reach + 1):
                here = slice(d, n) if step < 0 else slice(0, max(n - d, 0))
                there = slice(0, max(n - d, 0)) if step < 0 else slice(d, n)
                fits = np.zeros(n, bool)
                rarer = (count[there] < count[here]) | ((count[there] == count[here]) & (value[there] > value[here]))
                fits[here] = frequent[there] & ~rarer & (words.piece[there] == words.piece[here])
                open_ &= fits
                extent += open_
            edges.append(np.arange(n) + step * extent)
        at = np.flatnonzero(frequent)
        at = at[np.lexsort((at, value[at]))]
        first, last = edges[0][at], edges[1][at]
        new = np.ones(len(at), bool)
        new[1:] = (value[at[1:]] != value[at[:-1]]) | (first[1:] > last[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(at)]))[: len(head)] - 1
        first, last, pivot = first[head], last[tail], at[head]
        begin = words.start[first]
        found = _ranges(words.raw, begin, words.start[last] + words.size[last] - begin)
        made = pa.table({"lang": pa.array(lang_ids[words.text[pivot]], pa.int32()), "pivot": pa.array(value[pivot].view(np.int64)), "fragment": found, "count": pa.array(count[pivot], pa.int64()), "weight": pa.array(np.ones(len(pivot), np.int64))})
        made = made.group_by(["lang", "pivot", "fragment", "count"], use_threads=False).aggregate([("weight", "sum")])
        return made.set_column(0, "lang", pa.array(names, pa.string()).take(made["lang"].combine_chunks()))

    def run(batches):
        for langs, texts in _batches(batches):
            names, ids = _lang_ids(langs)
            made = rewrite(_Words(texts, _lang_values(names)[ids]), ids, names)
            if not made.num_rows:
                continue
            parts = np.ceil(made["count"].to_numpy() / limit).astype(np.int64)
            part = np.zeros(len(parts), np.int64)
            hot = np.flatnonzero(parts > 1)
            if len(hot):
                raw, offsets = flat_bytes(made["fragment"].take(pa.array(hot)))
                part[hot] = (_word_values(raw, offsets[:-1], np.diff(offsets)) % parts[hot].astype(np.uint64)).astype(np.int64)
            made = pa.table({"lang": made["lang"], "pivot": made["pivot"], "part": pa.array(part), "parts": pa.array(parts), "fragment": made["fragment"], "weight": made["weight_sum"]})
            yield from made.to_batches(max_chunksize=20_000)

    return docs.select(column(lang).cast("string"), column(text)).mapInArrow(run, "lang string, pivot long, part long, parts long, fragment string, weight long")


class _Miner:
    """Counts the phrases that contain their fragment's pivot, for runs of fragments in the order of pivots.

    The counts of a run's last pivot wait for the next run, so a pivot is counted as a whole wherever runs are cut, and
    only what is frequent goes out.  Pivots that are dealt to several tasks, and those with more phrases than can wait,
    go out as parts.
    """

    def __init__(self, max_words: int, min_count: int):
        self._max_words, self._min_count = max_words, min_count
        self._pivot, self._held, self._in_parts = None, None, False

    def _merged(self, rows: pa.Table) -> pa.Table:
        if self._held is None:
            return rows
        both = pa.concat_tables([self._held, rows]).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("f", "sum")])
        return both.rename_columns(["lang", "phrase", "words", "f"])

    def finish(self) -> pa.Table | None:
        """What waits, now that its pivot has ended."""
        held, self._held = self._held, None
        if held is None or self._in_parts:
            return held
        return held.filter(pc.greater_equal(held["f"], self._min_count))

    def mine(self, rows: pa.Table) -> list[pa.Table]:
        names, lang = _lang_ids(rows["lang"].combine_chunks())
        pivot, weight, divided = rows["pivot"].to_numpy(), rows["weight"].to_numpy(), rows["parts"].to_numpy() > 1
        raw, offsets = flat_bytes(rows["fragment"].combine_chunks())
        gap = raw == 32
        begins = np.zeros(len(raw), bool)
        begins[offsets[:-1]] = True
        begins[1:] |= gap[:-1]
        start = np.flatnonzero(begins)
        row = np.searchsorted(offsets, start, side="right") - 1
        end = np.concatenate((start[1:] - 1, [len(raw)]))
        last_of_row = np.concatenate((row[1:] != row[:-1], [True]))
        end[last_of_row] = offsets[row[last_of_row] + 1]
        size = end - start
        coded = _ranges(raw, start, size).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own_raw, own_offsets = flat_bytes(coded.dictionary)
        value = _word_values(own_raw, own_offsets[:-1], np.diff(own_offsets))
        owns = (mix(value[word] ^ _lang_values(names)[lang[row]]).view(np.int64) == pivot[row]).astype(np.int64)
        n_words = len(coded.dictionary)
        code, has = lang[row].astype(np.int64) * n_words + word, owns
        found: list[tuple] = []
        at = np.arange(len(word))
        for m in range(1, self._max_words + 1):
            if m > 1:
                # phrases one word longer: the one before at the same place, and the next word of the fragment
                stays = np.flatnonzero((at + m - 1 < len(word)) & (row[np.minimum(at + m - 1, len(word) - 1)] == row[at]))
                at, code, has = at[stays], code[stays], has[stays] | owns[at[stays] + m - 1]
                code = code * n_words + word[at + m - 1]
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            total = np.bincount(code, weights=weight[row[at]] * has, minlength=len(first)).astype(np.int64)
            # all places of a phrase that count have one pivot
            counted = np.flatnonzero(has > 0)
            place = np.zeros(len(first), np.int64)
            place[code[counted]] = at[counted]
            keep = np.flatnonzero(total > 0)
            found.append((place[keep], np.full(len(keep), m), total[keep]))
        place, length, total = (np.concatenate(x) for x in zip(*found, strict=True))
        of, last = pivot[row[place]], pivot[-1]

        def table_of(chosen: np.ndarray) -> pa.Table:
            at, m = place[chosen], length[chosen]
            phrase = _ranges(raw, start[at], end[at + m - 1] - start[at])
            return pa.table({"lang": pa.array(names, pa.string()).take(pa.array(lang[row[at]])), "phrase": phrase, "words": pa.array(m, pa.int32()), "f": pa.array(total[chosen], pa.int64())})

        out = []
        if self._pivot is not None and self._pivot != last:
            self._held = self._merged(table_of(np.flatnonzero(of == self._pivot)))
            out.append(self.finish())
        inside = (of != last) & (of != self._pivot if self._pivot is not None else True)
        out.append(table_of(np.flatnonzero(inside & ((total >= self._min_count) | divided[row[place]]))))
        waiting = table_of(np.flatnonzero(of == last))
        if self._pivot == last:
            self._held = self._merged(waiting)
        else:
            self._pivot, self._held, self._in_parts = last, waiting, bool(divided[-1])
        if self._held is not None and self._held.num_rows > HELD:
            self._in_parts = True
            out.append(self._held)
            self._held = None
        return [x for x in out if x is not None and x.num_rows]


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, bins: int = BINS, hot_share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to ``max_words`` words with f >= ``min_count``, and (lang, n).

    A phrase is a run of words ``[^\\x20\\x09]+`` inside a piece of text between ``[.,;:!?\\x0A-\\x0D]``, with A-Z
    lower-cased; f counts all its occurrences in the texts of its language.  A null text has no word, a null language is
    ``und``; repeated rows count each time; an empty table gives no row; other columns do not matter.  Work is in
    proportion to the text: at most 2 * ``max_words`` - 1 words for each word that is kept.
    """
    spark = docs.sparkSession
    counted = materialize(count_words(docs, text, lang, bins), "word-counts")
    counts = np.zeros(bins, np.int64)
    sizes = counted.where("bin is not null").select("bin", "n").toArrow()
    counts[sizes["bin"].to_numpy()] = sizes["n"].to_numpy()
    limit = max(1.0, hot_share * float(counts.sum()) / hash_partitions(spark))

    def run(batches):
        miner, held, size = _Miner(max_words, min_count), [], 0
        for batch in batches:
            for lo, hi in sub_batches(batch.column(4), MINE_BYTES):
                held.append(batch.slice(lo, hi - lo))
                size += held[-1].nbytes
                if size >= MINE_BYTES:
                    for made in miner.mine(pa.Table.from_batches(held)):
                        yield from made.to_batches(max_chunksize=20_000)
                    held, size = [], 0
        for made in [*(miner.mine(pa.Table.from_batches(held)) if held else ()), miner.finish()]:
            if made is not None:
                yield from made.to_batches(max_chunksize=20_000)

    dealt = fragments(docs, counts, limit, text, lang, max_words, min_count).repartition(hash_partitions(spark), "pivot", "part").sortWithinPartitions("pivot")
    mined = dealt.mapInArrow(run, "lang string, phrase string, words int, f long")
    # whole counts pass through; the parts of divided pivots are added up
    grams = mined.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return materialize(grams, "phrases"), counted.where("lang is not null").select("lang", "n")


def score_phrases(grams: DataFrame, sizes: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    A phrase's score is that of its lowest cut, floor(2000000 * a / (l + r)), of equal ones the cut with the shortest
    first part.  A phrase goes if a longer one that contains it has at least ``covered`` per cent of its occurrences;
    what contains it and is one word longer occurs at least as often as anything still longer, so that alone is asked.
    All parts of a frequent phrase are frequent, so every part is in ``grams``.
    """
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("tail")))
    found = grams.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    heads = grams.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = grams.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cut = found.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))
    longer = grams.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~(F.lit(100).cast("decimal(3,0)") * F.col("longer") >= F.lit(covered).cast("decimal(3,0)") * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring phrases of every language; null texts have no words, a null language is ``und``, repeated rows count."""
    return score_phrases(*mine_phrases(table(spark, sf_dir, "documents")))


#: The same rows by counting all phrases.
OP12_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) piece
    from documents),
worded as (select lang, regexp_extract_all(piece, '[^ 	]+') w from pieces),
sizes as (select lang, sum(len(w))::bigint n from worded group by lang),
placed as (select lang, w, unnest(range(1, len(w) + 1)) i from worded),
spans as (select lang, m::int words, array_to_string(w[i:i + m - 1], ' ') phrase from placed, (select unnest(range(1, 5)) m) where i + m - 1 <= len(w)),
grams as (select lang, words, phrase, count(*) f from spans group by all having count(*) >= 30),
listed as (select *, string_split(phrase, ' ') w from grams),
cuts as (select lang, phrase, words, f a, k, array_to_string(w[1:k], ' ') head, array_to_string(w[k + 1:], ' ') tail from listed, (select unnest(range(1, 4)) k) where k < words),
scored as (
    select c.lang, c.phrase, c.a, c.k, h.f l, t.f r, (2000000::hugeint * c.a) // (h.f::hugeint + t.f) score
    from cuts c join grams h on h.lang = c.lang and h.phrase = c.head join grams t on t.lang = c.lang and t.phrase = c.tail),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
    select lang, array_to_string(w[1:words - 1], ' ') phrase, f from listed where words > 2
    union all select lang, array_to_string(w[2:], ' '), f from listed where words > 2),
covers as (select lang, phrase, max(f) longer from inner_ group by all),
kept as (select l.* from lowest l left join covers c on c.lang = l.lang and c.phrase = l.phrase where c.longer is null or not 100 * c.longer >= 80 * l.a)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept) join sizes using (lang)
where rank <= 2000
"""
