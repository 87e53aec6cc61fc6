"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words and their pairs are hashed into a fixed number of bins.  Two multinomials are counted: one over the documents of
a trusted target, one over the whole raw corpus.  A document's score is the mean of log p_target(bin) - log p_raw(bin)
over its n-grams; the weights are whole millionths, so sums are exact and do not depend on any order, and one fixed
threshold decides every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_PATTERN, outward, table

#: Number of bins; the weights (8 bytes each) are the only thing that every task gets.
BINS = 65_536
#: At most so many trusted documents are counted for the target; those with the smallest hash of their id.
TARGET_SAMPLE = 20_000
#: Mean log-likelihood ratio below which a document is rejected.
THRESHOLD = -0.13
SCALE = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def _pairs(hashes: Column) -> Column:
    """Hash of each value and its successor."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def gram_bins(hashes: Column, bins: int = BINS) -> Column:
    """Bins of a document's words and word pairs, from its words' hashes; a repeated n-gram counts each time."""
    return F.transform(F.concat(hashes, _pairs(hashes)), lambda h: F.pmod(h, F.lit(bins)).cast("int"))


#: Columns that the base measures add.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _inner(docs: DataFrame) -> DataFrame:
    """The rows under names of our own (c0, c1, ...), which no name of the input can clash with."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``hashes`` of the words and the base measures."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    hashed = rows.withColumn("hashes", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    triples = F.col("triples")
    # positions of windows that occur again, found by sorting (hash, position): equal hashes are neighbours
    ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(F.slice(F.col("ordered"), 1, F.size("ordered") - 1), F.slice(F.col("ordered"), 2, F.size("ordered") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    hashed = hashed.withColumn("pairs", _pairs(F.col("hashes")))
    last = F.greatest(F.size("hashes") - 2, F.lit(0))
    hashed = hashed.withColumn("triples", F.zip_with(F.slice("pairs", 1, last), F.slice("hashes", 3, last), lambda p, c: F.xxhash64(p, c)))
    hashed = hashed.withColumn("ordered", F.when(F.size(F.array_distinct(triples)) < F.size(triples), ordered))
    return hashed.withColumns({
        "n_words": F.size("hashes").cast("long"),
        "word_chars": F.length(F.translate(value, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    }).drop("pairs", "triples", "ordered")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text has no words.  An input column that has a measure's name goes out with ``_input`` added to its name.
    """
    measured = _measured(_inner(docs), f"c{docs.columns.index(text)}")
    return measured.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(outward(docs.columns, MEASURES))), *MEASURES)


def log_ratio_weights(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", bins: int = BINS, sample: int = TARGET_SAMPLE) -> np.ndarray:
    """The ``bins`` weights in whole millionths: log of the target's bin frequency over the raw corpus's, add-one smoothed.

    ``trusted`` gives the ids of trusted documents, of which ``sample`` are counted at most (a bounded, documented fit);
    the raw counts cover every document.  Counting is one pass with map-side sums over at most 2 * ``bins`` keys, and the
    result of fixed size is all that reaches the driver.
    """
    chosen = trusted.select(F.col(doc_id).alias("_trusted")).where(F.col("_trusted").isNotNull()).distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(sample)
    hashes = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    grams = (
        docs.select(F.col(doc_id).alias("_id"), hashes.alias("_hashes"))
        .join(F.broadcast(chosen), F.col("_id") == F.col("_trusted"), "left")
        .select(F.col("_trusted").isNotNull().alias("target"), F.explode(gram_bins(F.col("_hashes"), bins)).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("target"))
    )
    raw, target = np.zeros(bins), np.zeros(bins)
    for row in grams.collect():
        raw[row["bin"]], target[row["bin"]] = row["raw"], row["target"]
    ratio = np.log((target + 1) / (target.sum() + bins)) - np.log((raw + 1) / (raw.sum() + bins)) if target.sum() else np.zeros(bins)
    return np.rint(ratio * SCALE).astype(np.int64)


def judge_quality(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, bins: int = BINS, sample: int = TARGET_SAMPLE) -> DataFrame:
    """The rows of ``docs`` with the base measures, base_failed, score and kept.

    A null or empty text has no words and fails the base rule.  Without any trusted document all weights are zero, and
    the base rule alone decides.  Rows are judged one by one, so repeated rows and null ids need no special case; an
    empty table gives no row.  An input column that has a result's name goes out with ``_input`` added to its name.

    ``kept`` is tied to the row number, which the optimizer may not copy or move: a filter on the verdict stays above
    it, so each text is split and measured once.
    """
    # one string crosses to the JVM and is folded into a constant array there: far quicker than as many single values
    packed = ",".join(map(str, log_ratio_weights(docs, trusted, text, doc_id, bins, sample).tolist()))
    weights = F.split(F.lit(packed), ",").cast("array<bigint>")
    measured = _measured(_inner(docs), f"c{docs.columns.index(text)}")
    grams = gram_bins(F.col("hashes"), bins)
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda acc, b: acc + F.get(weights, b))
    n_grams = (F.size("hashes") + F.greatest(F.size("hashes") - 1, F.lit(0))).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed).withColumn("total", F.when(~F.col("base_failed"), total))
    # the score is only missing where the base rule has failed
    kept = F.coalesce(~F.col("base_failed") & (F.col("total") >= F.lit(threshold * SCALE) * n_grams), F.lit(False)) & (F.monotonically_increasing_id() >= 0)
    results = [*MEASURES, "base_failed", "score", "kept"]
    judged = judged.withColumn("score", F.col("total") / (n_grams * SCALE)).withColumn("kept", kept)
    return judged.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(outward(docs.columns, results))), *results)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document; null and empty texts have no words and fail, repeated rows repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_quality(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept")
