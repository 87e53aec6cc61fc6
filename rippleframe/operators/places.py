"""Joins of things and facts that share a place, where the pairs are many more than either.

Things that have the same set of places meet the same facts.  Those sets are classes: the facts of a class are found and
made distinct once, and then every thing gets those of its class, so the pairs themselves go through no exchange.  Joins
are merge joins: a side that is small when packed may be hundreds of MB as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import forget, step

#: Things that a fact is spelled out with before the next fact comes.
RUN = 1_024
#: Pairs that a task spells out: at least, where there are enough tasks, and at most.
TASK_PAIRS = 2_000_000, 50_000_000


def classed(things: DataFrame, on: list[str]) -> DataFrame:
    """The distinct things, told by their columns beside ``on``, with the sorted set ``_places`` of their ``on``."""
    own = [c for c in things.columns if c not in on]
    return things.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct(*on))).alias("_places"))


def class_facts(things: DataFrame, facts: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """(_places, *keep): the distinct facts of each class of ``classed`` things."""
    classes = things.select("_places").distinct().select("_places", F.explode("_places").alias("_at")).select("_places", "_at.*")
    return classes.join(facts.distinct().hint("merge"), on).select("_places", *keep).distinct()


def pairs_by_place(things: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """The distinct pairs of things and facts that share ``on``, without ``on``."""
    told = [c for c in facts.columns if c not in on]
    rows = classed(things, on)
    return rows.join(class_facts(rows, facts, on, told).hint("merge"), "_places").drop("_places")


def pairs_by_runs(things: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """The pairs of ``pairs_by_place`` where they are so many that writing them is most of the work.

    The things of a class are cut into runs, every run gets the facts of its class, and tasks get runs in proportion to
    the pairs.  A task holds one run and spells it out for one fact after the other: a column of a fact is a run of one
    value and those of things repeat soon, which files keep small.
    """
    n = int(things.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = [c for c in facts.columns if c not in on]
    rows = step(classed(things, on))
    own = [c for c in rows.columns if c != "_places"]
    classes = step(rows.select("_places").distinct().withColumn("_class", F.monotonically_increasing_id()))
    numbered = step(rows.join(classes.hint("merge"), "_places").select("_class", *own))
    placed = numbered.repartitionByRange(n, "_class", *own).sortWithinPartitions("_class", *own)
    placed = step(placed.withColumn("_run", F.floor(F.monotonically_increasing_id() / RUN)))
    at = classes.select("_class", F.explode("_places").alias("_at")).select("_class", "_at.*")
    known = step(at.join(facts.distinct().hint("merge"), on).select("_class", *told).distinct())
    sizes = [of.groupBy("_class").agg(F.count(F.lit(1)).cast("double").alias(c)) for of, c in ((placed, "_a"), (known, "_b"))]
    pairs = sizes[0].join(sizes[1].hint("merge"), "_class").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    forget(rows, classes, numbered)
    tasks = max(1, min(n, -int(-pairs // TASK_PAIRS[0])), -int(-pairs // TASK_PAIRS[1]))
    runs = placed.select("_class", "_run").distinct()
    asked = known.join(runs.hint("merge"), "_class").repartition(tasks, "_class", "_run")
    return asked.join(placed.repartition(tasks, "_class", "_run").hint("merge"), ["_class", "_run"]).select(*own, *told)
