"""Report queries over result tables: exact filters, globs, search, orders, pages, id ranges and size-bounded shards."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.keys import artifact_selected
from ..operators.steps import forget, step


#: Ids that one task of ``id_ranges`` sorts.
TASK_IDS = 250_000
#: Records that one task of ``shard_plan`` takes in order.
TASK_RECORDS = 100_000


@dataclass(frozen=True)
class ReportQuery:
    """Q01 to Q08: conditions are conjunctive; a search is a disjunction over its columns; every method gives a new query."""

    rows: DataFrame
    conditions: tuple[Column, ...] = ()
    order: tuple = ()
    page_size: int | None = None
    page: int = 0
    known: dict = field(default_factory=dict)

    def exact(self, column: str, value) -> ReportQuery:
        """Q07: a value that is not among the column's known values is an error; the earlier query stays as it is."""
        if value is None:
            return self
        if column in self.known and value not in self.known[column]:
            raise ValueError(f"unknown {column}: {value}")
        return replace(self, conditions=(*self.conditions, F.col(column) == value))

    def glob(self, column: str, include: list[str], exclude: list[str]) -> ReportQuery:
        return replace(self, conditions=(*self.conditions, artifact_selected(F.col(column), include, exclude)))

    def search(self, text: str, *columns: str) -> ReportQuery:
        if not text.strip():
            return self
        hit = reduce(lambda a, b: a | b, (F.lower(F.col(c).cast("string")).contains(text.strip().lower()) for c in columns))
        return replace(self, conditions=(*self.conditions, F.coalesce(hit, F.lit(False))))

    def sorted(self, *order) -> ReportQuery:
        return replace(self, order=order)

    def paged(self, size: int, page: int) -> ReportQuery:
        if size not in (10, 50, 100):
            raise ValueError("pages have 10, 50 or 100 rows")
        return replace(self, page_size=size, page=max(0, page))

    def clamped(self) -> ReportQuery:
        """The page, or the last one there is."""
        rows = reduce(DataFrame.where, self.conditions, self.rows).count()
        return replace(self, page=min(self.page, max(0, -(-rows // self.page_size) - 1)))

    def result(self) -> DataFrame:
        out = reduce(DataFrame.where, self.conditions, self.rows)
        out = out.orderBy(*self.order) if self.order else out
        return out.offset(self.page * self.page_size).limit(self.page_size) if self.page_size else out


def change_filter(change: str) -> Column:
    """Q06: SCOPE_CHANGED stands beside the base types."""
    return F.col("scope_changed") if change == "SCOPE_CHANGED" else F.col("base_type") == change


def id_ranges(rows: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """Runs of consecutive ids as (start, count), repeated ids counted once.

    Tasks grow in number with the rows (about ``TASK_IDS`` each), not in size.
    """
    ids = rows.select(*by, id_column)
    least = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(*by).orderBy(id_column)
    here = F.col(id_column)
    # repeated ids lie beside each other once they are sorted, so nothing is hashed first
    opens = F.when(here.isNull() | (here - F.lag(here).over(w) <= 1), 0).otherwise(1)
    runs = ids.repartition(max(least, -(-ids.count() // TASK_IDS)), *by).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*by, "_run").agg(F.min(id_column).alias("start"), F.coalesce(F.max(id_column) - F.min(id_column) + 1, F.lit(1)).alias("n")).drop("_run")


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Q09: [start, stop) ranges that touch or overlap become one."""
    before = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1)), 1).otherwise(0)
    marked = ranges.withColumn("_open", opens)
    run = F.sum("_open").over(Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def dense_ids(keys: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """Ids from 0 in the order of the distinct keys, without a single-partition sort.

    """
    return numbered(keys.select(*order).distinct(), order, id_column)


def numbered(rows: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """The rows with ids from 0 in the order of ``order``, which tells them apart.

    A range partitioning sorts the rows, which are written with their places: partition and row in one number.  Each
    partition's start is the sum of the counts before it, so nothing is sorted or shuffled a second time.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = step(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each partition
    return parts.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + row).alias(id_column))


def sorted_groups(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of each key together and in order; Spark's sort spills what does not fit into memory."""
    return rows.repartition(*key).sortWithinPartitions(*key, *order)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows with running sums (the row's own value included) in the order of ``order``, over all rows.

    A range partitioning sorts the rows and is written once; each partition adds up alone, from the sum of the
    partitions before it.  Rows of equal order would share a sum's place, so ``order`` must tell rows apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = step(rows.repartitionByRange(n, *order).withColumns({"_part": F.spark_partition_id(), **{f"_v_{name}": value.cast("long") for name, value in sums.items()}}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*(F.sum(f"_v_{name}").alias(name) for name in sums))
    starts = totals.select("_part", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_s_{name}") for name in sums))  # a row for each partition
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(F.broadcast(starts), "_part").select(*rows.columns, *((F.col(f"_s_{name}") + F.sum(f"_v_{name}").over(local)).alias(name) for name in sums))


def _chunk_paths(size: np.ndarray, opens: np.ndarray, max_bytes: int, max_records: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, turn, last) of records in order, of which ``opens`` must open a shard.

    ``shard`` counts from 0 where the first record opens one.  Where the first one to open is a later record, at most the
    one that would open the next shard, each shard's bounds move on by less than a shard: a record's number is one less
    if that record lies at or past its ``turn``.  ``last`` is the last record that opens one, for each such beginning.
    """
    n = len(size)
    rows, ends = np.arange(n), np.cumsum(size + 1)
    musts = np.append(np.flatnonzero(opens), n)
    after = np.maximum(np.searchsorted(ends, ends - size + max_bytes, "right"), rows + 1)  # the first record that does not fit
    after = np.append(np.minimum(np.minimum(after, rows + max_records), musts[np.searchsorted(musts, rows, "right")]), n)
    shard, turn = np.empty(n, "int64"), np.empty(n, "int64")
    reached = last = np.arange(min(after[0] + 1, n))
    for number in count():
        start, stop = reached[0], after[reached[0]]
        shard[start:stop], turn[start:stop] = number, np.searchsorted(reached, rows[start:stop], "right")
        if stop == n:
            return shard, turn, np.where(reached < n, reached, last)
        last, reached = reached, after[reached]


def _chunk_kernel(by: list[str], max_bytes: int, max_records: int, schema: pa.Schema):
    def solve(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        n = table.num_rows
        size, opens, begins = table["_size"].to_numpy(), table["_forced"].to_numpy(), np.zeros(n, bool)
        for c in by:
            codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins[1:] |= codes[1:] != codes[:-1]
        shard, turn, last = _chunk_paths(size, opens | begins, max_bytes, max_records)
        # kinds that begin here are numbered from their own beginning, wherever the first kind's shards lie
        kinds = np.append(0, np.flatnonzero(begins))
        kind = kinds[np.searchsorted(kinds, np.arange(n), "right") - 1]
        ends, heads = np.cumsum(size + 1), np.arange(n) < len(last)
        at_last = np.append(last, np.zeros(n - len(last), "int64"))
        found = {"_shard": (shard - shard[kind], None), "_turn": (turn, kind > 0), "_at": (np.arange(n), ~heads), "_end": (ends, ~heads), "_must": (opens | begins, ~heads), "_last": (at_last, ~heads),
                 "_left": ((ends - size - 1)[at_last], ~heads), "_rows": (np.full(n, n), np.arange(n) < n - 1), "_sum": (np.full(n, ends[-1]), np.arange(n) < n - 1)}
        columns = [pa.array(found[f.name][0], f.type, mask=found[f.name][1]) if f.name in found else table[f.name].cast(f.type) for f in schema]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)

    return solve


def shard_plan(records: DataFrame, by: list[str], order: str, size: str, max_bytes: int, max_records: int, starts: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greedy shards of each kind: a record opens a new one when bytes (with a separator each) or records run out.

    A record that is larger than a shard has one of its own; ``starts`` names a column that forces a record to open one;
    ``keep`` names further columns of the result.  ``order`` tells the records of a kind apart.

    A range sort cuts all records into chunks of about ``TASK_RECORDS``, each of them solved within a task for every record that may
    be the first to open a shard there (one shard's length, or the chunk).  Only those records meet across chunks: each
    points to the one that opens a later chunk's first shard, a range search by counting, and the pointers are doubled
    from the forced ones on.  So the records are shuffled and written once; rounds grow with the logarithm of the chunks.
    """
    names = [*by, order]
    forced = F.coalesce(F.col(starts), F.lit(False)) if starts else F.lit(False)
    rows = records.select(*names, *keep, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), forced.alias("_forced"))
    ordered = rows.repartitionByRange(max(1, -(-records.count() // TASK_RECORDS)), *names).sortWithinPartitions(*names).withColumn("_part", F.spark_partition_id())
    schema = StructType(ordered.drop("_size", "_forced").schema.fields)
    for column in ("_shard", "_turn", "_at", "_end", "_last", "_left", "_rows", "_sum"):
        schema = schema.add(column, "long")
    schema = schema.add("_must", "boolean")
    parts = step(ordered.mapInArrow(_chunk_kernel(by, max_bytes, max(1, max_records), to_arrow_schema(schema)), schema))

    # a row for each chunk: what lies before it, whether its first record begins a kind, where the next forced record lies
    is_first, is_last = F.col("_at") == 0, F.col("_rows").isNotNull()
    of_last = lambda c: F.max(F.when(is_last, c))
    chunks = parts.where(F.col("_at").isNotNull() | is_last).groupBy("_part").agg(
        F.max(F.when(is_first, F.struct(*by))).alias("_head"), of_last(F.struct(*by)).alias("_tail"), of_last(F.col("_rows")).alias("_rows"), of_last(F.col("_sum")).alias("_sum"),
        of_last(F.col("_shard")).alias("_end_shard"), of_last(F.col("_turn")).alias("_end_turn"), F.count("_at").alias("_heads"), F.min(F.when(F.col("_must"), F.col("_at"))).alias("_must_at"))
    w = Window.orderBy("_part")
    before, beyond = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    summed = {name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in (("_row0", "_rows"), ("_sum0", "_sum"), ("_head0", "_heads"))}
    chunks = chunks.withColumns({**summed, "_begins": F.lag("_part").over(w).isNull() | ~F.lag("_tail").over(w).eqNullSafe(F.col("_head"))})
    chunks = step(chunks.withColumn("_next_must", F.min(F.col("_row0") + F.when(F.col("_begins"), 0).otherwise(F.col("_must_at"))).over(beyond)).drop("_head", "_tail"))

    opening = parts.where("_at IS NOT NULL").select("_part", "_at", "_end", "_must", "_last", "_left").join(F.broadcast(chunks), "_part")
    heads = step(opening.select("_part", "_at", (F.col("_row0") + F.col("_at")).alias("_place"), (F.col("_head0") + F.col("_at")).alias("_nth"), (F.col("_sum0") + F.col("_end")).alias("_bytes"),
        (F.col("_must") | (F.col("_begins") & is_first)).alias("_opens"), (F.col("_row0") + F.col("_last") + max(1, max_records)).alias("_full"), (F.col("_sum0") + F.greatest(F.col("_left") + 1 + max_bytes, "_sum")).alias("_reach"), "_next_must"))
    # the first one that ends beyond the last byte which a shard that is open at a chunk's end may hold
    ends = heads.select(F.col("_bytes").alias("_key"), F.lit(0).alias("_asks"), F.col("_place").alias("_of"))
    reach = heads.select(F.col("_reach").alias("_key"), F.lit(1).alias("_asks"), F.col("_place").alias("_of"))
    found = running_sums(ends.union(reach), ["_key", "_asks", "_of"], {"_fit": 1 - F.col("_asks")}).where("_asks = 1").select(F.col("_of").alias("_place"), F.col("_fit").alias("_nth"))
    fits = found.join(heads.select("_nth", F.col("_place").alias("_beyond")), "_nth", "left").select("_place", "_beyond")
    ahead = F.least("_beyond", "_full", "_next_must")
    pointers = step(heads.join(fits, "_place").select("_place", ahead.alias("_next")).join(heads.select(F.col("_place").alias("_next")), "_next", "left_semi").select("_place", "_next"))
    opened = step(heads.where("_opens").select("_place"))
    while True:
        new = step(opened.join(pointers, "_place").select(F.col("_next").alias("_place")).distinct().join(opened, "_place", "left_anti"))
        if new.isEmpty():
            break
        grown = step(opened.union(new))
        further = step(pointers.join(pointers.select(F.col("_place").alias("_next"), F.col("_next").alias("_then")), "_next").select("_place", F.col("_then").alias("_next")))
        forget(opened, pointers, new)
        opened, pointers = grown, further

    # the record that opens each chunk's first shard (none: past its end), and how many shards its first kind has before
    entries = heads.join(opened, "_place", "left_semi").groupBy("_part").agg(F.min("_at").alias("_entry"))
    known = chunks.join(entries, "_part", "left").withColumn("_entry", F.coalesce("_entry", "_rows"))
    own = F.col("_end_shard") + 1 - F.coalesce((F.col("_entry") >= F.col("_end_turn")).cast("long"), F.lit(0))
    known = known.withColumns({"_own": own, "_kind": F.sum((F.col("_begins") | F.col("_end_turn").isNull()).cast("long")).over(w)})
    known = known.withColumn("_upto", F.sum("_own").over(Window.partitionBy("_kind").orderBy("_part")))
    known = step(known.select("_part", "_entry", F.when(F.col("_begins"), 0).otherwise(F.lag("_upto").over(w)).alias("_before")))
    forget(chunks, heads, opened, pointers, new)
    shard = F.when(F.col("_turn").isNull(), F.col("_shard")).otherwise(F.col("_before") + F.col("_shard") - (F.col("_entry") >= F.col("_turn")).cast("long"))
    return parts.join(F.broadcast(known), "_part").select(*names, *keep, shard.alias("shard_id"))


def shard_descriptors(planned: DataFrame, kind: str, order: str, size: str) -> DataFrame:
    """(kind, shard_id, file, first_id, last_id, records, bytes) of every shard; a separator stands between records."""
    file = F.format_string("%s-%05d.js", F.col(kind), F.col("shard_id"))
    rows = planned.groupBy(kind, "shard_id").agg(F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.count(F.lit(1)).alias("records"), (F.sum(size) + F.count(F.lit(1)) - 1).cast("long").alias("bytes"))
    return rows.select(kind, "shard_id", file.alias("file"), "first_id", "last_id", "records", "bytes")
