"""Repair of conversations by a rank-compressed dynamic program over edits.

The roles of a repaired conversation are ``(s?(ua)+)?``.  Edits are grouped into *macros*: a run of insertions and the
turn that follows, written as ``I*`` and one of D, K, R.  No macro begins another one, so strings of as many macros
compare macro by macro, and the ASCII order of audits is the order of their macros' codes.  A layer of the program is a
turn.  Of each state it keeps the least cost and, instead of the audit, the *rank* of the audit among those of its
layer: the next layer's ranks are those of (rank, code).  Parent pointers give the audit back afterwards.

A conversation is cut into chunks of its sorted rows.  A chunk's program runs from every state at once, which gives a
small table (cost and rank from each state to each state); tables of a conversation's chunks are joined in order, and
every chunk is then traced between the states that were chosen.  Only the digest of a conversation's repaired text, which
has no parts, and its audit are put together in one place, piece after piece.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, hash_partitions, materialize, table

#: Rows of a chunk, a power of two.
CHUNK = 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row, the first that counts.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What a user's or assistant's turn leads to; every state allows exactly one of them.
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Macros in ASCII order; more than two insertions before a turn only repeat a state.
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
_ENDING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _macros() -> dict[tuple[str, int, int], list[tuple[int, int, int]]]:
    """(initial, fault, state) to its macros: (code, state, cost)."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for fault in range(4):
            for state in range(4):
                found, at = [], state
                for inserted in range(3):
                    cost, run = INSERT * inserted, "I" * inserted
                    found.append((CODES.index(run + "D"), at, cost + DELETE))
                    if fault not in (BLANK, DUPLICATE):
                        more = cost + (TRUNCATED if fault == CUT else 0)
                        found.append((CODES.index(run + "R"), _NEXT[at], more + REROLE))
                        kept = SYSTEM if initial == "s" and at == EMPTY else _NEXT[at] if initial and initial == _ROLE[_NEXT[at]][0] else None
                        if kept is not None:
                            found.append((CODES.index(run + "K"), kept, more + KEEP))
                    at = _NEXT[at]
                out[initial, fault, state] = sorted(found)
    return out


_MACROS = _macros()


#: (normalised layer, initial, fault) to (next layer, cost to add, parents): layers repeat, since costs differ by little.
_STEPS: dict[tuple, tuple] = {}


class Layers:
    """The program over some turns, from each of the states in ``entries``."""

    def __init__(self, entries=(EMPTY,), traced: bool = True):
        #: (entry, state), cost above ``_base``, rank.
        self._layer: tuple = tuple(((e, e), 0, 0) for e in entries)
        self._base = 0
        #: For each turn: (entry, state) to (state before, code).
        self._parents: list[dict[tuple[int, int], tuple[int, int]]] | None = [] if traced else None

    @property
    def best(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(entry, state) to (cost, rank)."""
        return {k: (cost + self._base, rank) for k, cost, rank in self._layer}

    @staticmethod
    def _step(layer: tuple, initial: str, fault: int) -> tuple:
        chosen: dict[tuple[int, int], tuple] = {}
        for (entry, state), cost, rank in layer:
            for code, target, more in _MACROS[initial, fault, state]:
                candidate = (cost + more, rank, code, state)
                key = (entry, target)
                if key not in chosen or candidate < chosen[key]:
                    chosen[key] = candidate
        ranks = {x: i for i, x in enumerate(sorted({c[1:3] for c in chosen.values()}))}
        base = min(c[0] for c in chosen.values())
        return tuple((k, c[0] - base, ranks[c[1:3]]) for k, c in sorted(chosen.items())), base, {k: (c[3], c[2]) for k, c in chosen.items()}

    def turn(self, initial: str, fault: int) -> None:
        key = (self._layer, initial if initial in ("s", "u", "a") else "", fault)
        step = _STEPS.get(key)
        if step is None:
            if len(_STEPS) > 50_000:
                _STEPS.clear()
            step = _STEPS[key] = self._step(*key)
        self._layer, more, parents = step
        self._base += more
        if self._parents is not None:
            self._parents.append(parents)

    def trace(self, entry: int, state: int) -> list[str]:
        """Macros of the best edits from ``entry`` to ``state``, in order."""
        out = []
        for parents in reversed(self._parents):
            state, code = parents[entry, state]
            out.append(CODES[code])
        return out[::-1]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows as crc32(``conv:turn``) % 20 damages them; dropped rows have no copy.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes the role ``user``.  A null
    role, text, or number in the hashed string, is one space; a null turn or conversation stays null.
    """
    named = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named(conv), F.lit(":"), named(turn)).cast("binary")) % 20
    value = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(named(text), ".!?", "")).otherwise(named(text))
    return rows.select(
        column(conv).alias("conv"), column(turn).alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(named(role)).alias("role"), value.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _fault(text: Column, first: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", BLANK).when(~first, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)


def ordered_rows(damaged: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, fault, pos, chunk): rows in the order (conv, turn, role, text), nulls first.

    Equal rows are one row with more copies.  ``pos`` grows in that order; rows of a conversation may lie in several
    tasks.  A row is a duplicate if its role and text have an earlier turn in its conversation.
    """
    spark = damaged.sparkSession
    own = damaged.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    own = materialize(own.withColumn("key", F.sha2(F.col("text"), 256)), "conversation-rows")
    firsts = own.where("copies > 0").groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("first"))
    same = (F.col("o.conv").eqNullSafe(F.col("f.conv"))) & (F.col("o.role") == F.col("f.role")) & (F.col("o.key") == F.col("f.key"))
    marked = own.alias("o").join(firsts.alias("f"), same, "left").select("o.*", F.col("f.first.turn").eqNullSafe(F.col("o.turn")).alias("is_first"))
    marked = marked.select("conv", "turn", "role", "text", "copies", _fault(F.col("text"), F.col("is_first")).alias("fault"))
    dealt = marked.repartitionByRange(hash_partitions(spark), "conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    return materialize(dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("chunk", F.expr(f"pos div {CHUNK}")), "conversation-order", [own])


_FACTS = "conv long, chunk long, copies long, low long, high long, turns long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, cut long, illegal long, table array<long>"


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _groups(batches, keys: int):
    """Rows (tuples) of one group after the other; rows of a group follow each other."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _faults_of(fault: int, copies: int) -> list[int]:
    """Faults of a row and its repetitions."""
    return [] if not copies else [fault] + [BLANK if fault == BLANK else DUPLICATE] * (copies - 1)


def _packed(rows, schema: pa.Schema):
    """Record batches of bounded size from rows (tuples)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunk_facts(batches):
    """One row of facts and the program's table for every (conv, chunk)."""
    for (conv, chunk), rows in _groups(batches, 2):
        layers, counts, illegal, turns, n = Layers(range(4), traced=False), [0] * 4, 0, 0, 0
        before = first = low = None
        for _, _, _, turn, role, copies, fault in rows:
            for kind in _faults_of(fault, copies):
                layers.turn(role[:1], kind)
                counts[kind] += 1
                first = first or (turn, role)
                illegal += before is not None and not _legal(before[1], role)
                turns += turn is not None and (before is None or before[0] != turn)
                low = turn if low is None else low
                before, n = (turn, role), n + 1
        cells = [v for e in range(4) for s in range(4) for v in layers.best.get((e, s), (-1, -1))]
        first, last = first or (None, None), before or (None, None)
        yield conv, chunk, n, low, last[0], turns, first[0], last[0], first[1], last[1], *counts[1:], illegal, cells


_JOINED = "conv long, chunk long, entry int, state int, last int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_PIECES = "conv long, chunk long, audit string, repaired binary"
_WHOLE = "conv long, audit string, repaired_sha256 string"


def _type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[name]


def _schema(text: str) -> pa.Schema:
    return pa.schema([(f.split(" ")[0], _type(f.split(" ")[1])) for f in text.split(", ")])


def _join_chunks(batches):
    """For every conversation: its totals at its last chunk, and the states each chunk runs between."""
    for (conv,), rows in _groups(batches, 1):
        best, parents, chunks = {EMPTY: (0, 0)}, [], []
        low = high = None
        turns = illegal = 0
        counts, before = [0] * 3, None
        for _, chunk, n, own_low, own_high, own_turns, first_turn, last_turn, first_role, last_role, *found, own_illegal, cells in rows:
            chunks.append(chunk)
            if n:
                if before is not None:
                    illegal += not _legal(before[1], first_role)
                    turns -= first_turn is not None and before[0] == first_turn
                before = (last_turn, last_role)
            low, high = own_low if low is None else low, own_high if own_high is not None else high
            turns, illegal, counts = turns + own_turns, illegal + own_illegal, [a + b for a, b in zip(counts, found, strict=True)]
            chosen: dict[int, tuple] = {}
            for entry, (cost, rank) in best.items():
                for state in range(4):
                    more, order = cells[8 * entry + 2 * state : 8 * entry + 2 * state + 2]
                    candidate = (cost + more, rank, order, entry)
                    if more >= 0 and (state not in chosen or candidate < chosen[state]):
                        chosen[state] = candidate
            ranks = {x: i for i, x in enumerate(sorted({c[1:3] for c in chosen.values()}))}
            best = {s: (c[0], ranks[c[1:3]]) for s, c in chosen.items()}
            parents.append({s: c[3] for s, c in chosen.items()})
        cost, _, _, state = min((c + INSERT * len(_ENDING[s]), r, _ENDING[s], s) for s, (c, r) in best.items())
        gaps = high - low + 1 - turns if low is not None else 0
        for i in range(len(chunks) - 1, -1, -1):
            last = i == len(chunks) - 1
            yield conv, chunks[i], parents[i][state], state, int(last), *((gaps, *counts, illegal, cost) if last else [None] * 6)
            state = parents[i][state]


def _repair_chunks(batches):
    """For every chunk: its audit, and its repaired turns joined by newlines (null if there is none)."""
    for (conv, chunk, entry, state, last), rows in _groups(batches, 5):
        layers, held = Layers((entry,)), []
        for *_, role, text, copies, fault in rows:
            for kind in _faults_of(fault, copies):
                layers.turn(role[:1], kind)
                held.append((role, text))
        macros = layers.trace(entry, state)
        at, out = entry, []
        for macro, (role, text) in zip([*macros, _ENDING[state] if last else ""], [*held, ("", "")], strict=True):
            for edit in macro:
                if edit == "I":
                    at = _NEXT[at]
                    out.append(_ROLE[at] + ":")
                elif edit == "R":
                    at = _NEXT[at]
                    out.append(f"{_ROLE[at]}:{text}")
                elif edit == "K":
                    at = SYSTEM if role[0] == "s" else _NEXT[at]
                    out.append(f"{role}:{text}")
        audit = "".join(macros) + (_ENDING[state] if last else "")
        yield conv, chunk, audit, "\n".join(out).encode("utf-8") if out else None


def _whole(batches):
    """(conv, audit, repaired_sha256) of every conversation, its pieces read in order one after the other."""
    for (conv,), rows in _groups(batches, 1):
        sha, audit, begun = hashlib.sha256(), [], False
        for _, _, part, repaired in rows:
            audit.append(part)
            if repaired is not None:
                sha.update((b"\n" if begun else b"") + repaired)
                begun = True
        yield conv, "".join(audit), sha.hexdigest()


def _by(rows: DataFrame, keys: list[str], order: list[str], kernel, schema: str) -> DataFrame:
    """``kernel`` over the rows of every key, which follow each other in ``order``."""

    def run(batches):
        return _packed(kernel(batches), _schema(schema))

    return rows.repartition(hash_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every conversation of ``rows`` as they are damaged by ``damage``, with the cheapest repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Conversation and turn are
    whole numbers; rows without a conversation form one of their own.  Rows are taken by turn, nulls first, and where
    turns are equal by role and text.  An empty role, or one that begins with another letter than s, u or a, cannot be
    kept.  A conversation without rows after the damage has zeros, an empty audit and the digest of an empty text; an
    empty table gives no row; other columns do not matter.
    """
    ordered = ordered_rows(damage(rows, conv, turn, role, text).withColumns({"conv": F.col("conv").cast("long"), "turn": F.col("turn").cast("long")}))
    narrow = ordered.select("conv", "chunk", "pos", "turn", F.substring("role", 1, 1).alias("role"), "copies", "fault")
    facts = _by(narrow, ["conv", "chunk"], ["pos"], _chunk_facts, _FACTS)
    joined = materialize(_by(facts, ["conv"], ["chunk"], _join_chunks, _JOINED), "conversation-states")
    same = F.col("o.conv").eqNullSafe(F.col("j.conv")) & (F.col("o.chunk") == F.col("j.chunk"))
    traced = ordered.alias("o").join(joined.alias("j"), same).select("o.conv", "o.chunk", "entry", "state", "last", "pos", "role", "text", "copies", "fault")
    pieces = _by(traced, ["conv", "chunk", "entry", "state", "last"], ["pos"], _repair_chunks, _PIECES)
    whole = _by(pieces, ["conv"], ["chunk"], _whole, _WHOLE).alias("w")
    totals = joined.where("last = 1").alias("t")
    found = totals.join(whole, F.col("t.conv").eqNullSafe(F.col("w.conv")))
    return found.select(F.col("t.conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation; null roles and texts are one space, null turns come first."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


#: The same rows by a recursive query that carries audits and texts; the checksum is that of CRC-32, bit by bit.
OP13_SQL = r"""
with recursive named as (
    select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
hashed as (
    select *, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1))))) % 20 fate
    from named),
damaged as (
    select conv_id, turn, case when fate = 4 then 'user' else role end role,
        case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end text, unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) copy
    from hashed),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) pos, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) ending from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by pos) nth, lag(role[1]) over (partition by conv_id order by pos) || role[1] pair from placed),
turns as (select *, case when ending = '' then 1 when nth > 1 then 2 when ending not in ('.', '!', '?') then 3 else 0 end fault from seen),
facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) illegal, count(*) last
    from turns group by conv_id),
runs(state, run, mid, price, made) as (values
    (0, '', 0, 0, []::varchar[]), (0, 'I', 2, 5, ['user:']), (0, 'II', 3, 10, ['user:', 'assistant:']), (1, '', 1, 0, []), (1, 'I', 2, 5, ['user:']), (1, 'II', 3, 10, ['user:', 'assistant:']),
    (2, '', 2, 0, []), (2, 'I', 3, 5, ['assistant:']), (2, 'II', 2, 10, ['assistant:', 'user:']), (3, '', 3, 0, []), (3, 'I', 2, 5, ['user:']), (3, 'II', 3, 10, ['user:', 'assistant:'])),
steps(mid, initial, edit, target, price, role) as (values
    (0, '', 'D', 0, 2, ''), (1, '', 'D', 1, 2, ''), (2, '', 'D', 2, 2, ''), (3, '', 'D', 3, 2, ''),
    (0, '', 'R', 2, 1, 'user'), (1, '', 'R', 2, 1, 'user'), (2, '', 'R', 3, 1, 'assistant'), (3, '', 'R', 2, 1, 'user'),
    (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''), (3, 'u', 'K', 2, 0, '')),
paths(conv_id, pos, state, cost, audit, made) as (
    select distinct conv_id, 0::bigint, 0, 0::bigint, '', []::varchar[] from turns
    union all
    select p.conv_id, t.pos, s.target, p.cost + r.price + s.price + case when s.edit <> 'D' and t.fault = 3 then 5 else 0 end cost, p.audit || r.run || s.edit,
        list_concat(p.made, r.made, case s.edit when 'D' then [] when 'R' then [s.role || ':' || t.text] else [t.role || ':' || t.text] end)
    from paths p join turns t on t.conv_id is not distinct from p.conv_id and t.pos = p.pos + 1 join runs r on r.state = p.state
        join steps s on s.mid = r.mid and (s.initial = '' or s.initial = t.role[1]) and (s.edit = 'D' or t.fault not in (1, 2))
    qualify row_number() over (partition by p.conv_id, s.target order by p.cost + r.price + s.price + case when s.edit <> 'D' and t.fault = 3 then 5 else 0 end, p.audit || r.run || s.edit) = 1),
ended as (
    select f.*, p.cost + case p.state when 1 then 10 when 2 then 5 else 0 end cost, p.audit || case p.state when 1 then 'II' when 2 then 'I' else '' end audit,
        list_concat(p.made, case p.state when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end) made
    from paths p join facts f on f.conv_id is not distinct from p.conv_id and f.last = p.pos
    qualify row_number() over (partition by p.conv_id order by p.cost + case p.state when 1 then 10 when 2 then 5 else 0 end, p.audit || case p.state when 1 then 'II' when 2 then 'I' else '' end) = 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
    coalesce(cost, 0)::bigint cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(made, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join ended e on e.conv_id is not distinct from c.conv_id
"""
