"""Repair of conversations against an exhaustive search and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from rippleframe.llm import conversations
from rippleframe.llm.conversations import OP13_SQL, op13_repair, repair_conversations

SMALL = "/root/testdata/sf0.001"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        named = lambda x: " " if x is None else str(x)
        role, text = named(role), named(text)
        fate = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own.extend([(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Dijkstra over (cost, audit) with the roles so far, no macro, state or rank: least (cost, audit) that fits SHAPE."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(rows) and SHAPE.match(roles):
            return cost, audit, "\n".join(made)
        # what may still follow depends on the place, the last roles and the audit's own end alone
        key = (i, roles[-1:], roles[:1] == "s", bool(roles))
        if (key, cost, audit) in done:
            continue
        done.add((key, cost, audit))
        options = [(5, "I", 0, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append((2, "D", 1, "", None))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                options += [(1 + extra, "R", 1, r, f"{r}:{text}") for r in ("user", "assistant")]
                if role[:1] in ("s", "u", "a"):
                    options.append((extra, "K", 1, role, f"{role}:{text}"))
        for more, edit, step, role, line in options:
            grown = roles + role[:1]
            if re.match(r"(s?(ua)*u?)\Z", grown) and cost + more <= 2 * len(rows):
                heapq.heappush(heap, (cost + more, audit + edit, i + step, grown, made if line is None else (*made, line)))
    raise AssertionError("deleting every row always fits")


def expected(rows):
    out = {c: None for c, *_ in rows}
    for conv, own in damaged(rows).items():
        kinds = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = cheapest(own, kinds)
        out[conv] = (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return set(out.values())


def conversation(rng, conv, n):
    roles = ["user", "assistant", "assistant", "system", "user", "tool", "", None]
    texts = ["Yes.", "No!", "Why", "Why?", "", " \n", "ok. \t", None, "\xa0", "日本.", "."]
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, rng.choice(roles), rng.choice(texts)) for i in range(n)]


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [8192, 2])
def test_repairs_by_exhaustive_search(spark, chunk, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [r for conv in range(120) for r in conversation(rng, conv, rng.randint(1, 7))] + [(None, 0, "user", "Hi."), (None, None, None, None)]
    got = {tuple(r) for r in repair_conversations(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect()}
    assert got == expected(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 16)
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"Turn {i}.", f"Turn {i}."])) for i in range(600)]
    docs = spark.createDataFrame(rows, COLUMNS)
    (got,) = repair_conversations(docs).collect()
    monkeypatch.setattr(conversations, "CHUNK", 1 << 33)
    docs.coalesce(1).createOrReplaceTempView("one_conversation")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (whole,) = repair_conversations(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    con.register("conversations", docs.toPandas())
    (want,) = con.execute(OP13_SQL).fetchall()
    assert tuple(got) == tuple(whole) == want


def test_edge_tables(spark):
    assert repair_conversations(spark.createDataFrame([], COLUMNS)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    twice = [(gone, 0, "user", "Hi.", 1, "x"), (1, None, "a", "b" * 200_000 + "?", 2, None), (1, None, "a", "b" * 200_000 + "?", 2, None)]
    got = {r["conv_id"]: r for r in repair_conversations(spark.createDataFrame(twice, COLUMNS + ", copies int, pos string")).collect()}
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(got[1])} == expected([r[:4] for r in twice[1:]])


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    want = con.execute(OP13_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, op13_repair(spark, SMALL).select(*names).collect())) == sorted(want.fetchall())
