"""Pivot-partitioned phrases against brute force and SQL."""

import collections
import random
import re

import duckdb
import pytest

from rippleframe.llm import collocations
from rippleframe.llm.collocations import OP12_SQL, mine_phrases, op12_collocations, score_phrases

SMALL = "/root/testdata/sf0.001"


def brute(rows, most, least):
    counts, sizes = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und", " ".join(words[i : i + m])] += 1
    return {k: v for k, v in counts.items() if v >= least}, sizes


def brute_scores(counts, sizes, covered, top):
    kept = collections.defaultdict(list)
    for (lang, phrase), a in counts.items():
        words = phrase.split(" ")
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(x == lang and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} " and 100 * f >= covered * a for (x, p), f in counts.items())
        if not inside:
            kept[lang].append((-score, -a, phrase.encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, found in kept.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = []
    for _ in range(150):
        weights = [1 / (i + 1) for i in range(12)]
        words = rng.choices(["The", "of", "new", "york", "CITY", "ünd", "\x0bx", "a\x1fb", "ha", "ha", "z\xa0z", "日本"], weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n"]) for w in words)
        made.append((rng.choice([text, text, None, ""]) if rng.random() < 0.1 else text, rng.choice(["en", "en", "de", None])))
    return made + [("ha " * 3000, "en"), ("New York City " * 40, "de"), (None, None)]


@pytest.mark.parametrize("setting", [{}, {"bins": 3}, {"hot_share": 1e-3}])
def test_phrases_by_brute_force(spark, rows, setting, monkeypatch):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    counts, sizes = brute(rows, 4, 5)
    grams, n = mine_phrases(docs, min_count=5, **setting)
    assert {(r["lang"], r["phrase"]): r["f"] for r in grams.collect()} == counts
    assert {r["lang"]: r["n"] for r in n.collect()} == sizes
    got = {tuple(r) for r in score_phrases(grams, n, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_scores(counts, sizes, 80, 40)


def test_small_pieces_of_text(rows):
    texts = [t for t, _ in rows if t]
    old = collocations.TEXT_CHARS
    try:
        collocations.TEXT_CHARS = 50
        for t in texts[:40]:
            parts = collocations._cut(t)
            assert "".join(parts) == t and all(len(p) <= 50 or not any(c in p[50:-1] for c in ".,;:!?\n\r\x0b\x0c") for p in parts)
    finally:
        collocations.TEXT_CHARS = old


@pytest.mark.parametrize("held", [400_000, 1])
@pytest.mark.parametrize("parts", [1, 3])
def test_runs_of_fragments_of_any_length(held, parts, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD", held)
    pivot = lambda w: int(collocations.mix(collocations._word_values(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) ^ collocations._lang_values(["x"])).view(np.int64)[0])
    rows = [("a b a", 2, b"b"), ("b a", 3, b"b"), ("a", 1, b"b"), ("c a", 1, b"c"), ("c b", 2, b"c"), ("dd a", 9, b"dd"), ("dd a", 1, b"dd")]
    table = pa.table({"lang": ["x"] * 7, "pivot": [pivot(w) for *_, w in rows], "part": [0] * 7, "parts": [parts] * 7, "fragment": [f for f, *_ in rows], "weight": [n for _, n, _ in rows]})
    for size in (1, 2, 7):
        total, miner = collections.Counter(), collocations._Miner(3, 4)
        made = [t for i in range(0, 7, size) for t in miner.mine(table.slice(i, size))]
        for r in pa.concat_tables([t for t in [*made, miner.finish()] if t is not None]).to_pylist():
            total[r["phrase"]] += r["f"]
        assert {k: v for k, v in total.items() if v >= 4} == {"b": 5, "b a": 5, "dd": 10, "dd a": 10}
        assert held == 1 or parts > 1 or not any(v < 4 for v in total.values())


def test_empty_and_foreign_columns(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert score_phrases(*mine_phrases(none)).collect() == []
    docs = spark.createDataFrame([("a b", None, 1, "q")] * 30, "text string, lang string, pivot int, fragment string")
    assert [tuple(r) for r in score_phrases(*mine_phrases(docs)).collect()] == [("und", 1, "a b", 30, 30, 30, 60, 1000000)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = op12_collocations(spark, SMALL)
    want = con.execute(OP12_SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
