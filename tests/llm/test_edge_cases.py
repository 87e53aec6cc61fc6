"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; queries against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from rippleframe.llm import bpe, compaction, decontaminate, html_text, near_dedup, pii, quality, repeats, url_filter, warc
from rippleframe.llm._common import materialize, new_path, table

SMALL = "/root/testdata/sf0.001"


def small(name):
    return ds.dataset(f"{SMALL}/{name}.parquet").to_table().to_pylist()


def prose(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


LONG = prose(300_000)


# --- steps -----------------------------------------------------------------------------------------------------------
def test_steps_are_deleted_and_settings_come_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    first = materialize(spark.range(5).toDF("id"), "first")
    second = materialize(first.where("id > 1"), "second", [first])
    assert second.count() == 3 and spark.conf.get(key, None) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(first._step_path).count()


# --- 2 compaction ----------------------------------------------------------------------------------------------------
def test_compaction_keeps_any_rows(spark):
    rows = [(None, "a", 1, "x"), (1, None, 2, None), (1, None, 2, None), (2, "", None, "m"), (3, LONG, 3, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _run int, `shard.id` string")
    store = compaction.ShardStore(spark, new_path(spark, "store"))
    assert store.compact() == 0 and store.read(frame.schema).count() == 0
    for _ in range(4):
        store.append(frame.repartition(3))
    assert store.compact(target=64 << 20, min_run=2, fan=1000) > 4
    back = store.read(frame.schema)
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in frame.collect() * 4)


def test_only_similar_shards_merge():
    store, shard = object.__new__(compaction.ShardStore), compaction.Shard
    small = [shard(f"s{i}", 20, 1) for i in range(5)]
    middle = [shard(f"m{i}", 300, 1) for i in range(3)]
    large = [shard("l", 600, 1)]
    assert store.plan(small + middle + large, 1000, 4, 4) == [small]  # three middle ones wait, a large one rests
    runs = store.plan([shard(f"s{i}", 200, 1) for i in range(12)], 1000, 4, 4)
    assert [sum(s.bytes for s in r) for r in runs] == [1000, 1000]


def test_compaction_query_by_brute_force(spark):
    """Every document is in the shard that the query names, with its bytes, and that shard holds so many rows."""
    docs = {d["doc_id"]: d for d in small("documents")}
    rows = compaction.op2_compaction(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    base = [p for p in spark.sparkContext._jvm.java.io.File(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).listFiles() if p.getName().startswith("shards-")]
    root = max(base, key=lambda p: p.lastModified()).getPath()
    held = collections.defaultdict(dict)
    for r in rows:
        assert r["n_bytes"] == (None if docs[r["doc_id"]]["text"] is None else len(docs[r["doc_id"]]["text"].encode()))
        held[r["shard"]][r["doc_id"]] = r
    for shard, of in held.items():
        stored = ds.dataset(f"{root}/data/{shard}").to_table().to_pylist()
        assert {d["doc_id"]: d for d in stored} == {i: docs[i] for i in of} and {r["shard_rows"] for r in of.values()} == {len(stored)}


# --- 3 url filter ----------------------------------------------------------------------------------------------------
def test_urls_of_any_kind(spark):
    rules = spark.createDataFrame([("a.org", "/x", "block"), ("a.org", "/x", "allow"), (None, None, "allow"), ("long.org", "/" + "y" * 5000, "block"), *[(f"h{i}.net", "/", f"v{i}") for i in range(300)]], "host string, path string, verdict string")
    urls = ["http://a.org/xy", "http://a.org/xy", "http://h299.net/", "http://long.org/" + "y" * 300_000, "http://" + "s." * 2000 + "a.org/x", "://", None]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules, keep=("page_id", "verdict")).collect()}
    assert {r["verdict_input"] for r in got.values()} == {"h"}
    # of equal keys the smallest verdict stays
    assert [got[i]["verdict"] for i in range(7)] == ["allow", "allow", "v299", "block", "allow", "allow", "allow"] and got[4]["rule"] == "a.org/x"
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# --- 4 decontamination -----------------------------------------------------------------------------------------------
def least_edits(item, texts):
    """Of every text, the edits of the best copy of ``item`` anywhere in it: one row for each of the item's characters."""
    owner = np.concatenate([np.full(len(t) + 1, i) for i, t in enumerate(texts)])
    codes = np.concatenate([np.append(-1, np.frombuffer(t.encode("utf-32-le"), "<i4").astype(np.int64)) for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    place = np.arange(len(codes)) + owner * 10_000_000  # no running minimum crosses from one text into the next
    row = np.zeros(len(codes), np.int64)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), "<i4")):
        kept = np.append(0, row[:-1]) + (codes != c)
        kept[first] = 1 << 40
        best = np.minimum(kept, row + 1)
        best[first] = i + 1
        row = np.minimum.accumulate(best - place) + place
    return np.minimum.reduceat(row, first)


def test_decontamination_query_by_brute_force(spark):
    docs = [d for d in small("documents")]
    texts = [decontaminate.normalise(d["text"]) for d in docs]
    got = {r["doc_id"]: r for r in decontaminate.op4_decontaminate(spark, SMALL).collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    named = {i for r in got.values() for i in r["item_ids"]}
    items = {b["item_id"]: decontaminate.normalise(b["text"]) for b in small("benchmark")}
    chosen = sorted(named)[:4] + sorted(set(items) - named)[:2]
    for i in chosen:
        budget = min(int(decontaminate.EDIT_SHARE * len(items[i])), (len(items[i]) - decontaminate.Q) // decontaminate.Q)
        expected = {d["doc_id"] for d, n in zip(docs, least_edits(items[i], texts), strict=True) if n <= budget}
        assert {d for d, r in got.items() if i in r["item_ids"]} == expected
    assert all(r["contaminated"] == (not r["kept"]) == (r["n_items"] > 0) and r["n_items"] == len(r["item_ids"]) for r in got.values())


def test_decontamination_of_any_rows(spark):
    item = prose(30, 7)
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item + " " + prose(4, 8)), (None, item), (3, None), (4, "")], "item_id int, text string")
    docs = spark.createDataFrame([(1, LONG[:900_000] + " " + item + " " + LONG[:900_000], 1), (2, None, 1), (3, "", 2), (4, item, 3), (4, item, 3), (None, "x " + item, 4)], "doc_id int, text string, matches int")
    for chars in (10_000_000, 100):
        rows = decontaminate.find_items(docs, benchmark, keep=("doc_id", "matches"), block_chars=chars).collect()
        assert {r["matches_input"] for r in rows} == {1, 2, 3, 4} and len(rows) == 6
        assert sorted((str(r["doc_id"]), sorted({m["item_id"] for m in r["matches"]})) for r in rows) == [("1", [1]), ("2", []), ("3", []), ("4", [1]), ("4", [1]), ("None", [1])]
    assert decontaminate.find_items(docs.limit(0), benchmark).count() == 0


# --- 5 near duplicates -----------------------------------------------------------------------------------------------
def test_one_id_on_several_texts(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(7, a), (7, b), (3, b + " more"), (9, a), (9, c), (8, LONG), (2, LONG + " end"), (None, a), (None, a), (5, None), (5, None), (5, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, kept int")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.link_near_duplicates(frame).collect())
    # 7 stands on two texts: one is the least of its copies, the other a copy of 3
    assert got == collections.Counter([(7, 7, True), (7, 3, False), (3, 3, True), (9, 7, False), (9, 9, True), (8, 2, False), (2, 2, True), (None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (5, 5, True)])
    kept = collections.Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(frame).collect())
    assert kept == collections.Counter([(7, a), (3, b + " more"), (9, c), (2, LONG + " end"), (None, a), (None, a), (5, None), (5, "")])


# --- 6 repeats -------------------------------------------------------------------------------------------------------
def test_repeats_of_a_text_of_many_megabytes(spark):
    block = prose(60, 9)
    text = LONG + block + LONG[::-1] + block + prose(500_000, 4)
    row = repeats.cut_repeats(spark.createDataFrame([(text, 1), (None, 2)], "text string, kept int"), with_bytes=False).orderBy(F.desc("n_bytes")).first()
    n = len(block)
    assert row["n_bytes"] == len(text) and row["n_spans"] == 2 and 2 * n <= row["n_removed"] <= 2 * n + 8


# --- 7 archive -------------------------------------------------------------------------------------------------------
def test_archive_of_any_rows(spark):
    pages = spark.createDataFrame([(2, "u", LONG, 1), (1, None, LONG, 1), (1, None, LONG, 1), (None, "v", LONG, 2), (5, "w\r\nWARC-Type: x", "", 3)], "page_id long, url string, html string, digest int")
    path = new_path(spark, "archive")
    warc.write_archive(pages, path)
    rows = warc.read_archive(spark, path).collect()
    assert sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"])) for r in rows) == [("1", "response", "None"), ("1", "response", "None"), ("2", "revisit", "1"), ("5", "response", "None"), ("None", "revisit", "1")]
    other = new_path(spark, "archive")
    warc.write_archive(pages.limit(0), other)
    assert warc.read_archive(spark, other).count() == 0
    named = new_path(spark, "archive")
    warc.write_archive(pages.select(F.concat(F.lit("a b/"), "page_id").alias("page_id"), "url", "html").where("page_id is not null"), named)
    assert {(r["record_id"], r["refers_to"]) for r in warc.read_archive(spark, named).collect()} == {("a b/1", None), ("a b/2", "a b/1"), ("a b/5", None)}


# --- 8 quality -------------------------------------------------------------------------------------------------------
def test_quality_of_any_rows(spark):
    rows = [(1, prose(60), 5, "h"), (1, prose(60), 5, "h"), (None, prose(60), None, None), (3, None, 1, ""), (4, "", 1, ""), (5, LONG, 2, "x")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_words int, hashes string")
    none = spark.createDataFrame([], "doc_id int")
    got = quality.judge_quality(frame, none).collect()
    assert got[0].__fields__[:4] == ["doc_id", "text", "n_words_input", "hashes"]
    assert sorted((str(r["doc_id"]), r["n_words"], str(r["n_words_input"]), r["kept"]) for r in got) == [("1", 60, "5", True), ("1", 60, "5", True), ("3", 0, "1", False), ("4", 0, "1", False), ("5", 300_000, "2", True), ("None", 60, "None", True)]
    assert quality.judge_quality(frame, none).where("kept").count() == 4
    assert quality.base_measures(frame).columns[:4] == ["doc_id", "text", "n_words_input", "hashes"] and quality.base_measures(frame.limit(0)).count() == 0


def test_a_filter_on_the_verdict_measures_once(spark):
    docs = table(spark, SMALL, "documents")
    kept = quality.judge_quality(docs, quality.trusted_ids(table(spark, SMALL, "labels"))).where("kept").select(*docs.columns)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(coalesce\(", plan)) <= 3  # words and lines, each text once


# --- 9 tokens --------------------------------------------------------------------------------------------------------
def test_tokens_of_any_rows(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (2, None, None), (3, LONG[:400_000], 2)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    got = bpe.encode_documents(frame, keep=("doc_id", "ids")).collect()
    assert [(r["doc_id"], r["ids_input"]) for r in got] == [(1, 1), (1, 1), (2, None), (3, 2)] and got[0]["ids"] == got[1]["ids"] and got[3]["decoded"] == rows[3][1] and got[2]["decoded"] == ""
    assert bpe.encode_documents(frame, decode=False).columns == ["doc_id", "ids"] and bpe.encode_documents(frame.limit(0)).count() == 0


# --- 10 html ---------------------------------------------------------------------------------------------------------
def test_pages_of_any_kind(spark):
    rows = [(1, None, "<article><p>" + LONG + "</p></article>", "t"), (1, None, "<article><p>" + LONG + "</p></article>", "t"), (2, "http://h/", "<p>" + LONG, None), (3, "u", "<" * 50_000, "t"), (None, None, "", "t"), (5, "u", None, "t")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string, text string"), keep=("page_id", "text")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", len(LONG)), ("1", len(LONG)), ("2", len(LONG)), ("3", 50_000), ("5", 0), ("None", 0)]
    assert {r["text_input"] for r in got} == {"t", None}


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_of_any_rows(spark):
    import corpus_pipeline as P

    held = {r["doc_id"] for r in decontaminate.op4_decontaminate(spark, SMALL).collect() if r["contaminated"]}
    trusted = {r["doc_id"] for r in quality.trusted_ids(table(spark, SMALL, "labels")).collect()}
    good = [r["doc_id"] for r in quality.op8_quality(spark, SMALL).collect() if r["kept"] and r["doc_id"] in trusted - held]
    texts = {d["doc_id"]: d["text"] for d in small("documents")}
    text, long = texts[good[0]], "\n".join(texts[i] for i in sorted(good)[5:45])
    # odd rows beside the documents, whose counts decide what is good
    rows = [(good[0], text, "en", "odd", 1), (good[0], text, "en", "odd", 1), (None, text, None, "odd", None), (900_002, None, "en", "odd", 0), (900_003, "", "en", "odd", 0), (900_004, long, "en", "odd", 1)]
    docs = table(spark, SMALL, "documents")
    frame = docs.where(F.col("doc_id") != good[0]).unionByName(spark.createDataFrame(rows, docs.select(*P.COLUMNS).schema)).withColumn("matches", F.lit("x"))
    # the first stage drops null and empty texts, the second keeps one of equal rows; rows without an id stay
    left = [[good[0], good[0], 900_004, None], [good[0], 900_004, None]]
    for k, (name, stage) in enumerate(P.STAGES):
        frame = materialize(stage(spark, frame, SMALL), name)
        odd = [r["doc_id"] for r in frame.where("source = 'odd'").select("doc_id").collect()]
        assert sorted(odd, key=lambda x: (x is None, x)) == left[min(k, 1)], name
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_surrogate_clashes_in_names(spark):
    rows = pii.replace_pii(spark.createDataFrame([("a@b.com", "_x", 1)], "text string, _text string, N_Entities int"), "k")
    assert rows.columns == ["text", "_text", "N_Entities_input", "n_entities"] and rows.first()["_text"] == "_x"
