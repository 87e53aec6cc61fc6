"""URL filter over a sorted digest array.

Rules (host, path prefix, verdict) become keys ``host + path``.  Their 64-bit xxhash digests are kept in one sorted array
in a file, beside offsets into the stored full strings.  Every executor gets the file once (``SparkContext.addFile``)
and maps it into memory, so that its Python workers share the pages.  A URL gives a few candidate keys (each suffix of
its host at a dot, with each prefix of its path that is as long as some rule's path); a batch of candidates is probed
with one vectorised binary search, and every digest that is found is confirmed on the stored string.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, flat_bytes, kept_columns, table

_SPLIT = re.compile(r".*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty without ``://``."""
    m = _SPLIT.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42) - (1 << 63)


class DigestArray:
    """Memory-mapped sorted digests with their strings and verdicts."""

    def __init__(self, path: str):
        with open(f"{path}", "rb") as f:
            head = json.loads(f.readline())
            at = f.tell()
        n = head["n"]
        self.verdicts, self.lengths, self.n = head["verdicts"], head["path_lengths"], n
        parts = []
        for kind, count in (("<i8", n), ("<i8", n + 1), ("<i4", n), ("u1", head["bytes"])):
            size = np.dtype(kind).itemsize * count
            parts.append(np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind))
            at += size
        self.keys, self.offsets, self.codes, self.strings = parts

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """For every key its entry's index, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not self.n:
            return found
        wanted = np.fromiter(map(digest, keys), np.int64, len(keys))
        at = np.searchsorted(self.keys, wanted, "left")
        for i in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == wanted)):
            k = int(at[i])
            while k < self.n and self.keys[k] == wanted[i]:  # entries of one digest: the stored string decides
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


def build_digest_array(rules: DataFrame, path: str) -> None:
    """Write the array's file at a local ``path`` of the driver.

    Spark sorts the rules by digest, and executors pack them into column blocks; the driver appends the blocks one
    partition at a time, so its memory holds one partition's bytes and it touches no single rule.  Null hosts or paths
    count as empty; of equal keys the smallest verdict stays; an empty list gives an empty array.
    """
    n_parts = max(1, int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    host, prefix = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    flipped = F.xxhash64("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order, as signed numbers
    entries = rules.groupBy(F.concat(host, prefix).alias("key"), F.length(prefix).alias("path_length")).agg(F.min("verdict").alias("verdict"))
    facts = entries.agg(F.array_sort(F.collect_set("verdict")).alias("verdicts"), F.array_sort(F.collect_set("path_length")).alias("lengths")).first()
    verdicts = list(facts["verdicts"])
    code = F.array_position(F.lit(verdicts).cast("array<string>"), F.col("verdict")).cast("int") - 1
    ordered = entries.withColumns({"digest": flipped, "code": code}).repartitionByRange(n_parts, "digest").sortWithinPartitions("digest", "key")

    def pack(batches):
        for batch in batches:
            raw, offsets = flat_bytes(batch.column(1))
            columns = [batch.column(0).to_numpy().astype("<i8").tobytes(), np.diff(offsets).astype("<i8").tobytes(), batch.column(2).to_numpy().astype("<i4").tobytes(), raw.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["keys", "sizes", "codes", "strings"])

    blocks = ordered.select("digest", "key", "code").mapInArrow(pack, "keys binary, sizes binary, codes binary, strings binary")
    names = [f"{path}.{x}" for x in ("keys", "offsets", "codes", "strings")]
    files = [open(x, "wb") for x in names]
    files[1].write(np.zeros(1, "<i8").tobytes())
    n = total = 0
    for block in blocks.toLocalIterator():
        ends = total + np.cumsum(np.frombuffer(block["sizes"], "<i8"))
        for f, data in zip(files, (block["keys"], ends.astype("<i8").tobytes(), block["codes"], block["strings"]), strict=True):
            f.write(data)
        n, total = n + len(ends), int(ends[-1]) if len(ends) else total
    for f in files:
        f.close()
    with open(path, "wb") as out:
        out.write(json.dumps({"n": n, "bytes": total, "verdicts": verdicts, "path_lengths": list(facts["lengths"])}).encode() + b"\n")
        for name in names:
            with open(name, "rb") as f:
                shutil.copyfileobj(f, out)
            os.remove(name)


_MAPPED: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    if name not in _MAPPED:
        _MAPPED[name] = DigestArray(SparkFiles.get(name))
    return _MAPPED[name]


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Columns ``keep``, then host, path, rule and verdict of every row.

    A rule fits its host and all subdomains when the path starts with the rule's; of the rules that fit, the longest
    wins (of equal length that with the longer host), and its verdict stands.  Where the array has no rule, ``rule`` is
    null and the verdict is ``default``.  A null url or one without ``://`` has empty host and path; repeated rows give
    repeated results; an empty rule list leaves every verdict at ``default``, an empty page list gives no row; a column
    of ``keep`` that has a result's name goes out with ``_input`` added.  One pass, no shuffle of the pages.
    """
    spark = pages.sparkSession
    name = f"digests-{uuid.uuid4().hex}.bin"
    # the driver's copy, which executors fetch while the session lasts
    folder = tempfile.mkdtemp(prefix="digests-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    build_digest_array(rules, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    columns, names, schema = kept_columns(pages, keep, ["host", "path", "rule", "verdict"])

    def run(batches):
        array = _mapped(name)
        for batch in batches:
            hosts, paths, keys, owner, rank = [], [], [], [], []
            for i, value in enumerate(batch.column(len(names)).to_pylist()):
                host, path = split_url(value)
                hosts.append(host)
                paths.append(path)
                at = 0
                while host and at >= 0:
                    suffix = host[at:]
                    for length in array.lengths:
                        if length > len(path):
                            break
                        keys.append((suffix + path[:length]).encode())
                        owner.append(i)
                        rank.append((len(suffix) + length, len(suffix)))
                    at = host.find(".", at) + 1 or -1
            best: dict[int, tuple[tuple[int, int], int]] = {}
            found = array.probe(keys)
            for j in np.flatnonzero(found >= 0):
                best[owner[j]] = max(best.get(owner[j], ((-1, -1), -1)), (rank[j], int(found[j])))
            rule, verdict = [None] * len(hosts), [default] * len(hosts)
            for i, (_, k) in best.items():
                rule[i] = array.strings[array.offsets[k] : array.offsets[k + 1]].tobytes().decode()
                verdict[i] = array.verdicts[array.codes[k]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], names=[*names, "host", "path", "rule", "verdict"])

    return pages.select(*columns, column(url)).mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string".removeprefix(", "))


#: Fixed values of the query: the rules it applies.
OP3_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; null urls have empty hosts, repeated rows repeat."""
    rules = spark.createDataFrame(OP3_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^((?s:.*?))://([^/?#]*)([^?#]*)', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^((?s:.*?))://([^/?#]*)([^?#]*)', 3), '') AS path FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path,
         (SELECT max_by({'rule': rh || rp, 'verdict': rv}, length(rh || rp) * 1000 + length(rh)) FROM r
          WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
