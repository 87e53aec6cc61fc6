"""Writers of reports: text trees, record kinds, spilled fragments and pages that are published one by one."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the record kinds of each report -------------------------------------------------------------------
TREE_KINDS = ["dependency-ranges", "dependency-index", "dependency-rows", "module-dependency-catalog", "class-conflicts", "class-sources", "dependency-trees"]
TREE_DIFF_KINDS = ["module-summaries", "module-dependencies", "dependencies", "rows", "chain-rows", "trees"]
AFFECTED_PATH_KINDS = ["index", "source-index", "rows", "paths", "methods", "members", "dependencies", "diffs"]
DIAGNOSTIC_KINDS = ["configuration", "modules"]
# ---------------------------------------------------------------------------------------------------------------------


def text_tree(nodes: DataFrame) -> DataFrame:
    """(module, line_no, line) of each module's dependency tree from (module, ord, depth, label) in preorder.

    Whether a level has a later sibling is known when lines are met from the last to the first.
    """

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        later: list[bool] = []
        lines = []
        for d, label in zip(reversed(pdf["depth"].tolist()), reversed(pdf["label"].tolist()), strict=True):
            later += [False] * (d + 1 - len(later))
            lines.append(label if d == 0 else "".join("|  " if later[k] else "   " for k in range(1, d)) + ("+- " if later[d] else "\\- ") + label)
            later = [*later[:d], True]
        return pd.DataFrame({"module": pdf["module"].tolist(), "line_no": range(len(lines)), "line": lines[::-1]})

    return nodes.groupBy("module").applyInPandas(render, f"module {nodes.schema['module'].dataType.simpleString()}, line_no long, line string")


def write_records(rows: DataFrame, path: str, kind: str) -> None:
    """One folder for a record kind, replaced as a whole, one JSON record a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/kind={kind}")


def _write_report(kinds: dict[str, DataFrame], path: str, known: list[str]) -> None:
    unknown, missing = sorted(set(kinds) - set(known)), sorted(set(known) - set(kinds))
    if unknown or missing:
        raise ValueError(f"unknown kinds {unknown}, missing kinds {missing}")
    for kind in known:
        write_records(kinds[kind], path, kind)


def write_tree_report(kinds: dict[str, DataFrame], path: str) -> None:
    """The record kinds of one tree, all of them."""
    _write_report(kinds, path, TREE_KINDS)


def write_tree_diff_report(kinds: dict[str, DataFrame], path: str) -> None:
    """The record kinds of a difference of two trees."""
    _write_report(kinds, path, TREE_DIFF_KINDS)


def write_affected_path_report(kinds: dict[str, DataFrame], path: str) -> None:
    """The record kinds of the affected paths."""
    _write_report(kinds, path, AFFECTED_PATH_KINDS)


def write_diagnostics(configuration: DataFrame, modules: DataFrame, path: str) -> None:
    """Configuration and modules; there is one configuration."""
    if configuration.count() != 1:
        raise ValueError("diagnostics have one configuration")
    _write_report({"configuration": configuration, "modules": modules}, path, DIAGNOSTIC_KINDS)


def read_records(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    return spark.read.text(f"{path}/kind={kind}").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def script_safe(text: Column) -> Column:
    """JSON that may stand inside a script element: no angle brackets, ampersands or line separators."""
    for mark, code in (("<", "u003c"), (">", "u003e"), ("&", "u0026"), ("\u2028", "u2028"), ("\u2029", "u2029")):
        text = F.replace(text, F.lit(mark), F.lit("\\" + code))
    return text


class SpillStore:
    """Fragments of rows that wait outside memory; a fragment counts once Spark has marked its write as complete."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self._path).getFileSystem(spark._jsc.hadoopConfiguration())

    def spill(self, prefix: str, rows: DataFrame) -> str:
        name = f"{prefix}-{uuid.uuid4().hex}"
        rows.write.json(f"{self._path}/{name}")
        return name

    def read(self, name: str, schema) -> DataFrame:
        if not self._fs.exists(self._fs_path(f"{self._path}/{name}/_SUCCESS")):
            raise ValueError(f"fragment {name} is not complete")
        return self._spark.read.schema(schema).option("mode", "FAILFAST").json(f"{self._path}/{name}")

    def discard(self, prefix: str) -> int:
        found = [s.getPath() for s in self._fs.globStatus(self._fs_path(f"{self._path}/{prefix}-*")) or ()]
        for p in found:
            self._fs.delete(p, True)
        return len(found)


class Publication:
    """An index that says RUNNING, pages that replace their own reactor alone, and the index with the final state.

    Every index is a new numbered file that is written aside and renamed into its place; readers take the last one, so
    they meet a whole index at any time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self._path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._index("RUNNING")

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.globStatus(self._fs_path(f"{self._path}/index/state-*.json")) or ()]
        return sorted(int(n.removeprefix("state-").removesuffix(".json")) for n in names)

    def _index(self, state: str) -> None:
        known = self._numbers()
        aside = self._fs_path(f"{self._path}/index/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"state": state}), "utf-8"))
        out.close()
        target = self._fs_path(f"{self._path}/index/state-{(known[-1] if known else 0) + 1:09d}.json")
        if not self._fs.rename(aside, target):
            raise ValueError("another writer has published this index")
        for old in known[:-1]:  # a reader may just have found the last one
            self._fs.delete(self._fs_path(f"{self._path}/index/state-{old:09d}.json"), False)

    def publish(self, reactor: str, rows: DataFrame) -> None:
        """A page is there as a whole or not at all; pages of other reactors stay whatever happens."""
        page = rows.withColumn("reactor", F.lit(reactor))
        page.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reactor").parquet(f"{self._path}/pages")

    def finish(self, state: str) -> None:
        self._index(state)

    def state(self) -> str:
        return json.loads(self._spark.read.text(f"{self._path}/index/state-{self._numbers()[-1]:09d}.json", wholetext=True).first()["value"])["state"]

    def pages(self, schema) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._path}/pages")
