"""Versioned result sets with one commit file, and a stage ledger for pipelines.

A result set is a folder with ``_versions`` (data) and ``_commits`` (small JSON files, numbered). Tables are
written into a version's folder first; only then a commit file appears, by one rename, that names the folder of every table.
Readers take the last commit, so they see the last complete version whatever a lost driver left behind. Two writers
cannot take the same number: the one that comes second adds its tables to the other's and takes the next number.

A ``Run`` is a version that is written stage by stage. Its name is a digest of inputs and parameters, and every finished stage
leaves a mark, also by rename; a rerun of the same work starts after the last mark.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qforge.session import path_exists, remove_path

KEEP = 3


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, path: str, value: dict) -> bool:
    """A small JSON file that appears at once or not at all; False when there is one already."""
    jvm, fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if not fs.exists(target) and fs.rename(tmp, target):
        return True
    fs.delete(tmp, False)
    return False


def load(spark: SparkSession, path: str) -> dict:
    jvm, fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def names(spark: SparkSession, folder: str, ending: str = "") -> list[str]:
    """Names in a folder, sorted; none when it is missing."""
    _, fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for n in (str(s.getPath().getName()) for s in fs.listStatus(p)) if n.endswith(ending))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


class ResultSet:
    """Result tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[str]:
        return names(self.spark, f"{self.root}/_commits", ".json")

    def current(self) -> dict[str, dict]:
        """name -> {path, format} of the last complete version; empty before the first."""
        done = self.commits()
        return load(self.spark, f"{self.root}/_commits/{done[-1]}")["tables"] if done else {}

    def commit(self, tables: dict[str, dict], whole: bool = False) -> int:
        """Make tables visible together; ``whole``: they replace all others, too. Returns the number of the commit."""
        while True:
            done = self.commits()
            number = int(done[-1][:-5]) + 1 if done else 1
            every = tables if whole else {**self.current(), **tables}
            if publish(self.spark, f"{self.root}/_commits/{number:012d}.json", {"tables": every}):
                return number

    def write(self, df: DataFrame, name: str, fmt: str = "parquet") -> str:
        """One table as a new version of itself."""
        path = f"_versions/{uuid.uuid4().hex[:16]}/{name}"
        write_table(df, f"{self.root}/{path}", fmt)
        self.commit({name: {"path": path, "format": fmt}})
        return f"{self.root}/{path}"

    def read(self, name: str, fmt: str | None = None) -> DataFrame:
        """A table of the last complete version; a missing one is an error."""
        found = self.current().get(name)
        if found is None:
            raise FileNotFoundError(f"result table not found: {self.root}/{name}")
        return self.spark.read.option("header", True).format(fmt or found["format"]).load(f"{self.root}/{found['path']}")

    def vacuum(self, keep: int = KEEP) -> list[str]:
        """Remove versions that none of the last ``keep`` commits names (nor a run in progress), and older commits."""
        done = self.commits()
        named = {t["path"].split("/")[1] for c in done[-keep:] for t in load(self.spark, f"{self.root}/_commits/{c}")["tables"].values()
                 if t["path"].startswith("_versions/")}
        gone = [v for v in names(self.spark, f"{self.root}/_versions")
                if v not in named and not path_exists(self.spark, f"{self.root}/_versions/{v}/_stages/open.json")]
        for v in gone:
            remove_path(self.spark, f"{self.root}/_versions/{v}")
        for c in done[:-keep]:
            remove_path(self.spark, f"{self.root}/_commits/{c}")
        return gone


class Run:
    """A version written stage by stage, found again by the digest of its inputs and parameters."""

    def __init__(self, results: ResultSet, key: object, fresh: bool = False):
        text = json.dumps(key, sort_keys=True, default=str) + (uuid.uuid4().hex if fresh else "")
        self.results, self.spark = results, results.spark
        self.name = "run-" + hashlib.sha256(text.encode()).hexdigest()[:24]
        self.folder = f"{results.root}/_versions/{self.name}"
        self.skipped: list[str] = []
        self.tables: dict[str, dict] = {}
        publish(self.spark, f"{self.folder}/_stages/open.json", {})

    def stage(self, name: str, work: Callable[[], None]) -> None:
        """Do the work unless its mark is there; the mark lists the tables it wrote."""
        mark = f"{self.folder}/_stages/done-{name}.json"
        if path_exists(self.spark, mark):
            self.tables.update(load(self.spark, mark)["tables"])
            self.skipped.append(name)
            return
        before = dict(self.tables)
        work()
        publish(self.spark, mark, {"tables": {k: v for k, v in self.tables.items() if before.get(k) != v}})

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def note(self, name: str, fmt: str = "parquet") -> str:
        """Count a table that a stage writes itself to ``path(name)``."""
        self.tables[name] = {"path": f"_versions/{self.name}/{name}", "format": fmt}
        return self.path(name)

    def write(self, df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
        write_table(df, self.path(name), fmt)
        self.note(name, fmt)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.format(self.tables[name]["format"]).load(self.path(name))

    def commit(self) -> None:
        """All tables become the set's last version together."""
        if self.results.current() != self.tables:
            self.results.commit(self.tables, whole=True)
        remove_path(self.spark, f"{self.folder}/_stages/open.json")
