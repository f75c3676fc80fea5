"""Tables that are read whole while they are written: a manifest names the files of a generation.

Data go to folders of their own first. A generation is a numbered manifest, a small JSON file
that becomes visible by one rename; the last one is the table. So a reader has the table before
a write or after it, and a write that fails has changed nothing. Manifests are made on the driver
through Spark's own file systems, the data by tasks.

A table of latest rows is a list of runs, one for each batch. More than ``RUNS`` of them are
merged by key into one, so a read goes over at most that many rows a key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from liveops.operators import keyed

#: Runs of a table of latest rows before they are merged.
RUNS = 8
#: Generations that readers may still hold; the files of older ones go.
HELD = 3
EMPTY = {"runs": [], "done": {}}


class Versioned:
    """The manifests of the table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils.toString
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int) -> str:
        return f"{self.path}/_manifests/{number:012d}.json"

    def numbers(self) -> list[int]:
        """The generations that have a manifest, the last one being the table."""
        folder = self._path(f"{self.path}/_manifests")
        if not self.fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, number: int | None = None) -> dict:
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return json.loads(json.dumps(EMPTY))
            number = numbers[-1]
        stream = self.fs.open(self._path(self._name(number)))
        try:
            return json.loads(self._text(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` the next generation; fails if another writer was first."""
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 0
        hidden = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(self._name(number))
        if self.fs.exists(target) or not self.fs.rename(hidden, target):
            raise RuntimeError(f"another writer made generation {number} of {self.path}")
        self._forget(numbers[: max(0, len(numbers) + 1 - HELD)], number)

    def _forget(self, old: list[int], newest: int) -> None:
        """Drop manifests no reader should hold any more, and the runs that only they name."""
        kept = {run for n in self.numbers() if n not in old for run in self.manifest(n)["runs"]}
        for number in old:
            for run in self.manifest(number)["runs"]:
                if run not in kept:
                    self.fs.delete(self._path(f"{self.path}/{run}"), True)
            self.fs.delete(self._path(self._name(number)), False)

    def add(self, df: DataFrame) -> str:
        """Write ``df`` as a run that no manifest names yet."""
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def read(self, manifest: dict | None = None) -> DataFrame:
        runs = (manifest or self.manifest())["runs"]
        if not runs:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/{run}" for run in runs])


def append_latest(batch: DataFrame, epoch: int, writer: str, path: str, key: str, order) -> None:
    """Add the latest row per key of a batch to the table under ``path``.

    A batch that comes again (an ``epoch`` that ``writer`` has done) changes nothing.
    """
    table = Versioned(batch.sparkSession, path)
    manifest = table.manifest()
    if manifest["done"].get(writer, -1) >= epoch:
        return
    runs = [*manifest["runs"], table.add(keyed.latest(batch, key, order))]
    if len(runs) > RUNS:
        runs = [table.add(keyed.latest(table.read({"runs": runs}), key, order))]
    table.commit({"runs": runs, "done": manifest["done"] | {writer: epoch}})


def read_latest(spark: SparkSession, key: str, order, path: str) -> DataFrame:
    """The latest row per key, of at most ``RUNS`` rows a key.

    The files are those of one generation; they stay until two more were written.
    """
    return keyed.latest(Versioned(spark, path).read(), key, order)
