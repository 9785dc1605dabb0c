"""Versions of a state in a shared folder, each written by one writer at most (RES-07).

A version is a folder named by its number that holds one file. A writer fills a
folder of its own and renames it; where the number is there already, the file
system leaves that folder as it is, so of two writers that go on from the same
version one finds its own mark under the next number and the other does not: it is
refused and has to look again. A version is there as a whole or not at all, and a
writer that dies leaves nothing that stands in the way. (A store without an atomic
rename of folders needs its own exclusive write instead.) What a version says is
small (names of tables, fingerprints); tables are written before, under names of
their own, so a refused writer leaves nothing that anyone reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Stale(RuntimeError):
    """Someone else went on from the version, or the snapshot is another one."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, path.rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(at)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def latest(self) -> tuple[int, dict]:
        """The last version and what it says; 0 and nothing before the first."""
        names = [s.getPath().getName() for s in self.files.listStatus(self._path("."))]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return number, self._read(f"{number:012d}")["says"] if number else {}

    def _read(self, name: str) -> dict:
        lines = self.files.open(self._path(f"{name}/version.json"))
        try:
            return json.loads(bytes(lines.readAllBytes()).decode())
        finally:
            lines.close()

    def commit(self, after: int, says: dict) -> int:
        """The version behind `after`; Stale if it is there already."""
        mark, name = uuid.uuid4().hex, f"{after + 1:012d}"
        out = self.files.create(self._path(f"own-{mark}/version.json"), False)
        out.write(bytearray(json.dumps({"mark": mark, "says": says}).encode()))
        out.close()
        if not self.files.exists(self._path(name)):
            self.files.rename(self._path(f"own-{mark}"), self._path(name))
        won = self._read(name)["mark"] == mark
        for rest in [f"own-{mark}"] * (not won) + [f"{name}/own-{mark}"]:
            self.files.delete(self._path(rest), True)
        if not won:
            raise Stale(f"version {after + 1} is there already")
        return after + 1
