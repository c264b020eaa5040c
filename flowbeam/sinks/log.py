"""Commit log of a table: numbered small files that say which of its directories count.

Data is written first, into a directory that nobody reads yet; one entry in ``<table>/_log`` then
makes it part of the table. Entry files are created exclusively, so two writers never take the
same number, and a writer that loses looks at the other's entry before it tries the next number.
A writer that dies leaves data without an entry: it is invisible, and a later run replaces it.

File operations go through Spark's own Hadoop file systems. Exclusive creation is as atomic as
the store makes it (HDFS and local disks do; on an object store let writers take turns).
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path, however it was written."""
    fs, place = _place(spark, path)
    return fs.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory, sorted; none if there is no directory."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def size_of(spark: SparkSession, path: str) -> int:
    fs, place = _place(spark, path)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a directory with all it holds; False if there is none."""
    fs, place = _place(spark, path)
    return fs.delete(place, True)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one already."""
    fs, place = _place(spark, path)
    if fs.exists(place):
        return False
    try:
        out = fs.create(place, False)
    except Exception:
        if fs.exists(place):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class CommitLog:
    """The entries of one table, in order of their numbers."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.root = spark, f"{table.rstrip('/')}/_log"

    def entries(self) -> dict[int, dict]:
        """{number: entry}. An entry whose writer died while writing it does not count."""
        found = {}
        for name in names(self.spark, self.root):
            if name.endswith(".json"):
                entry = self._entry(name)
                if entry is not None:
                    found[int(name[:-5])] = entry
        return found

    def _entry(self, name: str) -> dict | None:
        for wait in (0, 0.05, 0.2, 0.5):  # another writer may be in the middle of it
            time.sleep(wait)
            try:
                return json.loads(_read(self.spark, f"{self.root}/{name}"))
            except ValueError:
                continue
        return None

    def last(self) -> int:
        """The highest number taken, 0 for none."""
        return max((int(n[:-5]) for n in names(self.spark, self.root) if n.endswith(".json")), default=0)

    def commit(self, entry: dict, number: int | None = None) -> int | None:
        """Add an entry and return its number.

        With ``number`` only under that number: None if another writer has it.
        """
        while True:
            n = number or self.last() + 1
            if _create(self.spark, f"{self.root}/{n:010d}.json", json.dumps(entry)):
                return n
            if number:
                return None
