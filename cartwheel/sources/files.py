"""What is known of a table's files: listed in few calls, looked into once.

``listing`` takes one call to the JVM for all files of a table. A
``FileTable`` keeps, below the shared folder, the least and greatest id of
every file it has seen, its rows, and whether an id in it occurs more than
once. When the files of a table change, only files that are new are read,
and of the others those whose id ranges a new file overlaps.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATUS = re.compile(r"path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")


def hadoop(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path of ``path`` (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath  # noqa: SLF001


def listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and modification time of every data file below ``path``; names that begin with _ or . are not data."""
    fs, root = hadoop(spark, path)
    # the whole tree's statuses come as one text
    found = spark.sparkContext._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().listLeafStatuses(fs, root).mkString("\n")  # noqa: SLF001
    top = plain(fs.makeQualified(root).toString())
    out = {}
    for name, length, changed in _STATUS.findall(found):
        inside = plain(name)[len(top) :].split("/")
        if not any(part[:1] in ("_", ".") for part in inside):
            out[name] = (int(length), int(changed))
    return out


def plain(path: str) -> str:
    """One spelling for what listings, ``inputFiles`` and file metadata call a file."""
    return re.sub(r"^file:/+", "/", unquote(path))


class NotByFile(ValueError):
    """Rows that do not say which of the table's files they come from, as those of a view that joins or groups."""


@dataclass(frozen=True)
class FileFacts:
    length: int
    changed: int
    least: int | None
    greatest: int | None
    n_rows: int
    repeats: bool


class FileTable:
    """Facts of the files of one table with the id column ``key``, kept in ``folder`` (None: only in this object)."""

    SCHEMA = "path string, length long, changed long, least long, greatest long, n_rows long, repeats boolean, state int"

    def __init__(self, spark: SparkSession, key: str, folder: str | None = None):
        self.spark, self.key, self.folder = spark, key, folder
        self.facts: dict[str, FileFacts] = {}
        self.state = 0
        if folder is not None:
            fs, jpath = hadoop(spark, folder)
            if fs.exists(jpath):
                for r in sorted(spark.read.schema(self.SCHEMA).parquet(folder).collect(), key=lambda r: r.state):
                    self.facts[r.path] = FileFacts(r.length, r.changed, r.least, r.greatest, r.n_rows, r.repeats)
                    self.state = r.state

    def update(self, files: dict[str, tuple[int, int]], read: Callable[[list[str]], DataFrame]) -> list[str]:
        """Looks into the files that are new or rewritten; returns the files that share or repeat an id.

        ``files``: path -> (length, modification time), now. ``read`` gives the rows of some files.
        """
        names = {plain(f): f for f in files}
        self.facts = {p: f for p, f in self.facts.items() if p in names and (f.length, f.changed) == tuple(files[names[p]])}
        new = [p for p in names if p not in self.facts]
        if new:
            rows = self._ids(read([names[p] for p in new]))
            ranges = {
                plain(r.f): r
                for r in rows.groupBy("f").agg(F.min("id").alias("least"), F.max("id").alias("greatest"), F.count("*").alias("n")).collect()
            }
            if not set(ranges) <= set(new):
                raise NotByFile(sorted(set(ranges) - set(new))[0])
            touched = self._overlapping([(r.least, r.greatest) for r in ranges.values() if r.least is not None])
            twice = self._repeated([names[p] for p in [*new, *touched]], read)
            told = {}
            for p in new:
                r = ranges.get(p)  # a file without rows has none
                told[p] = FileFacts(*files[names[p]], *((r.least, r.greatest, r.n) if r else (None, None, 0)), p in twice)
            for p in touched:
                if p in twice and not self.facts[p].repeats:
                    old = self.facts[p]
                    told[p] = FileFacts(old.length, old.changed, old.least, old.greatest, old.n_rows, True)
            self.facts |= told
            self._keep(told)
        return [names[p] for p, f in self.facts.items() if f.repeats]

    def _ids(self, df: DataFrame) -> DataFrame:
        return df.select(F.input_file_name().alias("f"), F.col(self.key).alias("id"))

    def _overlapping(self, new: Iterable[tuple[int, int]]) -> list[str]:
        """Known files whose ids lie between the least and greatest id of a new file; a sweep over both."""
        joined: list[list[int]] = []
        for low, high in sorted(new):
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        highs = [high for _, high in joined]
        out = []
        for path, f in self.facts.items():
            if f.least is not None:
                k = bisect_left(highs, f.least)
                if k < len(joined) and joined[k][0] <= f.greatest:
                    out.append(path)
        return out

    def _repeated(self, files: list[str], read: Callable[[list[str]], DataFrame]) -> set[str]:
        rows = self._ids(read(files)).filter("id is not null")
        twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        if twice.isEmpty():
            return set()
        return {plain(r.f) for r in rows.join(twice, "id", "left_semi").select("f").distinct().collect()}

    def _keep(self, told: dict[str, FileFacts]) -> None:
        self.state += 1
        if self.folder is not None:
            rows = [(p, f.length, f.changed, f.least, f.greatest, f.n_rows, f.repeats, self.state) for p, f in told.items()]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:20]
