"""A results folder as parts: appends that can be retried, and an index of the ids in each part.

A named append is one part. Its files carry the part's name, so the same append a
second time finds what an earlier try left, complete or not, and replaces it.
Beside the files, below ``_parts``, lies an index of the part: hashes of its ids,
dealt to slots. A few new items are held against these prints, and only
the parts that may have one of them are scanned; files without an index always are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe import fixed_values as fv
from gradeframe.operators.resume import distinct_ids, pending
from gradeframe.sources.tables import check_columns, staged
from gradeframe.spec import column, has_column

_INDEX, _MARK = "_parts", "~"
_SLOTS = 4096
_SCHEMA = "slot int, prints array<int>, part string"


class Folder:
    """A folder in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        """Names directly below; none where there is no folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def files(self, name: str = "") -> dict[str, str]:
        """Data files at any depth, without what is hidden: name, and a mark that changes with the file."""
        found = {}
        if not self.exists(name):
            return found
        for status in self._fs.listStatus(self._path(self.at(name))):
            own = status.getPath().getName()
            if own.startswith(("_", ".")):
                continue
            below = f"{name}/{own}" if name else own
            if status.isDirectory():
                found |= self.files(below)
            else:
                found[below] = f"{status.getLen()} {status.getModificationTime()}"
        return found

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(self.at(name)), self._path(self.at(to))):
            raise OSError(f"could not move {self.at(name)} to {self.at(to)}")


def _data_files(folder: Folder) -> list[str]:
    return [n for n in folder.names() if not n.startswith(("_", "."))]


def _printed(ids: Column) -> tuple[Column, Column]:
    """Slot and print of an id: 44 bits of its hash, so that a part of a million ids has a foreign one in 2e7."""
    hashed = F.xxhash64(ids.cast("string"))
    upper = F.shiftrightunsigned(hashed, 12).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)
    return hashed.bitwiseAND(F.lit(_SLOTS - 1)).cast("int"), upper.cast("int")


def _prints(ids: DataFrame) -> DataFrame:
    """Slot and its prints, for a table with a column ``id``."""
    slot, print_ = _printed(F.col("id"))
    return ids.select(slot.alias("slot"), print_.alias("print")).groupBy("slot").agg(F.collect_set("print").alias("prints"))


def append_part(df: DataFrame, path: str, part: str, id_col: str | None = None) -> None:
    """Append rows as a named part, in place of an earlier append under that name.

    The files are written to a folder of their own first and then moved, as a job's
    files are on commit. A try that dies leaves files under the part's name
    and no index; they are replaced by the next.
    """
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", part):
        raise ValueError("a part's name becomes the beginning of file names: a letter or digit, then letters, digits, _ . - only")
    spark, folder, fresh = df.sparkSession, Folder(df.sparkSession, path), f"{_INDEX}/_new-{part}"
    df = check_columns(df, path)
    df.write.mode("overwrite").parquet(folder.at(fresh))
    # What an earlier try left; its index first, for files without one are scanned.
    remove_part(spark, path, part)
    for name in folder.names(fresh):
        if not name.startswith(("_", ".")):
            folder.move(f"{fresh}/{name}", f"{part}{_MARK}{name}")
    folder.remove(fresh)
    written = [n for n in folder.names() if n.startswith(part + _MARK)]
    if has_column(df, id_col) and written:
        rows = spark.read.schema(df.schema).parquet(*[folder.at(n) for n in written])
        _prints(distinct_ids(rows, id_col)).write.parquet(folder.at(f"{_INDEX}/part={part}"))


def remove_part(spark: SparkSession, path: str, part: str) -> None:
    """Take a part out of a folder."""
    folder = Folder(spark, path)
    folder.remove(f"{_INDEX}/part={part}")
    for name in folder.names():
        if name.startswith(part + _MARK):
            folder.remove(name)


def indexed_parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts whose ids are all indexed."""
    folder = Folder(spark, path)
    names = [n.partition("=")[2] for n in folder.names(_INDEX) if n.startswith("part=")]
    return [n for n in names if folder.exists(f"{_INDEX}/part={n}/_SUCCESS")]


def files_with(items: DataFrame, path: str, id_col: str) -> list[str]:
    """Names of the result files that may hold an id of the items."""
    spark, folder = items.sparkSession, Folder(items.sparkSession, path)
    files, parts = _data_files(folder), set(indexed_parts(spark, path))
    if not parts:
        return files
    index = spark.read.schema(_SCHEMA).option("basePath", folder.at(_INDEX)).parquet(
        *[folder.at(f"{_INDEX}/part={p}") for p in sorted(parts)])
    asked = staged(_prints(distinct_ids(items, id_col)).withColumnRenamed("prints", "asked"), "asked")
    # A row per part and slot; what comes to the driver are names of parts.
    met = index.join(asked, "slot").where(F.arrays_overlap("prints", "asked")).select("part").distinct().collect()
    met = {r["part"] for r in met}
    return [n for n in files if n.partition(_MARK)[0] not in parts or n.partition(_MARK)[0] in met]


def pending_at(items: DataFrame, path: str, id_col: str | None, retry_errors: bool = False) -> DataFrame:
    """``pending`` against the results in a folder, scanning only the parts that may matter."""
    folder = Folder(items.sparkSession, path)
    files = _data_files(folder)
    if not files or not has_column(items, id_col):
        return items
    files = files_with(items, path, id_col)
    if not files:
        return items
    found = items.sparkSession.read.option("basePath", folder.path).parquet(*[folder.at(n) for n in files])
    wanted = [n for n in (id_col, fv.ERROR) if n in found.columns]
    return pending(items, found.select(*[column(n) for n in wanted]), id_col, retry_errors)
