"""A data source that scans folders into catalog rows.

``spark.read.format("shelfmark_files").option("roots", json).option("exclusions", json).load()``. Each root, and each folder
right below a root, is a task of its own. Hidden files are included, symbolic links are not followed, excluded folders
are not entered. An entry whose metadata cannot be read has size 0 and time 0. Roots must be visible to the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.plans.parser import fold

SCHEMA = "path string, parent string, name string, is_dir boolean, size bigint, modified bigint"


def is_excluded(path: str, patterns: list[str]) -> bool:
    """The exclusion rule for one path."""
    low = fold(path)
    parts = [p for p in low.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    alike = low.replace("\\", "/")
    for raw in patterns:
        p = fold(raw.strip())
        if not p:
            continue
        if "/" not in p and "\\" not in p:
            if p in parts:
                return True
            continue
        segment, at = p.replace("\\", "/"), -1
        while (at := alike.find(segment, at + 1)) >= 0:
            end = at + len(segment)
            if end == len(alike) or alike[end] == "/":
                return True
    return False


def _row(path: str, parent: str | None, name: str, is_dir: bool) -> tuple:
    try:
        facts = os.stat(path, follow_symlinks=False)
        return path, parent, name, is_dir, 0 if is_dir else facts.st_size, max(0, int(facts.st_mtime))
    except OSError:
        return path, parent, name, is_dir, 0, 0


def entries_of(folder: str, patterns: list[str]) -> Iterator[tuple]:
    """(path, name, is_dir, size, modified) of what is directly in a folder; nothing if it cannot be listed."""
    try:
        with os.scandir(folder) as found:
            children = sorted(found, key=lambda e: e.name)
    except OSError:
        return
    for e in children:
        if not is_excluded(e.path, patterns):
            path, _, name, is_dir, size, modified = _row(e.path, folder, e.name, e.is_dir(follow_symlinks=False))
            yield path, name, is_dir, size, modified


def root_rows(roots: list[str]) -> list[tuple]:
    """(path, is_dir, size, modified) of the roots, each a folder."""
    return [(r, True, 0, _row(r, None, r, True)[-1]) for r in roots]


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool, root: bool):
        self.folder, self.deep, self.root = folder, deep, root


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options.get("roots", "[]"))
        self.exclusions = json.loads(options.get("exclusions", "[]"))

    def partitions(self) -> list[_Part]:
        out = []
        for root in self.roots:
            out.append(_Part(root, False, True))
            try:
                with os.scandir(root) as found:
                    out += [_Part(e.path, True, False) for e in sorted(found, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not is_excluded(e.path, self.exclusions)]
            except OSError:
                continue
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.root:
            yield _row(part.folder, None, part.folder, True)
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            for path, name, is_dir, size, modified in entries_of(folder, self.exclusions):
                yield path, folder, name, is_dir, size, modified
                if is_dir and part.deep:
                    todo.append(path)


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelfmark_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def scan(spark: SparkSession, roots: list[str], exclusions: list[str] | None = None) -> DataFrame:
    """The catalog of the roots. Ids follow the order of the paths."""
    from shelfmark.operators.changes import with_new_ids

    spark.dataSource.register(FilesDataSource)
    rows = spark.read.format("shelfmark_files").option("roots", json.dumps(roots)).option("exclusions", json.dumps(exclusions or [])).load()
    with_ids = with_new_ids(rows.withColumn("entry_id", F.lit(None).cast("long")))
    folders = with_ids.where("is_dir").select(F.col("path").alias("parent"), F.col("entry_id").alias("parent_id"))
    joined = with_ids.join(folders, "parent", "left")
    return joined.select("entry_id", "parent_id", "name", "path", "is_dir", "size", "modified", F.lit(False).alias("is_deleted"))
