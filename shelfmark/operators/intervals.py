"""Subtrees as ranges: preorder labels of paths, and what removed folders reach.

With the separator as the lowest character, the order of paths is a preorder of the tree: a folder comes right before all that
lies below it. So labels need one sort by ranges instead of walks over parent pointers (catalogs that have pointers alone get
their paths by ``resolve_paths`` first), and a subtree is a range of labels, or of the paths themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.catalog import checkpointed

#: Up to so many removed folders are compiled into range predicates; more are found by a sweep over the sorted paths.
FEW = 32


def preorder_key(path: Column) -> Column:
    """Sorts a folder right before its contents: the separator becomes NUL, which no path holds."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def inside(path: Column, folder: Column | str) -> Column:
    """Whether a path is a folder or lies below it, as a range predicate on the path (``0`` follows ``/``)."""
    at = F.lit(folder) if isinstance(folder, str) else folder
    open_end = F.endswith(at, F.lit("/"))
    low = F.when(open_end, at).otherwise(F.concat(at, F.lit("/")))
    high = F.concat(F.left(low, F.length(low) - 1), F.lit("0"))
    return (path == at) | ((path >= low) & (path < high))


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in sorted partitions of ranges, with ``__p`` and their place ``__at`` there; written, so that a partition that is
    lost does not get other rows. Reading keeps the partitions and their order, so nothing needs to be dealt by ``__p`` again."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return checkpointed(placed.withColumn("__p", F.spark_partition_id()).withColumn("__at", place()))


def place() -> Column:
    """The place of a row in its partition, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def labelled(catalog: DataFrame) -> DataFrame:
    """``catalog`` with ``pre`` and ``last``: the subtree of a row is the rows whose ``pre`` lies between its two labels.

    One sort by ranges numbers the rows; a mark behind each folder's contents, in the same sort, tells where they end. Of rows
    with one path the first by id comes first. Labels begin at 0 and have no gaps.
    """
    key = preorder_key(F.col("path"))
    none = F.lit(None).cast("long")
    rows = catalog.select(key.alias("__key"), F.lit(1).alias("__real"), F.col("entry_id").alias("__id"), F.col("path").alias("__path"))
    stem = F.when(F.endswith("path", F.lit("/")), F.left(key, F.length(key) - 1)).otherwise(key)  # a root such as /
    ends = catalog.select("path").distinct().select(F.concat(stem, F.lit("\1")), F.lit(0), none, "path")
    placed = ranged(rows.union(ends), "__key", "__real", "__id")
    before = placed.groupBy("__p").agg(F.sum("__real").alias("__n"))
    before = F.broadcast(before.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before")))  # a row per partition
    # Each kind is counted in the order of its partition; a mark has as many rows before it as its place, less the marks before it.
    starts = placed.where("__real = 1").withColumn("__n", place()).join(before, "__p")
    stops = placed.where("__real = 0").withColumn("__n", F.col("__at") - place()).join(before, "__p")
    starts = starts.select(F.col("__id").alias("entry_id"), F.col("__path").alias("path"), (F.col("__before") + F.col("__n")).alias("pre"))
    stops = stops.select(F.col("__path").alias("path"), (F.col("__before") + F.col("__n") - 1).alias("last"))
    return catalog.drop("pre", "last").join(starts, ["entry_id", "path"]).join(stops, "path").select(*(c for c in catalog.columns if c not in ("pre", "last")), "pre", "last")


def subtree(labels: DataFrame, path: str) -> DataFrame:
    """The rows of ``labelled`` at a path and below it; the labels of one path reach the driver."""
    found = labels.where(F.col("path") == path).agg(F.min("pre"), F.max("last")).first()
    return labels.where(F.col("pre").between(*found)) if found[0] is not None else labels.limit(0)


def _above(path: Column) -> Column:
    """The path itself and every folder above it."""
    steps = F.split(path, "/", -1)
    parts = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))
    return F.transform(parts, lambda p: F.when(p == "", "/").otherwise(p))


def removed_at(paths: DataFrame, removed: DataFrame, few: int = FEW) -> DataFrame:
    """(path, removed_at) of the ``paths`` at or below a removed one: the last removal that reaches them.

    ``removed`` has distinct (path, seq). A few become one range predicate each. More are swept: paths and removals are sorted
    together by ranges, and a task walks its range with a stack of the folders it is in. What is open where a range begins is
    found from that range's first path alone, so the rows sent to all tasks are at most the ranges times their depth.
    """
    known = removed.limit(few + 1).collect()
    if not known:
        return paths.select("path", F.lit(None).cast("long").alias("removed_at")).limit(0)
    if len(known) <= few:
        reach = [F.when(inside(F.col("path"), r["path"]), F.lit(r["seq"])) for r in known]
        at = F.greatest(*reach) if len(reach) > 1 else reach[0]
        return paths.select("path", at.cast("long").alias("removed_at")).where("removed_at IS NOT NULL")
    marks = removed.select(preorder_key(F.col("path")).alias("__key"), F.lit(0).alias("__kind"), "path", F.col("seq").cast("long").alias("seq"))
    nodes = paths.select(preorder_key(F.col("path")), F.lit(1), "path", F.lit(None).cast("long"))
    placed = ranged(marks.union(nodes), "__key", "__kind")
    first = placed.groupBy("__p").agg(F.min_by("path", F.struct("__key", "__kind")).alias("path"))
    above = first.select("__p", F.explode(_above(F.col("path"))).alias("path"))
    opened = above.join(removed, "path").select("__p", "path", "seq").collect()  # ranges times depth at most
    open_at: dict[int, list[tuple[str, int]]] = {}
    for r in sorted(opened, key=lambda r: len(r["path"])):
        open_at.setdefault(r["__p"], []).append((r["path"], r["seq"]))
    shared = paths.sparkSession.sparkContext.broadcast(open_at)
    return placed.select("__p", "__kind", "path", "seq").mapInArrow(lambda batches: _sweep(batches, shared.value), "path string, removed_at long")


def _sweep(batches: Iterator[pa.RecordBatch], open_at: dict[int, list[tuple[str, int]]]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, in preorder."""
    stack: list[tuple[str, str, int]] = []
    started = False

    def enter(path: str, seq: int) -> None:
        below = path if path.endswith("/") else path + "/"
        stack.append((path, below, max(seq, stack[-1][2]) if stack else seq))

    for batch in batches:
        paths, at = [], []
        for p, kind, path, seq in zip(*(batch.column(c).to_pylist() for c in ("__p", "__kind", "path", "seq")), strict=True):
            if not started:
                started = True
                for folder, when in open_at.get(p, []):
                    enter(folder, when)
            while stack and path != stack[-1][0] and not path.startswith(stack[-1][1]):
                stack.pop()
            if kind == 0:
                enter(path, seq)
            elif stack:
                paths.append(path)
                at.append(stack[-1][2])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64())], ["path", "removed_at"])
