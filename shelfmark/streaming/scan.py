"""The first scan as a stream: the catalog is there to be searched while the tree is still being walked.

The frontier, the folders that are known but not yet listed, is a table for each level, cut into admission units of folders with
about ``admit`` entries. A folder has a small file for each unit, and a stream reads it: its offsets are what has been taken off
the frontier. A micro-batch takes one file, reads the folders of that unit, lists them on the executors and writes their entries as a table of the catalog. When the frontier has been listed, the folders
among all that was found become the units of the next level together, so that units are full however many batches found them.
One small file, replaced at once, names the tables that are there to be read, so a search sees whole batches only.
A batch that is run again after a failure finds itself committed, or starts over. Nothing of the tree passes through the driver
but counts: rows, and open folders for each root.

``children`` lists folders: a function of a DataFrame (entry_id, path, root, unit) to one (entry_id, parent_id, name, path, is_dir,
size, modified, root). Entries without an id get the next ones in the order of their paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.catalog import COLUMNS, checkpointed
from shelfmark.operators.changes import with_new_ids
from shelfmark.sources.files import entries_of, root_rows
from shelfmark.sources.published import exists, move, publish, published

#: Entries that are published together.
ADMIT = 65_536
ENTRY = "entry_id bigint, parent_id bigint, name string, path string, is_dir boolean, size bigint, modified bigint, root string"
FOLDERS = "entry_id bigint, path string, root string, unit long"
FRONTIER = "planned int, level int, unit long"
#: Folders in a file of the frontier, and the most buckets of a table of nodes.
FILE, BUCKETS = 65_536, 256

Children = Callable[[DataFrame], DataFrame]
#: Folders (entry_id, path, root) and how many rows are published, to the folders with ``unit``, a long that tells which are
#: listed together, and ``place``, their number in the order of the units.
Units = Callable[[DataFrame, int], DataFrame]


@dataclass
class FirstScan:
    """A scan whose state is in a folder that driver and executors share. ``step`` takes what is open; ``run`` goes to the end."""

    spark: SparkSession
    folder: str
    children: Children
    units: Units

    @property
    def _at(self) -> str:
        return f"{self.folder}/PROGRESS"

    def progress(self) -> dict:
        """batch, rows, tables, planned (how many of the tables have their folders in the frontier), level, open {root: folders not
        yet listed}, completed (roots). Before the start all are empty."""
        found = published(self.spark, self._at) or {"batch": -1, "rows": 0, "tables": [], "planned": 0, "level": 0, "open": {}, "roots": []}
        return found | {"completed": [r for r in found["roots"] if not found["open"].get(r)]}

    def catalog(self) -> DataFrame:
        """The entries that have been committed."""
        tables = self.progress()["tables"]
        if not tables:
            return self.spark.createDataFrame([], ENTRY).drop("root").withColumn("is_deleted", F.lit(False))
        rows = self.spark.read.schema(ENTRY).parquet(*(f"{self.folder}/{t}" for t in tables))
        return rows.withColumn("is_deleted", F.lit(False)).select(*COLUMNS)

    def start(self, roots: DataFrame) -> None:
        """Commit the roots (the columns of ``children``); a scan that has been started goes on where it was."""
        if self.progress()["batch"] < 0:
            self._commit(0, roots, {})

    def step(self, on_commit: Callable[[dict], None] | None = None) -> bool:
        """List the frontier as it is now, one unit a micro-batch, then plan the next level; whether anything is left."""

        def batch(taken: DataFrame, number: int) -> None:
            done = self.progress()
            if done["batch"] > number:  # batch 0 is the roots
                return
            at = taken.select("level", "unit").first()  # one row, as a batch is one file
            taken = self.spark.read.schema(FOLDERS).parquet(f"{self.folder}/folders/level={at['level']}").where(F.col("unit") == at["unit"])
            listed = {r["root"]: r["n"] for r in taken.groupBy("root").agg(F.count("*").alias("n")).collect()}  # a row a root
            self._commit(number + 1, self.children(taken), listed)
            if on_commit is not None:
                on_commit(self.progress())

        if any(self.progress()["open"].values()):
            self._plan()  # the roots, or what a run that was interrupted has left
            frontier = self.spark.readStream.schema(FRONTIER).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/frontier")
            frontier.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/offsets").trigger(availableNow=True).start().awaitTermination()
        if any(self.progress()["open"].values()):
            self._plan()
            return True
        return False

    def run(self, on_commit: Callable[[dict], None] | None = None) -> DataFrame:
        """The whole catalog. The frontier grows a level deeper with every step."""
        while self.step(on_commit):
            pass
        return self.catalog()

    def _commit(self, number: int, rows: DataFrame, listed: dict[str, int]) -> None:
        before, name = self.progress(), f"entries-{uuid.uuid4().hex}"
        fields = [c.split()[0] for c in ENTRY.split(", ")]
        found = checkpointed(rows.select(*fields))
        if found.where("entry_id IS NULL").take(1):
            highest = self.catalog().agg(F.max("entry_id").alias("m")).first()["m"]
            found = with_new_ids(found, after=-1 if highest is None else highest)
        found.write.parquet(f"{self.folder}/{name}")
        found = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{name}")
        counts = found.groupBy("root").agg(F.count("*").alias("n"), F.count_if("is_dir").alias("dirs")).collect()  # a row a root
        still = {r: before["open"].get(r, 0) - listed.get(r, 0) for r in {*before["open"], *listed}}
        for r in counts:
            still[r["root"]] = still.get(r["root"], 0) + r["dirs"]
        roots = before["roots"] or sorted(r["root"] for r in counts)
        now = {"batch": number, "rows": before["rows"] + sum(r["n"] for r in counts), "tables": [*before["tables"], name], "open": still, "roots": roots}
        publish(self.spark, self._at, {"planned": before["planned"], "level": before["level"]} | now)

    def _plan(self) -> None:
        """Make the folders of the tables that are not planned yet the units of the next level, and let the stream see them.

        A run that was interrupted within a level has its new folders planned early, which costs a unit that is not full.
        """
        now = self.progress()
        self._open_frontier(now["level"])
        tables, level = now["tables"][now["planned"] :], now["level"] + 1
        if not tables:
            return
        found = self.spark.read.schema(ENTRY).parquet(*(f"{self.folder}/{t}" for t in tables)).where("is_dir")
        folders = checkpointed(self.units(found.select("entry_id", "path", "root"), now["rows"]))
        by_file = folders.repartition("unit", F.floor(F.col("place") / FILE))
        by_file.select("entry_id", "path", "root", "unit").write.mode("overwrite").partitionBy("unit").parquet(f"{self.folder}/folders/level={level}")
        folders.select("unit", F.lit(level).alias("planned")).distinct().repartition("unit").write.mode("overwrite").partitionBy("unit").parquet(f"{self.folder}/waiting/level={level}")
        publish(self.spark, self._at, {k: v for k, v in now.items() if k != "completed"} | {"planned": len(now["tables"]), "level": level})
        self._open_frontier(level)

    def _open_frontier(self, level: int) -> None:
        """Let the stream see the units of a level whose plan is published."""
        waiting = f"{self.folder}/waiting/level={level}"
        if exists(self.spark, waiting):
            move(self.spark, waiting, f"{self.folder}/frontier/level={level}")


def _placed(folders: DataFrame, weight: str | None, *order: str) -> DataFrame:
    """``folders`` with ``place``, their number in an order, and ``before``, the sum of ``weight`` of those that come earlier.

    Sums within ranges of the order, plus those of the ranges before, so no task sees all folders.
    """
    n = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = folders.withColumn("__w", F.lit(1) if weight is None else F.col(weight))
    ranged = checkpointed(weighed.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.sum("__w").alias("__s"))
    earlier = Window.orderBy("__p")  # a row per partition
    sums = sums.select("__p", (F.sum("__n").over(earlier) - F.col("__n")).alias("__n"), (F.sum("__s").over(earlier) - F.col("__s")).alias("__s"))
    within = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn("place", F.count("*").over(within) - 1).withColumn("before", F.sum("__w").over(within) - F.col("__w"))
    own = own.join(F.broadcast(sums), "__p")
    return own.withColumn("place", F.col("place") + F.col("__n")).withColumn("before", F.col("before") + F.col("__s")).drop("__p", "__w", "__n", "__s")


def spread_units(folders_each: int) -> Units:
    """Units of so many folders, by the order of their paths."""

    def units(folders: DataFrame, rows: int) -> DataFrame:
        return _placed(folders, None, "path").withColumn("unit", F.floor(F.col("place") / folders_each)).drop("before")

    return units


def folder_scan(spark: SparkSession, folder: str, roots: list[str], exclusions: list[str] | None = None, folders_each: int = 1_024) -> FirstScan:
    """The scan of folders that the executors see. How many entries a folder has is not known before, so units count folders."""
    patterns = exclusions or []

    def children(taken: DataFrame) -> DataFrame:
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for parent, path, root in zip(*(batch.column(c).to_pylist() for c in ("entry_id", "path", "root")), strict=True):
                    rows = [(None, parent, name, at, is_dir, size, modified, root) for at, name, is_dir, size, modified in entries_of(path, patterns)]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in ENTRY.split(", ")])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return taken.repartition(n, "path").mapInArrow(listed, ENTRY)

    scan = FirstScan(spark, folder, children, spread_units(folders_each))
    first = [(None, None, path, path, is_dir, size, modified, path) for path, is_dir, size, modified in root_rows(roots)]
    scan.start(spark.createDataFrame(first, ENTRY))
    return scan


def node_scan(nodes: DataFrame, folder: str, admit: int = ADMIT, growing: bool = False) -> FirstScan:
    """The scan of a table of parent pointers (entry_id, parent_id, name, is_dir), as if it were a tree of folders.

    The table is written once in buckets of the parent, and folders are listed in the order of the buckets, so a micro-batch reads
    only those that it needs. A unit has folders with about ``admit`` entries together, or one folder with more. Where units are
    ``growing``, the first of a level has as many entries as are published by then (``admit`` at least) and each one after it
    twice as many as the one before: the number of batches grows with the logarithm of the table, and searches after each of
    them read the table a few times, not once for every ``admit`` entries.
    """
    spark = nodes.sparkSession
    held = nodes.select("entry_id", "parent_id", "name", "is_dir")
    buckets = min(BUCKETS, max(1, held.count() // (4 * admit)))
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    at = f"{folder}/nodes-{uuid.uuid4().hex}"
    held.where("parent_id IS NOT NULL").withColumn("bucket", bucket("parent_id")).repartition("bucket").write.partitionBy("bucket").parquet(at)
    stored = spark.read.schema("entry_id bigint, parent_id bigint, name string, is_dir boolean, bucket int").parquet(at)
    counts = checkpointed(stored.groupBy("parent_id").agg(F.count("*").alias("n")))

    def children(taken: DataFrame) -> DataFrame:
        own = stored.where(F.col("bucket").isin([r["b"] for r in taken.select(bucket("entry_id").alias("b")).distinct().collect()]))  # BUCKETS numbers at most
        above = taken.select(F.col("entry_id").alias("parent_id"), F.col("path").alias("above"), "root")
        none = F.lit(0).cast("long")
        return own.join(above, "parent_id").select("entry_id", "parent_id", "name", F.concat("above", F.lit("/"), "name").alias("path"), "is_dir", none.alias("size"), none.alias("modified"), "root")

    def units(folders: DataFrame, rows: int) -> DataFrame:
        sized = folders.join(counts.withColumnRenamed("parent_id", "entry_id"), "entry_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        placed = _placed(sized.withColumn("__b", bucket("entry_id")), "n", "__b", "entry_id")
        unit = F.floor(F.log2(1 + F.col("before") / max(admit, rows))) if growing else F.floor(F.col("before") / admit)
        return placed.withColumn("unit", unit.cast("long")).drop("n", "__b", "before")

    scan = FirstScan(spark, folder, children, units)
    none = F.lit(0).cast("long")
    scan.start(held.where("parent_id IS NULL").select("entry_id", "parent_id", "name", F.col("name").alias("path"), "is_dir", none.alias("size"), none.alias("modified"), F.col("name").alias("root")))
    return scan
