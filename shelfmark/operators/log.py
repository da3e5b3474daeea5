"""A catalog kept as a base table and a log of changes, merged when it is read.

A batch of events is folded to the facts of the paths it names and appended as a table of its own: what it writes grows with the
batch, not with the catalog, and neither the catalog nor earlier batches are read for it. Reading merges the base with the folded
log. Compaction writes what reading gives as the new base, removals of unknown paths included, so that it changes no later
result. One small file, replaced at once, names the base and the batches: a reader sees a batch or does not, and a batch that
is appended again under its number replaces itself.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.catalog import VERSION
from shelfmark.operators.changes import carrying, folded_changes, folded_facts, merge_facts, shown
from shelfmark.sources.published import publish, published, remove

FACTS = "path string, up struct<seq: bigint, is_dir: boolean, size: bigint, modified: bigint>, del_seq bigint"


@dataclass
class ChangeLog:
    """The log in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    @property
    def _at(self) -> str:
        return f"{self.folder}/LOG"

    def state(self) -> dict | None:
        """base, batches {number: table}, roots, scanned_at; None if there is no log or its version is another."""
        found = published(self.spark, self._at)
        return found if found is not None and found.get("version") == VERSION else None

    def _needed(self) -> dict:
        state = self.state()
        if state is None:
            raise ValueError(f"{self.folder} has no log")
        return state

    def start(self, catalog: DataFrame, roots: list[str], scanned_at: int) -> None:
        """Begin anew with a scanned catalog; tables of an earlier log go."""
        old, name = self.state(), f"base-{uuid.uuid4().hex}"
        carrying(catalog).write.parquet(f"{self.folder}/{name}")
        publish(self.spark, self._at, {"version": VERSION, "base": name, "batches": {}, "roots": roots, "scanned_at": scanned_at})
        self._drop(old)

    def append(self, changes: DataFrame, number: int | None = None, exclusions: list[str] | None = None) -> None:
        """Add a batch. A batch with a number that the log has takes the place of the earlier one."""
        state, name = self._needed(), f"batch-{uuid.uuid4().hex}"
        key = str(max((int(k) for k in state["batches"]), default=-1) + 1 if number is None else number)
        folded_changes(changes, exclusions).write.parquet(f"{self.folder}/{name}")
        old = state["batches"].get(key)
        publish(self.spark, self._at, state | {"batches": state["batches"] | {key: name}})
        if old is not None:
            remove(self.spark, f"{self.folder}/{old}")

    def noted(self, scanned_at: int) -> None:
        """Note when the roots were last scanned."""
        publish(self.spark, self._at, self._needed() | {"scanned_at": scanned_at})

    def facts(self) -> DataFrame:
        """(path, up, del_seq) of all batches since the last compaction."""
        names = self._needed()["batches"].values()
        if not names:
            return self.spark.createDataFrame([], FACTS)
        return folded_facts(self.spark.read.schema(FACTS).parquet(*(f"{self.folder}/{n}" for n in names)))

    def merged(self) -> DataFrame:
        """The catalog with what it carries for later events."""
        state = self._needed()
        base = self.spark.read.parquet(f"{self.folder}/{state['base']}")
        return merge_facts(base, self.facts()) if state["batches"] else base

    def read(self) -> DataFrame:
        """The catalog as of now."""
        return shown(self.merged())

    def live(self) -> DataFrame:
        return self.read().where(~F.col("is_deleted"))

    def compact(self) -> None:
        """Write the merged catalog as the base. Batches that are appended meanwhile stay in the log."""
        before, name = self._needed(), f"base-{uuid.uuid4().hex}"
        if not before["batches"]:
            return
        self.merged().write.parquet(f"{self.folder}/{name}")
        now = self._needed()
        later = {k: n for k, n in now["batches"].items() if before["batches"].get(k) != n}
        publish(self.spark, self._at, now | {"base": name, "batches": later})
        self._drop(before)

    def _drop(self, state: dict | None) -> None:
        for name in [state["base"], *state["batches"].values()] if state else []:
            remove(self.spark, f"{self.folder}/{name}")
