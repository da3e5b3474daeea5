"""A name index: for each three letters the ids of the names that hold them, so that a search reads postings and not names.

Ids are cut into ranges of ``RANGE``; a posting is the sorted ids of one trigram in one range, as differences in two bytes each,
which Parquet packs further. Postings are sorted by trigram, so the filter on the few trigrams of a term skips most row groups.
A range is intersected by itself: the shortest list is looked up in the others by halving steps, in a task that holds the
postings of one range. Rows are kept by range too; only ranges with candidates are read, and every candidate is tested.

Changes are added as an index of their own over the rows they touch; a posting whose row has another name by now, or is gone,
fails the test. Names are folded from A to Z, so the index serves searches with case and without.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import folded
from shelfmark.operators.catalog import COLUMNS
from shelfmark.operators.search import matches
from shelfmark.plans.parser import fold
from shelfmark.plans.spec import MatchMode, SearchSpec
from shelfmark.sources.published import publish, published

RANGE = 1 << 16
POSTINGS = "trigram string, range bigint, ids binary"
#: Ranges that are named in a filter; beyond, they are joined.
NAMED = 1_000


def trigrams(text: str) -> list[str]:
    """The distinct trigrams of a folded term."""
    low = fold(text)
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


def packed(ids: np.ndarray) -> bytes:
    """Sorted places within a range as differences."""
    return np.diff(ids, prepend=0).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2").astype(np.int64))


def intersected(lists: list[np.ndarray]) -> np.ndarray:
    """What all sorted lists hold, the shortest looked up in the others."""
    lists = sorted(lists, key=len)
    out = lists[0]
    for other in lists[1:]:
        at = np.searchsorted(other, out)
        out = out[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == out)] if len(other) else out[:0]
    return out


def postings(rows: DataFrame) -> DataFrame:
    """POSTINGS of (entry_id, name)."""
    low = folded(F.col("name"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substring(low, k, F.lit(3))))
    given = rows.where(F.length("name") >= 3).select(F.floor(F.col("entry_id") / RANGE).alias("range"), F.pmod("entry_id", F.lit(RANGE)).alias("place"), F.explode(grams).alias("trigram"))
    lists = given.groupBy("trigram", "range").agg(F.array_sort(F.collect_set("place")).alias("places"))  # at most RANGE places

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"trigram": batch["trigram"], "range": batch["range"], "ids": [packed(p) for p in batch["places"]]})

    return lists.mapInPandas(pack, POSTINGS)


@dataclass
class NameIndex:
    """The index in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _state(self) -> dict:
        return published(self.spark, f"{self.folder}/NAMES") or {"parts": []}

    def add(self, rows: DataFrame) -> None:
        """Index the rows of a catalog, or those that a change has touched; a later row of an id takes the place of earlier ones."""
        state, name = self._state(), f"part-{uuid.uuid4().hex}"
        kept = rows.select(*COLUMNS).withColumn("version", F.lit(len(state["parts"]))).withColumn("range", F.floor(F.col("entry_id") / RANGE))
        kept.repartition("range").sortWithinPartitions("range", "entry_id").write.option("parquet.block.size", 1 << 20).parquet(f"{self.folder}/{name}/rows")
        found = self.spark.read.parquet(f"{self.folder}/{name}/rows")
        postings(found).repartitionByRange("trigram", "range").sortWithinPartitions("trigram", "range").write.option("parquet.block.size", 1 << 20).parquet(f"{self.folder}/{name}/postings")
        publish(self.spark, f"{self.folder}/NAMES", {"parts": [*state["parts"], name]})

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{p}/{what}" for p in self._state()["parts"]))

    def rows(self) -> DataFrame:
        """The catalog: of each id the latest row."""
        newest = F.max_by(F.struct(*(c for c in COLUMNS if c != "entry_id")), "version")
        return self._read("rows").groupBy("range", "entry_id").agg(newest.alias("r")).select("range", "entry_id", "r.*")

    def candidates(self, terms: tuple[str, ...]) -> DataFrame | None:
        """(range, entry_id) of names that hold all trigrams of the terms; None where no term has any."""
        wanted = sorted({g for t in terms for g in trigrams(t)})
        if not wanted:
            return None

        def meet(lists: pd.DataFrame) -> pd.DataFrame:
            held: dict[str, list[np.ndarray]] = {}
            for gram, ids in zip(lists["trigram"], lists["ids"], strict=True):
                held.setdefault(gram, []).append(unpacked(ids))
            at = lists["range"].iloc[0]
            both = intersected([np.unique(np.concatenate(v)) for v in held.values()]) if len(held) == len(wanted) else np.zeros(0, np.int64)
            return pd.DataFrame({"range": np.full(len(both), at), "entry_id": at * RANGE + both})

        return self._read("postings").where(F.col("trigram").isin(wanted)).groupBy("range").applyInPandas(meet, "range long, entry_id long")

    def matches(self, spec: SearchSpec) -> DataFrame:
        """The rows that ``search.matches`` finds, with ``score``; by the index where the terms are substrings of three letters."""
        found = self.candidates(spec.terms) if spec.mode is MatchMode.SUBSTRING else None
        if found is None:
            return matches(self.rows().drop("range"), spec)
        at = [r["range"] for r in found.select("range").distinct().limit(NAMED + 1).collect()]
        rows = self.rows()
        if len(at) <= NAMED:
            rows = rows.where(F.col("range").isin(at)) if at else rows.limit(0)
        return matches(rows.join(found, ["range", "entry_id"]).drop("range"), spec)
