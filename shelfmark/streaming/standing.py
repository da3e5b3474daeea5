"""Standing queries: a ranked top-k and its total, kept up with the change feed by keyed state.

A search that stays open is not run again for every batch. Rows are dealt by hashed path to ``buckets``; a bucket's state store
holds its matching rows by path, its total, and the best of them, some more than k. A change touches the rows it names. A row
that enters is put in its place among the best; where so many leave that fewer than k are known, the best are filled up from
the bucket's rows. A removal goes to every bucket, as it takes all that lies below a folder with it, and stays in the state, so
events may come late or twice. A batch emits the best of the buckets it touched; the answer is the best of all buckets.

The order is by score, then path. Events are taken to name paths whose folders are known.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.functions.scalars import base_name
from shelfmark.operators.changes import classified
from shelfmark.operators.search import HITS, matches
from shelfmark.plans.spec import Category, SearchSpec

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMITTED = "bucket int, total bigint, score bigint, name string, path string, is_dir boolean, size bigint, modified bigint"
SHOWN = tuple(c for c in HITS if c != "entry_id")


def dealt(changes: DataFrame, spec: SearchSpec, category: Category, buckets: int) -> DataFrame:
    """Events as rows of buckets, with the score they have in the query: null where they do not match."""
    events = classified(changes).where("op <> 'none'").withColumn("name", base_name(F.col("path")))
    size = F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size")
    rows = events.select("seq", "op", "path", "name", "is_dir", size, "modified", F.lit(False).alias("is_deleted"))
    found = matches(rows, spec, category).select("seq", "op", "path", "name", "is_dir", "size", "modified", "score").where("op = 'upsert'")
    # What does not match must be known too: it may have matched before.
    other = rows.select("seq", "op", "path", "name", "is_dir", "size", "modified", F.lit(None).cast("long").alias("score"))
    own = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    everywhere = F.when(F.col("op") == "delete", F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(own))
    return found.unionByName(other).withColumn("bucket", F.explode(everywhere))


class TopK(StatefulProcessor):
    """The state of one bucket. ``rows``: what lives, by path, and when that was decided; ``gone``: removals, by path."""

    def __init__(self, k: int, slack: int):
        self.k, self.most = k, k + slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "seq bigint, score bigint, name string, is_dir boolean, size bigint, modified bigint"
        self.rows = handle.getMapState("rows", "path string", row)
        self.gone = handle.getMapState("gone", "path string", "seq bigint")
        self.best = handle.getValueState("best", "total bigint, shown string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        puts: dict[str, tuple] = {}
        drops: dict[str, int] = {}
        for frame in rows:
            for seq, op, path, name, is_dir, size, modified, score in zip(*(frame[c] for c in ("seq", "op", "path", "name", "is_dir", "size", "modified", "score")), strict=True):
                if op == "delete":
                    drops[path] = max(int(seq), drops.get(path, -1))
                else:
                    given = None if pd.isna(score) else int(score)
                    new = (int(seq), given, name, bool(is_dir), int(size), int(modified))
                    old = puts.get(path)
                    # A matching event comes with a score and without.
                    if old is None or new[0] > old[0] or (new[0] == old[0] and old[1] is None):
                        puts[path] = new
        state = self.best.get() if self.best.exists() else (0, "[]")
        self.total = state[0]
        self.shown = {path: (-score, path) for score, path in json.loads(state[1])}
        drops = {p: s for p, s in drops.items() if not self.gone.containsKey((p,)) or self.gone.getValue((p,))[0] < s}
        self._apply_drops(drops)
        known: dict[str, int] = {}
        for path, new in puts.items():
            self._put(path, new, known)
        if len(self.shown) < min(self.k, self.total):
            self._refill()
        order = sorted(self.shown.values())[: self.most]
        self.best.update((self.total, json.dumps([[-s, p] for s, p in order])))
        out = []
        for s, path in order[: self.k]:
            row = self.rows.getValue((path,))
            out.append((key[0], self.total, -s, row[2], path, row[3], row[4], row[5]))
        columns = [c.split()[0] for c in EMITTED.split(", ")]
        yield pd.DataFrame(out or [(key[0], self.total, None, None, None, None, None, None)], columns=columns)

    def _leave(self, path: str, score: int | None) -> None:
        if score is not None:
            self.total -= 1
            self.shown.pop(path, None)

    def _apply_drops(self, drops: dict[str, int]) -> None:
        wide = {}
        for path, seq in drops.items():
            self.gone.updateValue((path,), (seq,))
            held = self.rows.getValue((path,)) if self.rows.containsKey((path,)) else None
            if held is None or held[3]:
                wide[path] = seq  # may be a folder
            if held is not None and held[0] < seq:
                self._leave(path, held[1])
                self.rows.removeKey((path,))
        if wide:
            below = [(path, row[0], row[1]) for (path,), row in self.rows.iterator() if any(wide.get(f, -1) > row[0] for f in _above(path))]
            for path, _, score in below:
                self._leave(path, score)
                self.rows.removeKey((path,))

    def _put(self, path: str, new: tuple, known: dict[str, int]) -> None:
        for at in (path, *_above(path)):
            if at not in known:
                known[at] = self.gone.getValue((at,))[0] if self.gone.containsKey((at,)) else -1
            if known[at] > new[0]:
                return
        held = self.rows.getValue((path,)) if self.rows.containsKey((path,)) else None
        if held is not None:
            if held[0] >= new[0]:
                return
            self._leave(path, held[1])
        complete = len(self.shown) == self.total
        self.rows.updateValue((path,), new)
        if new[1] is not None:
            self.total += 1
            place = (-new[1], path)
            # Beyond the worst that is shown there may be better ones in the state.
            if complete or (self.shown and place < max(self.shown.values())):
                self.shown[path] = place
                if len(self.shown) > 2 * self.most:
                    self.shown = {p: s for s, p in ((x, x[1]) for x in sorted(self.shown.values())[: self.most])}

    def _refill(self) -> None:
        best = sorted((-row[1], path) for (path,), row in self.rows.iterator() if row[1] is not None)
        self.shown = {p: (s, p) for s, p in best[: self.most]}

    def close(self) -> None:
        pass


def _above(path: str) -> list[str]:
    """The folders above a path."""
    parts = path.split("/")
    return ["/".join(parts[:k]) or "/" for k in range(1, len(parts))]


def standing(changes: DataFrame, spec: SearchSpec, folder: str, checkpoint: str, k: int = 1_000, slack: int | None = None, category: Category = Category.ALL, buckets: int = 8, on_commit: Callable[[int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Keep the answer of a query in ``folder`` while ``changes`` come; the catalog itself comes first, as creations."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = dealt(changes, spec, category, buckets)
    best = rows.groupBy("bucket").transformWithStateInPandas(TopK(k, k if slack is None else slack), outputStructType=EMITTED, outputMode="Update", timeMode="None")

    def commit(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if on_commit is not None:
            on_commit(number)

    writer = best.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def answer(spark: SparkSession, folder: str, k: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(hits, totals) as of the last batch: of each bucket what it emitted last, at most k rows a bucket."""
    kept = spark.read.schema(EMITTED + ", batch bigint").parquet(folder)
    newest = kept.withColumn("__last", F.max("batch").over(Window.partitionBy("bucket"))).where("batch = __last")
    totals = newest.groupBy("bucket").agg(F.max("total").alias("total")).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    hits = newest.where("path IS NOT NULL").orderBy(F.desc("score"), "path").limit(k).select(*SHOWN)
    return hits, totals.withColumn("truncated", F.col("total") > k)
