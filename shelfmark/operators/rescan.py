"""Opening a catalog or building it, and rescans as differences.

A rescan does not replace the catalog: what it finds is compared with what is held, and the difference is appended to the log as
change events, in proportion to what has changed. Folders are compared first, by digests of what is directly in them; rows are
joined only where a folder's digest differs, so equal folders cost an aggregate and no join of their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import parent_path
from shelfmark.operators.catalog import checkpointed, is_stale
from shelfmark.operators.changes import SCHEMA
from shelfmark.operators.log import ChangeLog
from shelfmark.plans.parser import normalize_hhmm

FACTS = ("is_dir", "size", "modified")


def folder_digests(rows: DataFrame) -> DataFrame:
    """(folder, n, a, b): how many rows are directly in a folder, and 128 bits of what they are, in any order."""
    hashed = lambda *salt: F.bit_xor(F.xxhash64(*salt, "path", *FACTS))
    return rows.groupBy(parent_path(F.col("path")).alias("folder")).agg(F.count("*").alias("n"), hashed().alias("a"), hashed(F.lit(1)).alias("b"))


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """(folder) whose contents differ; rows have a path and FACTS, and paths are distinct."""
    both = folder_digests(old).alias("o").join(folder_digests(new).alias("n"), F.col("o.folder") == F.col("n.folder"), "full")
    same = (F.col("o.n") == F.col("n.n")) & (F.col("o.a") == F.col("n.a")) & (F.col("o.b") == F.col("n.b"))
    return both.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("o.folder", "n.folder").alias("folder"))


def differences(held: DataFrame, scanned: DataFrame, seq: int) -> DataFrame:
    """The change rows, all of one ``seq``, that turn the live rows of ``held`` into those of ``scanned``.

    Of a folder that is gone only the topmost removal is told; it takes what lies below with it.
    """
    live = lambda df: df.where(~F.col("is_deleted")).select("path", *FACTS)
    old, new = live(held), live(scanned)
    folders = checkpointed(changed_folders(old, new))
    own = lambda df: df.withColumn("folder", parent_path(F.col("path"))).join(folders, "folder")
    before = own(old).select("path", F.col("folder").alias("__folder"), *(F.col(c).alias(f"__{c}") for c in FACTS), F.lit(True).alias("__old"))
    both = checkpointed(before.join(own(new).withColumn("__new", F.lit(True)), "path", "full"))
    differs = F.lit(False)
    for c in FACTS:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = both.where(F.col("__new").isNotNull() & (F.col("__old").isNull() | differs))
    gone = both.where("__new IS NULL").select("path", "__folder")
    top = gone.join(gone.select(F.col("path").alias("__folder")), "__folder", "left_anti")
    at, none = F.lit(seq).cast("long").alias("seq"), F.lit(0).cast("long")
    kind = F.when(F.col("__old").isNull(), "create").otherwise("modify").alias("kind")
    upserts = kept.select(at, kind, "path", F.lit(True).alias("exists"), *FACTS)
    removals = top.select(at, F.lit("remove").alias("kind"), "path", F.lit(False).alias("exists"), F.lit(False).alias("is_dir"), none.alias("size"), none.alias("modified"))
    return upserts.union(removals).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def rescan(log: ChangeLog, scanned: DataFrame, now: int) -> None:
    """Append what a scan has found to be different, as the latest event so far, and note when that was."""
    held = checkpointed(log.merged())
    last = held.agg(F.max("seq"), F.max("del_seq")).first()
    log.append(differences(held.where(F.col("base_dir").isNotNull() | ~F.col("is_deleted")), scanned, max((s for s in last if s is not None), default=0) + 1))
    log.noted(scanned_at=now)


def open_or_build(spark: SparkSession, folder: str, roots: list[str], scan: Callable[[], DataFrame], now: int, hours: int = 12) -> tuple[ChangeLog, str]:
    """The log of a folder and how it came to be: ``loaded``, ``refreshed`` where it was stale, ``built`` where there was none
    or it has other roots. A log that is fresh is not compared with anything."""
    log = ChangeLog(spark, folder)
    state = log.state()
    if state is None or state["roots"] != roots:
        log.start(scan(), roots, now)
        return log, "built"
    if is_stale(state["scanned_at"], state["roots"], roots, now, hours):
        rescan(log, scan(), now)
        return log, "refreshed"
    return log, "loaded"


def rescan_due(at: str, now: int, last: int, zone: str = "UTC") -> bool:
    """Whether the daily rescan at a time of day, as a user writes it, is to run: it has come since the last one.

    A time that is none never comes. A session that was away at that time catches up.
    """
    clock = normalize_hhmm(at)
    if clock is None:
        return False
    here = datetime.fromtimestamp(now, ZoneInfo(zone))
    today = here.replace(hour=int(clock[:2]), minute=int(clock[3:]), second=0, microsecond=0)
    latest = today if today <= here else today - timedelta(days=1)
    return last < int(latest.timestamp())
