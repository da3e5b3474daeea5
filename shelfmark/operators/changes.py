"""Incremental maintenance: change events folded into facts, facts merged into a catalog, in one batch or in any number.

``changes``: seq, kind (create, modify, remove, any, other, access), path, exists, is_dir, size, modified.

What the events say of a path is two facts: its last upsert, and its last removal. Both are maxima by ``seq``, so batches can be
folded in any split and order, late or twice, and give the same catalog. The catalog that ``merge`` returns carries the facts:

``base_dir``: whether a scanned row is a folder; null for a row that events made. ``up_seq``, ``up_dir``, ``up_size``,
``up_modified``: the last upsert. ``del_seq``: the last removal of the path itself, kept for unknown paths too. ``seq``: the event
that decides what the row shows. Rows that events made and that do not live are there for later events only; ``shown`` leaves
them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import base_name, excluded, parent_path
from shelfmark.operators.catalog import COLUMNS, checkpointed
from shelfmark.operators.intervals import ranged, removed_at

SCHEMA = "seq bigint, kind string, path string, exists boolean, is_dir boolean, size bigint, modified bigint"
#: What a catalog carries besides its own columns.
FACTS = {"seq": "long", "base_dir": "boolean", "up_seq": "long", "up_dir": "boolean", "up_size": "long", "up_modified": "long", "del_seq": "long"}


def operation(kind: Column, exists: Column) -> Column:
    """upsert, delete or none."""
    touches = kind.isin("create", "modify", "any", "other")
    return F.when(kind == "remove", "delete").when(touches & exists, "upsert").when(touches, "delete").otherwise("none")


def classified(changes: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """``changes`` with ``op``; excluded paths do nothing."""
    op = operation(F.col("kind"), F.col("exists"))
    return changes.withColumn("op", F.when(excluded(F.col("path"), exclusions), F.lit("none")).otherwise(op) if exclusions else op)


def folded_changes(changes: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """(path, up, del_seq): the facts of each path. A busy path is combined before the shuffle."""
    up = F.max(F.when(F.col("op") == "upsert", F.struct("seq", "is_dir", "size", "modified")))
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq")))
    return classified(changes, exclusions).where("op <> 'none'").groupBy("path").agg(up.alias("up"), gone.alias("del_seq"))


def folded_facts(facts: DataFrame) -> DataFrame:
    """Facts of several batches as one."""
    return facts.groupBy("path").agg(F.max("up").alias("up"), F.max("del_seq").alias("del_seq"))


def carrying(catalog: DataFrame) -> DataFrame:
    """A catalog with the columns of FACTS; one that has none is taken as scanned."""
    if "base_dir" in catalog.columns:
        return catalog
    scanned = {"base_dir": F.col("is_dir")}
    return catalog.select(*COLUMNS, *(scanned.get(c, F.lit(None)).cast(t).alias(c) for c, t in FACTS.items()))


def merge(catalog: DataFrame, changes: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """The catalog after the changes; see ``merge_facts``."""
    return merge_facts(catalog, folded_changes(changes, exclusions))


def merge_facts(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """The catalog after events folded into facts.

    A row lives if its last upsert is later than the last removal of it or of a folder above it; a scanned row also if it has
    neither. What events made needs a folder that the catalog or an event names, whenever that becomes known. A path that
    turns from file to folder, or back, keeps its id. A folder has size 0. A row that events removed has the kind it was
    scanned with, and size and time 0. New rows get the next ids in the order of their paths when they first live.
    """
    held = carrying(catalog)
    new = facts.select(F.col("path").alias("__path"), F.col("up").alias("__up"), F.col("del_seq").alias("__del"))
    both = held.join(new, held["path"] == new["__path"], "full").withColumn("path", F.coalesce("path", "__path"))
    old_up = F.when(F.col("up_seq").isNotNull(), F.struct(F.col("up_seq").alias("seq"), F.col("up_dir").alias("is_dir"), F.col("up_size").alias("size"), F.col("up_modified").alias("modified")))
    both = both.withColumn("__last", F.when(F.col("__up").isNull(), old_up).when(old_up.isNull(), F.col("__up")).otherwise(F.greatest(old_up, F.col("__up"))))
    known = checkpointed(
        both.select(
            *("entry_id", "parent_id", F.coalesce("name", base_name(F.col("path"))).alias("name"), "path", "size", "modified", "is_deleted", "base_dir"),
            *(F.col(f"__last.{a}").alias(b) for a, b in (("seq", "up_seq"), ("is_dir", "up_dir"), ("size", "up_size"), ("modified", "up_modified"))),
            F.greatest("del_seq", "__del").alias("del_seq"),
        )
    )
    reach = removed_at(known.select("path").distinct(), known.where("del_seq IS NOT NULL").groupBy("path").agg(F.max("del_seq").alias("seq")))
    folders = known.where(F.coalesce("up_dir", "base_dir")).select(F.col("path").alias("__parent"), F.lit(True).alias("__known")).distinct()
    rows = known.join(reach, "path", "left").withColumn("__parent", parent_path(F.col("path"))).join(folders, "__parent", "left")

    up, scanned = F.col("up_seq").isNotNull(), F.col("base_dir").isNotNull()
    lives = F.when(up, (scanned | F.coalesce("__known", F.lit(False))) & (F.col("removed_at").isNull() | (F.col("up_seq") > F.col("removed_at"))))
    lives = lives.otherwise(scanned & F.col("removed_at").isNull() & ~F.coalesce("is_deleted", F.lit(False)))
    by_event = up | F.col("removed_at").isNotNull()
    rows = rows.withColumn("__lives", lives)
    value = lambda new, old: F.when(F.col("__lives") & up, new).when(by_event, F.lit(0)).otherwise(old).cast("long")
    done = rows.select(
        "entry_id",
        "parent_id",
        "name",
        "path",
        F.when(F.col("__lives") & up, F.col("up_dir")).otherwise(F.coalesce("base_dir", "up_dir", F.lit(False))).alias("is_dir"),
        value(F.when(F.col("up_dir"), F.lit(0)).otherwise(F.col("up_size")), F.col("size")).alias("size"),
        value(F.col("up_modified"), F.col("modified")).alias("modified"),
        (~F.col("__lives")).alias("is_deleted"),
        F.when(F.col("__lives"), F.col("up_seq")).otherwise(F.greatest("up_seq", "removed_at")).alias("seq"),
        *(c for c in FACTS if c != "seq"),
    )
    return with_new_ids(checkpointed(done), ~F.col("is_deleted"))


def shown(catalog: DataFrame) -> DataFrame:
    """The rows of a merged catalog without those that only events have named and that do not live."""
    return catalog.where(F.col("base_dir").isNotNull() | ~F.col("is_deleted"))


def with_new_ids(rows: DataFrame, wanted: Column | None = None, after: int = -1) -> DataFrame:
    """Rows without an id get the next ones in the order of their paths, those that are ``wanted``; ids begin after ``after``.

    The order is by range partitions: positions within a partition plus the number of rows before it, so no single task
    sees all new rows. They are written first, as a partition that is computed anew could get other rows. ``rows`` is read
    three times, so it should be written itself.
    """
    wanted = F.col("entry_id").isNull() & (F.lit(True) if wanted is None else wanted)
    fresh = ranged(rows.where(wanted), "path")
    start = rows.agg(F.max("entry_id").alias("m")).select((F.greatest("m", F.lit(after)) + 1).alias("__start"))
    sizes = fresh.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))  # a row per partition
    given = fresh.join(F.broadcast(before), "__p").join(F.broadcast(start))
    given = given.withColumn("entry_id", (F.col("__start") + F.col("__before") + F.col("__at")).cast("long")).select(*rows.columns)
    return rows.where(~wanted).union(given)


def removals(paths: DataFrame, seq: int) -> DataFrame:
    """Change rows that remove the given paths. Files are never touched."""
    return paths.select(
        F.lit(seq).cast("long").alias("seq"), F.lit("remove").alias("kind"), "path", F.lit(False).alias("exists"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified")
    )
