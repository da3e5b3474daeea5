"""The catalog: one row per file or folder, its derivation from tables, parent pointers, and snapshots.

``catalog``: entry_id, parent_id (null for a root), name, path, is_dir, size, modified, is_deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import epoch_seconds, excluded
from shelfmark.sources.published import publish, published
from shelfmark.sources.shared import shared_folder

COLUMNS = ("entry_id", "parent_id", "name", "path", "is_dir", "size", "modified", "is_deleted")
SCHEMA = "entry_id bigint, parent_id bigint, name string, path string, is_dir boolean, size bigint, modified bigint, is_deleted boolean"
VERSION = 2
#: Longest chain of parents that a path follows, and that may lead to a root. Powers of two.
MAX_HOPS, MAX_CHAIN = 256, 512
#: Rows of one key that are joined in one task; more are dealt to several.
MOST = 100_000


def entries(df: DataFrame, entry_id: Column, name: Column, folder: Column, size: Column, modified: Column, is_dir: Column | None = None) -> DataFrame:
    """Catalog rows from a table; ``folder`` ends without a separator."""
    return df.select(
        entry_id.cast("long").alias("entry_id"),
        F.lit(None).cast("long").alias("parent_id"),
        name.alias("name"),
        F.concat(folder, F.lit("/"), name).alias("path"),
        (F.lit(False) if is_dir is None else is_dir).alias("is_dir"),
        size.cast("long").alias("size"),
        modified.cast("long").alias("modified"),
        F.lit(False).alias("is_deleted"),
    )


def _pick(key: Column, choices: str) -> Column:
    names = choices.split()
    return F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))


PART_KINDS = "txt pdf png mp3 mp4 zip py exe"
ITEM_KINDS = "csv docx jpg flac mkv tar rs dll"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the part table. Every seventh entry is a folder."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    is_dir = F.col("p_partkey") % 7 == 0
    name = F.when(is_dir, F.col("p_name")).otherwise(F.concat("p_name", F.lit("."), _pick(F.col("p_partkey"), PART_KINDS)))
    size = F.when(is_dir, F.lit(0)).otherwise(F.col("p_size").cast("long") * 1024)
    return entries(df, F.col("p_partkey"), name, F.concat(F.lit("/parts/"), F.col("p_brand")), size, F.lit(0), is_dir)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the lineitem table, the large one."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("item_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("."), _pick(F.col("l_partkey"), ITEM_KINDS))
    folder = F.concat(F.lit("/ship/"), F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return entries(df, key, name, folder, F.floor("l_extendedprice"), epoch_seconds(F.col("l_shipdate")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the documents table, with their ``text``."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.when(F.col("lang") == "en", F.lit("txt")).when(F.col("lang") == "fr", F.lit("md")).otherwise(F.lit("log"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), kind)
    folder = F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")))
    rows = entries(df.withColumn("__t", F.coalesce("text", F.lit(""))), F.col("doc_id"), name, folder, F.octet_length("__t"), F.lit(0))
    return rows


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, text) of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("entry_id"), "text")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent pointers over regions, nations, customers and orders: entry_id, parent_id, name, is_dir."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    levels = (
        t("region").select((F.col("r_regionkey").cast("long") * 10 + 1).alias("entry_id"), F.lit(None).cast("long").alias("parent_id"), F.concat(F.lit("/"), F.col("r_name")).alias("name"), F.lit(True).alias("is_dir")),
        t("nation").select(F.col("n_nationkey").cast("long") * 10 + 2, F.col("n_regionkey").cast("long") * 10 + 1, "n_name", F.lit(True)),
        t("customer").select(F.col("c_custkey") * 10 + 3, F.col("c_nationkey").cast("long") * 10 + 2, "c_name", F.lit(True)),
        t("orders").select(F.col("o_orderkey") * 10 + 4, F.col("o_custkey") * 10 + 3, F.concat(F.col("o_orderkey").cast("string"), F.lit(".ord")), F.lit(False)),
    )
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder that the session names."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _joined(head: Column, tail: Column) -> Column:
    """Two parts of a path, with a separator unless the first ends in one."""
    glue = F.when(F.endswith(head, F.lit("/")) | F.endswith(head, F.lit("\\")), F.lit("")).otherwise(F.lit("/"))
    return F.concat(head, glue, tail)


def joined_evenly(rows: DataFrame, other: DataFrame, key: str, spread: str, most: int = MOST) -> DataFrame:
    """``rows`` left-joined to ``other`` on ``key``, where any number of rows may have one key, or none.

    Rows without a key are dealt to all tasks, and a key of more than ``most`` rows to several, by the hash of ``spread``; each
    of them gets the rows of ``other``. There are at most rows / ``most`` such keys, so the list of them is small.
    """
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).where("__parts > 1")
    share = F.xxhash64(F.lit(7), spread)  # not the hash that deals rows to tasks
    salt = F.when(F.col(key).isNull(), F.pmod(share, F.lit(1 << 16))).otherwise(F.pmod(share, F.coalesce("__parts", F.lit(1))))
    left = rows.join(F.broadcast(many), key, "left").withColumn("__salt", salt.cast("int")).drop("__parts")
    right = other.join(F.broadcast(many), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def resolve_paths(nodes: DataFrame, max_hops: int = MAX_HOPS, most: int = MOST) -> DataFrame:
    """``path``, ``hops`` and ``root_id`` (where the path begins) for rows with parent pointers, by pointer doubling.

    A parent that is missing or no folder ends the path, which then starts at the child. The walk stops after ``max_hops``
    (a power of two): a path in a longer chain, or in a circle, has its last ``max_hops + 1`` names. Each round joins on the
    ancestor and doubles the distance, so the number of shuffles grows with the logarithm of the depth. Only folders take part
    in the rounds, and only those whose path is open are joined; what is no folder gets its path from its parent, in one join.
    """
    folders = nodes.where(F.col("is_dir") & F.col("entry_id").isNotNull())
    known = folders.select(F.col("entry_id").alias("parent_id")).distinct().withColumn("__known", F.lit(True))
    linked = joined_evenly(folders.select("entry_id", "parent_id", "name"), known, "parent_id", "entry_id", most)
    state = checkpointed(linked.select("entry_id", F.when(F.col("__known"), F.col("parent_id")).alias("anc"), F.col("name").alias("path"), F.lit(0).alias("hops"), F.col("entry_id").alias("root_id")))
    found = F.col("head").isNotNull()
    longer, more = F.when(found, _joined(F.col("head"), F.col("path"))).otherwise(F.col("path")), F.when(found, F.col("hops") + F.col("more") + 1).otherwise(F.col("hops"))
    is_open = F.col("anc").isNotNull()
    for _ in range(max_hops.bit_length() - 1):
        if not state.where(is_open).take(1):
            break
        above = state.select(F.col("entry_id").alias("anc"), F.col("anc").alias("next"), F.col("path").alias("head"), F.col("hops").alias("more"), F.col("root_id").alias("top"))
        joined = joined_evenly(state.where(is_open), above, "anc", "entry_id", most)
        doubled = joined.select("entry_id", F.col("next").alias("anc"), longer.alias("path"), more.alias("hops"), F.coalesce("top", "root_id").alias("root_id"))
        state = checkpointed(state.where(~is_open).union(doubled))

    # A parent whose path is still open has max_hops names, and with its child's there is one more.
    own = nodes.where(~F.coalesce("is_dir", F.lit(False)) & F.col("entry_id").isNotNull()).drop("path").withColumn("__name", F.col("name"))
    above = state.select(F.col("entry_id").alias("parent_id"), F.col("path").alias("head"), F.col("hops").alias("more"), F.col("root_id").alias("top"))
    files = joined_evenly(own, above, "parent_id", "entry_id", most).withColumn("path", F.col("__name")).withColumn("hops", F.lit(0))
    # A folder that is still open has max_hops names too; the one above them is the last.
    last = folders.select(F.col("entry_id").alias("anc"), F.col("name").alias("head"), F.lit(0).alias("more"), F.col("entry_id").alias("top"))
    opened = joined_evenly(state.where(is_open), last, "anc", "entry_id", most)
    closed = state.where(~is_open).select("entry_id", "path", "hops", "root_id")
    done = closed.union(opened.select("entry_id", longer.alias("path"), more.alias("hops"), F.coalesce("top", "root_id").alias("root_id")))
    columns = ("entry_id", *(c for c in nodes.columns if c not in ("entry_id", "path")))
    whole = folders.drop("path").join(done, "entry_id").select(*columns, "path", "hops", "root_id")
    return whole.union(files.select(*columns, longer.alias("path"), more.alias("hops"), F.coalesce("top", "entry_id").alias("root_id")))


def reachable(nodes: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Resolved rows below a root: orphans are dropped, and whole subtrees of excluded folders."""
    roots = nodes.where("parent_id IS NULL").select(F.col("entry_id").alias("root_id"))
    rooted = resolve_paths(nodes, MAX_CHAIN).join(roots, "root_id", "left_semi")
    return rooted.where(~excluded(F.col("path"), patterns)) if patterns else rooted


def derive_folders(catalog: DataFrame) -> DataFrame:
    """Every folder that the paths of a catalog imply: path, name, depth, n_entries (anywhere below)."""
    steps = F.split("path", "/", -1)
    up = F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))
    found = catalog.where(F.size(steps) > 2).select(F.explode(up).alias("path")).groupBy("path").agg(F.count("*").alias("n_entries"))
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), (F.size(F.split("path", "/", -1)) - 1).cast("long").alias("depth"), "n_entries")


def fill_metadata(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """``catalog`` with size and modified from ``metadata`` (entry_id, size, modified) for live rows whose time is unknown."""
    new = metadata.select("entry_id", F.col("size").alias("__size"), F.col("modified").alias("__modified"))
    fill = ~F.col("is_deleted") & (F.col("modified") == 0) & F.col("__modified").isNotNull()
    out = catalog.join(new, "entry_id", "left")
    size = F.when(fill & ~F.col("is_dir"), F.col("__size")).otherwise(F.col("size"))
    return out.select(*(size.alias(c) if c == "size" else F.when(fill, F.col("__modified")).otherwise(F.col("modified")).alias(c) if c == "modified" else F.col(c) for c in catalog.columns))


def live_count(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.col("is_deleted")).agg(F.count("*").alias("live"))


# Snapshots: a table per version, published by replacing one small pointer table.


def save_snapshot(catalog: DataFrame, folder: str, roots: list[str], scanned_at: int) -> str:
    """Write a snapshot and point to it; readers see the old one until the pointer is replaced."""
    name = f"snapshot-{uuid.uuid4().hex}"
    catalog.write.parquet(f"{folder}/{name}")
    publish(catalog.sparkSession, f"{folder}/POINTER", {"version": VERSION, "snapshot": name, "roots": roots, "scanned_at": scanned_at})
    return name


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], int] | None:
    """(catalog, roots, scanned_at) of the published snapshot; None if there is none or its version is another."""
    meta = published(spark, f"{folder}/POINTER")
    if meta is None or meta.get("version") != VERSION:
        return None
    return spark.read.parquet(f"{folder}/{meta['snapshot']}"), list(meta["roots"]), meta["scanned_at"]


def is_stale(scanned_at: int, roots: list[str], wanted: list[str], now: int, hours: int = 12) -> bool:
    """Whether a snapshot must be scanned anew: never scanned, too old, or of other roots."""
    return scanned_at == 0 or roots != wanted or now - scanned_at > hours * 3600
