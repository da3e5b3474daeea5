"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: ``offset + j * skip`` modulo the size,
which visits each slot once because the size is prime. The shards take turns; at its turn a shard claims the first
slot of its order that is still free. A row is placed by hashing its key to a slot, so placement is one lookup in a
broadcast table of bounded size, shards differ by at most one slot, and adding or removing a shard moves few keys.

Main path: DataFrame functions only. The table itself is configuration (its size is bounded by ``MAX_SLOTS``) and is
filled on the driver.

Defined results: a null key is placed as the text ``\\N`` (one shard gets all of them, unless ``row`` is given and
hot keys are split); equal keys share a shard, unless hot; an empty table gives an empty result; other columns are
kept, and columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table

#: Upper bound of the lookup table, which is broadcast: about 2 MB.
MAX_SLOTS = 1 << 17
N_SHARDS = 256


def prime_at_least(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: list[str], size: int) -> list[int]:
    """For each of ``size`` slots the number of the shard that claimed it."""
    if not shards or size < len(shards) or size != prime_at_least(size):
        raise ValueError("the table needs a prime number of slots, at least one for each shard")
    if size > MAX_SLOTS:
        raise ValueError(f"the lookup table is broadcast and may have {MAX_SLOTS} slots at most")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "little") % size for d in seeds]
    skip = [int.from_bytes(d[8:16], "little") % (size - 1) + 1 if size > 1 else 0 for d in seeds]
    tried, owner, left = [0] * len(shards), [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while owner[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
                tried[i] += 1
            owner[slot] = i
            left -= 1
    return owner


def lookup(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """The table as rows (slot, shard), made on the JVM side."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\\N")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def shard(df: DataFrame, key: str, n_shards: int = N_SHARDS, row: str | None = None, shards: list[str] | None = None) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard``.

    ``row`` names a column that tells rows of one key apart. With it, a key that holds more than one shard's fair part
    of the rows is split into as many parts as it needs, each placed on its own. At most ``n_shards`` keys can hold so
    much, which bounds the broadcast list of hot keys.
    """
    shards = shards or [f"shard-{i}" for i in range(n_shards)]
    size = prime_at_least(100 * len(shards))
    base = df.drop("slot", "shard")
    placed = F.col(key).cast("string")
    if row is not None:
        counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("\\N")).alias("__key")).agg(F.count("*").alias("__n"))
        fair = F.greatest(F.ceil(F.lit(df.count()) / len(shards)), F.lit(1))
        hot = counts.where(F.col("__n") > fair).select("__key", F.ceil(F.col("__n") / fair).alias("__parts"))
        base = base.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\\N"))).join(F.broadcast(hot), "__key", "left")
        part = F.pmod(F.xxhash64(F.col(row)), F.col("__parts"))
        placed = F.when(F.col("__parts").isNull(), F.col("__key")).otherwise(F.concat_ws("#", "__key", part))
    out = base.withColumn("slot", slot_of(placed, size)).drop("__key", "__parts")
    table_ = F.broadcast(lookup(df.sparkSession, shards, size))
    return out.join(table_, "slot", "left").select(*base.drop("__key", "__parts").columns, "slot", "shard")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one folder per shard. Files are bounded by rows, and the write needs no shuffle."""
    sharded.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _sql() -> str:
    size = prime_at_least(100 * N_SHARDS)
    owners = ",".join(map(str, fill_table([f"shard-{i}" for i in range(N_SHARDS)], size)))
    return f"""
        WITH owners AS (SELECT string_split('{owners}', ',') AS o),
        placed AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {size} AS slot FROM documents)
        SELECT doc_id, slot, CAST(o[slot + 1] AS INTEGER) AS shard FROM placed, owners"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL = {"op1_sharding": _sql()}
