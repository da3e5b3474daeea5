"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of the tokens, raised to an exponent and normalised. The exponent lies between 1 (the
shares as they are) and 0 (all sources alike) and is found by bisection: the largest that reaches a target entropy, or
the smallest that keeps every source within a limit of repetitions if that is larger. Budgets are scaled so that the
source with the least room is read exactly once; no document is left out, small sources repeat.

Each source is cut into blocks by hash. In every pass its blocks come in another permutation; whole passes fill the
budget, and a last pass takes blocks in order up to the budget, the block at the edge by its documents in hash order.
What decides is a hash of the block and, at the edge, of the document, so the plan is one small row per source and no
text is shuffled. Tokens are words plus one end mark.

Bounds: there are about ``MAX_BLOCKS`` blocks at most, whatever the corpus size. The plan has a row per source; up to
``MAX_SOURCES`` the driver bisects over their token counts and the plan is broadcast, beyond Spark adds up each step and the
plan is joined. The weights are the same.

Defined results: a null source is a source of its own. Null and empty texts count one token. Equal rows are in or out
together. An empty table gives an empty result. Columns named ``epoch`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored, table, words

MAX_SOURCES = 10_000
MAX_BLOCKS = 1 << 18
BLOCK_TOKENS = 1 << 18
#: Part of the greatest possible entropy that the mixture shall reach.
ENTROPY = 0.95
#: How often a document may be read at most.
REPEATS = 2.0


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    scale = sum(raised)
    return [r / scale for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[int], w: list[float]) -> list[float]:
    """Passes over each source if the least is one."""
    passes = [x / t for x, t in zip(w, tokens, strict=True)]
    least = min(passes)
    return [p / least for p in passes]


def bisect(holds: Callable[[float], bool]) -> float:
    """The edge in [0, 1] of a condition that holds at 0 and from some point on no more."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponent(tokens: list[int], target: float = ENTROPY, limit: float = REPEATS) -> float:
    """The exponent of the mixture, by two bisections."""

    if len(tokens) < 2:
        return 1.0
    even = bisect(lambda x: entropy(weights(tokens, x)) >= target * math.log(len(tokens)))
    spare = 1.0 - bisect(lambda y: max(repeats(tokens, weights(tokens, 1.0 - y))) <= limit)
    return max(even, spare)


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long") + 1


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def exponent_of(sources: DataFrame, target: float = ENTROPY, limit: float = REPEATS) -> float:
    """``exponent`` of a table of sources (t): every step of the bisection needs two sums, which Spark adds up."""
    given = sources.agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if given["n"] < 2:
        return 1.0
    share = F.col("t") / F.lit(float(given["total"]))

    def even(x: float) -> bool:
        raised = F.pow(share, F.lit(x))
        r = sources.agg(F.sum(raised).alias("s"), F.sum(raised * F.log(share)).alias("l")).first()
        return math.log(r["s"]) - x * r["l"] / r["s"] >= target * math.log(given["n"])

    return max(bisect(even), 1.0 - bisect(lambda y: (given["hi"] / given["lo"]) ** y <= limit))


def measured(docs: DataFrame) -> DataFrame:
    """(__s, __doc, t): the source, the hash and the tokens of every document, written once."""
    return stored(docs.select(_source().alias("__s"), F.xxhash64("doc_id", "text").alias("__doc"), token_count(F.col("text")).alias("t")), "measured")


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if few else df


def plan(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The plan, one row per source, and whether it is short enough to be broadcast.

    Columns: __s, blocks, whole (passes), left (tokens of the last pass), weight, and where that pass ends: turn and eb of the
    block at the edge, and the last hash in it.
    """
    facts = measured(docs)
    sources = stored(facts.groupBy("__s").agg(F.sum("t").alias("t")), "sources")
    total, n, least = sources.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("*"), F.min("t")).first()
    few = n <= MAX_SOURCES
    x = exponent([r["t"] for r in sources.orderBy("t").select("t").collect()]) if few else exponent_of(sources)
    block_tokens = max(BLOCK_TOKENS, total // MAX_BLOCKS)
    raised = F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(x))
    scale = sources.agg(F.sum(raised)).first()[0] or 1.0
    # Passes are scaled so that the largest source, which has the least room, is read once.
    most = sources.agg(F.max("t")).first()[0] or 1
    passes = F.pow(F.col("t") / F.lit(float(most)), F.lit(x - 1.0))
    whole = F.floor(passes + 1e-9)
    known = sources.select(
        "__s",
        F.ceil(F.col("t") / F.lit(float(block_tokens))).alias("blocks"),
        whole.alias("whole"),
        F.greatest(F.floor((passes - whole) * F.col("t")), F.lit(0)).alias("left"),
        (raised / F.lit(scale)).alias("weight"),
    )
    known = stored(known, "known")
    placed = _placed(facts.join(_small(known, few), "__s"))
    partial = placed.where("left > 0").select("__s", "__block", "__turn", "__order", "left", "t")
    blocks = partial.groupBy("__s", "__block", "__turn", "left").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy("__s").orderBy("__turn", "__block").rowsBetween(Window.unboundedPreceding, 0)
    edge = blocks.withColumn("c", F.sum("t").over(upto)).where("c > left").groupBy("__s").agg(F.min(F.struct(F.col("__turn").alias("turn"), F.col("__block").alias("eb"), (F.col("left") - F.col("c") + F.col("t")).alias("room"))).alias("e"))
    edges = stored(edge.select("__s", "e.*"), "edges")
    inside = partial.join(_small(edges, few), "__s").where("__block = eb")
    peers = Window.partitionBy("__s").orderBy("__order").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("c", F.sum("t").over(peers)).where("c <= room").groupBy("__s").agg(F.max("__order").alias("last"))
    return stored(known.join(edges.drop("room"), "__s", "left").join(last, "__s", "left"), "plan"), few


def _placed(joined: DataFrame) -> DataFrame:
    """Rows with __s, __doc and the plan, with their block and the hashes that order blocks and documents."""
    out = joined.withColumn("__block", F.pmod("__doc", "blocks"))
    return out.withColumn("__turn", F.xxhash64("__s", "__block", "whole")).withColumn("__order", F.xxhash64(F.lit(17), "__doc"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with a row for every reading, and columns ``epoch`` (0, 1, ...), ``weight`` of the source, and ``mix_key``.

    In the order of ``mix_key`` the sources are interleaved at their weights, each pass in its own permutation of blocks.
    """
    given = docs.drop("epoch", "weight", "mix_key")
    decided, few = plan(given)
    keyed = given.withColumn("__s", _source()).withColumn("__doc", F.xxhash64("doc_id", "text"))
    full = _placed(keyed.join(_small(decided, few), "__s"))
    before = (F.col("__turn") < F.col("turn")) | ((F.col("__turn") == F.col("turn")) & (F.col("__block") < F.col("eb")))
    at_edge = (F.col("__block") == F.col("eb")) & (F.col("__order") <= F.col("last"))
    again = F.when(F.col("left") == 0, F.lit(False)).when(F.col("turn").isNull(), F.lit(True)).otherwise(F.coalesce(before | at_edge, F.lit(False)))
    readings = F.col("whole") + again.cast("long")
    out = full.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), readings - 1)))
    turn = _unit(F.xxhash64("__s", "__block", "epoch"))
    within = _unit(F.xxhash64("__doc", "epoch")) / 1024
    return out.withColumn("mix_key", (F.col("epoch") + turn + within) / (F.col("whole") + 1)).select(*given.columns, "epoch", "weight", "mix_key")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document in the mixture."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "epoch", F.round("weight", 9).alias("weight"), F.round("mix_key", 9).alias("mix_key"))


QUERIES = {"op6_mixing_sources": op6_mixing_sources}
ORACLE_SQL: dict[str, str] = {}
