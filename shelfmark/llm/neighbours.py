"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

1. Equal vectors are one entry of the index, with the least ``k + 1`` of their ids: no answer needs more of them. They are
   found by a 128-bit hash; only ids and hashes are shuffled for that, ranked in two steps so that no task gets all copies.
2. The tree is fitted on at most ``SAMPLE`` distinct vectors, chosen by hash: every node is split into up to ``BRANCH``
   clusters by Lloyd's iterations until a leaf stands for about ``LEAF`` vectors; there are at most ``MAX_LEAVES``. All
   vectors go down the tree to a leaf; the tree is what the workers are sent (``MAX_LEAVES`` centres and those above).
3. Calibration: for up to ``CALIBRATION`` query vectors the true neighbours are found by comparing them with all vectors.
   Leaves are visited best bin first, from a priority queue of tree nodes by the distance of their centres, and the number
   of visits is widened until ``target`` of the true neighbours lie in the leaves visited.
4. Leaves are laid out in parts of at most ``PART`` vectors (and ``PARTS`` parts at least); a leaf of any size is spread over
   parts. A query goes once to each part that holds a leaf it visits. A task holds one part and streams the queries.
   Distances are exact, in double precision, on the original vectors. Each part gives the best of a query, the best of all
   parts are the answer.

Defined results: vectors that are null, empty, zero or hold a null or a number that is not finite take no part, as do rows
without an id, and vectors of another length than the most frequent one (of equally frequent lengths the smallest). Rows
that repeat an id and its vector count once; an id with several vectors is searched by each and found by each, the nearest
counts. No query is its own neighbour. Fewer than ``k`` candidates give fewer rows; an empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import release, stored, table

SAMPLE = 65_536
LEAF = 256
MAX_LEAVES = 4_096
BRANCH = 16
CALIBRATION = 256
TARGET = 0.95
PART = 131_072
PARTS = 32
#: Numbers in a block of distances that a task computes at once.
BLOCK = 4_000_000


@dataclass
class Tree:
    """Nodes in an array: ``first`` child and number of children (0 for a leaf), ``leaf`` number or -1."""

    centres: np.ndarray
    first: np.ndarray
    size: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest child at each level."""
        at = np.zeros(len(x), np.int64)
        while True:
            moved = False
            for node in np.unique(at):
                n = self.size[node]
                if n:
                    rows = np.flatnonzero(at == node)
                    children = slice(self.first[node], self.first[node] + n)
                    at[rows] = self.first[node] + gaps(x[rows], self.centres[children]).argmin(axis=1)
                    moved = True
            if not moved:
                return self.leaf[at]

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            n, first = self.size[node], self.first[node]
            if n:
                for d, child in zip(gaps(q[None], self.centres[first : first + n])[0], range(first, first + n), strict=True):
                    heapq.heappush(heap, (d, child))
            else:
                out.append(int(self.leaf[node]))
        return out


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to those of y, up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2.0 * (x @ y.T), 0.0)


def lloyd(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the cluster of every row; clusters that get no row are left out."""
    centres = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = gaps(x, centres).argmin(axis=1)
        used, near = np.unique(near, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, near, x)
        centres = sums / np.bincount(near, minlength=len(used))[:, None]
    return centres, gaps(x, centres).argmin(axis=1)


def fit_tree(x: np.ndarray, leaves: int, branch: int = BRANCH) -> Tree:
    """A tree of about ``leaves`` leaves; a cluster gets leaves by its share of the sample."""
    x = np.unique(x, axis=0)
    nodes = [[x.mean(axis=0), 0, 0, -1]]
    todo, n_leaves = [(0, x, leaves)], 0
    while todo:
        node, rows, share = todo.pop(0)
        k = min(branch, share, len(rows))
        centres, near = lloyd(rows, k) if k > 1 else (rows[:1], np.zeros(len(rows), np.int64))
        if k <= 1 or len(centres) <= 1:
            nodes[node][3] = n_leaves
            n_leaves += 1
            continue
        nodes[node][1:3] = len(nodes), len(centres)
        for j, centre in enumerate(centres):
            own = rows[near == j]
            todo.append((len(nodes), own, max(1, round(share * len(own) / len(rows)))))
            nodes.append([centre, 0, 0, -1])
    return Tree(np.array([n[0] for n in nodes]), *(np.array([n[i] for n in nodes], np.int64) for i in (1, 2, 3)))


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(q: np.ndarray, x: np.ndarray, allowed: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the places and exact distances of at least its nearest ``most`` rows of x among the allowed ones.

    Products find the candidates, with a margin for their rounding; the candidates are measured by differences.
    """
    approx = gaps(q, x)
    if allowed is not None:
        approx[~allowed] = np.inf
    margin = 1e-9 * (1.0 + (q * q).sum(1) + (x * x).sum(1).max(initial=0.0))
    for row, a, m in zip(q, approx, margin, strict=True):
        k = min(most, len(a))
        bound = np.partition(a, k - 1)[k - 1] if k else -1.0
        near = np.flatnonzero((a <= bound + m) & np.isfinite(a))
        yield near, np.sqrt(((x[near] - row) ** 2).sum(axis=1))


def entries(rows: DataFrame, k: int, query: Column) -> DataFrame:
    """(vec_id, a, b, ids, asks, repeated): for each distinct vector its least id, the least k + 1 ids, whether one of all its
    ids is a query, and whether the row of the least id is repeated."""
    once = rows.groupBy("vec_id", "a", "b").agg((F.count("*") > 1).alias("repeated")).withColumn("__s", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    few = once.withColumn("__r", order("a", "b", "__s")).where(F.col("__r") <= k + 1).withColumn("__r", order("a", "b")).where(F.col("__r") <= k + 1)
    least = few.groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("repeated", "vec_id").alias("repeated"))
    asks = rows.where(query).select("a", "b").distinct().withColumn("asks", F.lit(True))
    return least.join(asks, ["a", "b"], "left").select(F.get("ids", 0).alias("vec_id"), "a", "b", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), "repeated")


def build(vectors: DataFrame, query: Column, k: int = 10, leaf: int = LEAF, sample: int = SAMPLE, max_leaves: int = MAX_LEAVES) -> tuple[Tree | None, DataFrame, DataFrame]:
    """The tree, the stored index (leaf, a, b, ids, asks, vec) of all distinct vectors, and the usable rows (vec_id, vec, a, b)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("vec") == (common["n"] if common else 0)).withColumn("a", F.xxhash64("vec")).withColumn("b", F.xxhash64(F.lit(1), "vec"))
    held = stored(entries(rows.select("vec_id", "a", "b"), k, query), "entries")
    total, repeated = held.agg(F.count("*"), F.max("repeated")).first()
    if not total:
        return None, held, rows
    # An id may have several vectors, so the hashes belong to the key.
    given = rows.dropDuplicates(["vec_id", "a", "b"]) if repeated else rows
    own = given.join(held.drop("repeated"), ["vec_id", "a", "b"])
    leaves = max(1, min(max_leaves, -(-total // leaf)))
    share = min(1.0, min(sample, max(64 * leaves, 4 * leaf)) / total)
    chosen = rows.where(F.pmod("b", F.lit(1_000_003)) < F.ceil(F.lit(share) * 1_000_003)).select("vec", "b").dropDuplicates(["b"]).orderBy("b").limit(sample)
    tree = fit_tree(_collected(chosen), leaves)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    kinds = ", ".join(f"{n} {t}" for n, t in own.dtypes)
    index = stored(own.mapInArrow(assign, f"{kinds}, leaf long"), "index")
    release(held)
    return tree, index, rows


def _collected(rows: DataFrame) -> np.ndarray:
    """The vectors of a bounded number of rows."""
    found = rows.select("vec").toArrow().column("vec").combine_chunks()
    return matrix(found)


def calibrate(index: DataFrame, tree: Tree, k: int, target: float, queries: int = CALIBRATION) -> int:
    """The number of leaves to visit so that the target share of the true neighbours of a sample of queries is met."""
    asked = index.where("asks").orderBy(F.xxhash64("a", "b")).limit(queries).select("a", "b", "vec").toArrow()
    if not asked.num_rows:
        return 1
    q = matrix(asked.column("vec").combine_chunks())
    own = list(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True))
    shared = index.sparkSession.sparkContext.broadcast((q, own))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            x, leaf = matrix(batch.column("vec")), batch.column("leaf").to_numpy()
            keys = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            step = max(1, BLOCK // len(q))
            for s in range(0, len(x), step):
                for i, (near, d) in enumerate(nearest(q, x[s : s + step], None, k + 1)):
                    found = [(v, *keys[s + p], int(leaf[s + p])) for v, p in zip(d.tolist(), near.tolist(), strict=True) if keys[s + p] != own[i]]
                    best[i] = heapq.nsmallest(k, best[i] + found)
        rows = [(i, *t) for i, found in enumerate(best) for t in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["q", "d", "a", "b", "leaf"])

    found = index.select("a", "b", "vec", "leaf").mapInArrow(compare, "q long, d double, a long, b long, leaf long").withColumn("__s", F.pmod("a", F.lit(8)))
    order = lambda *by: F.row_number().over(Window.partitionBy("q", *by).orderBy("d", "a", "b"))
    best = found.withColumn("__r", order("__s")).where(F.col("__r") <= k).withColumn("__r", order()).where(F.col("__r") <= k).select("q", "leaf").collect()
    where = [{leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))} for v in q]
    needed = np.array([where[r["q"]][r["leaf"]] + 1 for r in best])
    visits = 1
    while visits < tree.leaves and len(needed) and (needed <= visits).mean() < target:
        visits += max(1, visits // 20)  # widen by a twentieth
    return min(visits, tree.leaves)


@dataclass
class Layout:
    """Where the vectors of a leaf lie: from ``start``, ``count`` places; ``part`` places are a part."""

    start: np.ndarray
    count: np.ndarray
    part: int

    def parts_of(self, leaf: int) -> range:
        if not self.count[leaf]:
            return range(0)
        return range(self.start[leaf] // self.part, (self.start[leaf] + self.count[leaf] - 1) // self.part + 1)


def lay_out(index: DataFrame, leaves: int, part: int = PART, parts: int = PARTS) -> Layout:
    """Leaves one after the other: a row for each of at most MAX_LEAVES leaves reaches the driver."""
    count = np.zeros(leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        count[r["leaf"]] = r["n"]
    total = int(count.sum())
    return Layout(np.cumsum(count) - count, count, max(1, min(part, -(-total // parts))))


def search(index: DataFrame, tree: Tree, layout: Layout, visits: int, k: int) -> DataFrame:
    """(a, b, best): for each distinct query vector the nearest k + 1 pairs (score, vec_id) found, nearest first."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((tree, layout))
    values = index.schema["vec"].dataType.elementType.simpleString()
    shape = f"part long, kind int, leaf long, a long, b long, ids array<long>, vec array<{values}>, leaves array<long>"
    names = [c.split()[0] for c in shape.split(", ")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lay = shared.value
        for batch in batches:
            leaf, n = batch.column("leaf").to_numpy(), batch.num_rows
            place = lay.start[leaf] + batch.column("a").to_numpy() % lay.count[leaf]  # a leaf is spread evenly over its places
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(place // lay.part), pa.array(np.zeros(n, np.int32)), *(batch.column(c) for c in names[2:7]), none], names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, lay = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                piece = batch.slice(s, 256)
                row, part, leaves = [], [], []
                for i, q in enumerate(matrix(piece.column("vec"))):
                    goes: dict[int, list[int]] = {}
                    for leaf in tree.visits(q, visits):
                        for p in lay.parts_of(leaf):
                            goes.setdefault(p, []).append(leaf)
                    row += [i] * len(goes)
                    part += goes
                    leaves += goes.values()
                piece, n = piece.take(pa.array(row, pa.int64())), len(row)
                kept = [piece.column("a"), piece.column("b"), pa.nulls(n, pa.list_(pa.int64())), piece.column("vec")]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), *kept, pa.array(leaves, pa.list_(pa.int64()))], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, x, leaf, ids = None, [], None, None, None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if s == e:
                    continue
                if parts[s] != now:
                    now, held, x = parts[s], [], None
                piece = batch.slice(s, e - s)
                if not kinds[s]:
                    held.append((matrix(piece.column("vec")), piece.column("leaf").to_numpy(), piece.column("ids").to_pylist()))
                    continue
                if not held:
                    continue
                if x is None:
                    x, leaf = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    ids = [i for h in held for i in h[2]]
                step = max(1, BLOCK // len(x))
                for t in range(0, piece.num_rows, step):
                    few = piece.slice(t, step)
                    allowed = np.array([np.isin(leaf, wanted) for wanted in few.column("leaves").to_pylist()])
                    out = []
                    for near, d in nearest(matrix(few.column("vec")), x, allowed, k + 1):
                        out.append([{"score": v, "vec_id": i} for v, i in heapq.nsmallest(k + 1, ((v, i) for v, p in zip(d.tolist(), near.tolist(), strict=True) for i in ids[p]))])
                    best = pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([few.column("a"), few.column("b"), best], ["a", "b", "best"])

    rows = index.select("leaf", "a", "b", "ids", "vec").mapInArrow(placed, shape)
    asked = index.where("asks").select("a", "b", "vec").mapInArrow(sent, shape)
    n = -(-int(layout.count.sum()) // layout.part)
    together = rows.union(asked).repartition(max(n, 1), "part").sortWithinPartitions("part", "kind", "leaf")
    found = together.mapInArrow(compare, "a long, b long, best array<struct<score: double, vec_id: long>>")
    # As many lists as a query has parts.
    return found.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))


def neighbours(vectors: DataFrame, query: Column, k: int = 10, target: float = TARGET, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest k found for every row of ``vectors`` (vec_id, embedding) with ``query``.

    ``query`` is a condition on vec_id. ``target`` is the recall that the calibration must reach; 1 visits all leaves.
    """
    tree, index, rows = build(vectors, query, k, leaf)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = tree.leaves if target >= 1 else calibrate(index, tree, k, target)
    best = search(index, tree, lay_out(index, tree.leaves, part), visits, k)
    asked = rows.where(query).select(F.col("vec_id").alias("query_id"), "a", "b").distinct()
    pairs = asked.join(best, ["a", "b"]).select("query_id", F.explode("best").alias("n")).where("n.vec_id <> query_id")
    once = pairs.groupBy("query_id", F.col("n.vec_id").alias("vec_id")).agg(F.min("n.score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_neighbours": op11_neighbours}
#: The answer is approximate; a test measures its recall against brute force, and its exactness where all leaves are visited.
ORACLE_SQL: dict[str, str] = {}
