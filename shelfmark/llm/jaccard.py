"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents become sets of hashed word n-grams. Documents with equal sets form one class, and the join works on classes.

1. The n-grams are ordered, rare ones first. Those that by the shares of their words in the corpus no two documents are
   expected to have by chance (``CHANCE``) come first, in the order of a count of n-grams that keeps shared passages back;
   the others follow in the order of that expectation. Both counts cover all documents and have a fixed number of
   counters (``WORDS``, ``SKETCH``); they decide the order and so the cost, never the result. Two sets of
   the wanted similarity share n-grams among their first ``n - ceil(t * n) + 1``; only this part of the incidence matrix
   is multiplied.
2. Each n-gram (a column of the matrix) with at most ``BLOCK`` classes adds one to the overlap count of each of its
   pairs. Pairs whose sizes differ too much, or whose count stays under the bound that follows from their sizes, are
   discarded. The bound: if two sets overlap in ``o`` or more, then their first ``min(p - (n - o))`` common n-grams,
   over both sets with prefix ``p`` and size ``n``, stand in both prefixes. n-grams too frequent to be counted are
   granted to every pair that has them.
3. A column with more classes adds no pairs to the count. It picks pivot classes (``PIVOTS`` by hash, and the one with most
   frequent n-grams) and its other classes are compared with these alone. A column that still holds several components
   goes on with the classes outside its largest one: a pair that shares frequent n-grams alone must have sizes whose bound
   is within their number, which a join tests before anything is compared. Many classes that pass for their own size go
   through a product by blocks of about ``BLOCK_ROWS``, one task per pair of blocks, which returns spanning links. So a
   large group of near copies costs rows in proportion to its size, and no pair is skipped that could join two components.
4. Pairs are verified on whole sets in two steps: two for each class first, then those between different components.

Sets are told apart by two 64-bit hashes. The first is the key of a class; sets that agree in the first alone are found by
an aggregate and told apart by the second.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing. A document with fewer
words than the n-gram has one n-gram, all its words. Repeated texts are one class. A null doc_id takes no part: its
row is kept, with a null component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import release, slices, stored, table
from shelfmark.llm.components import components
from shelfmark.llm.lines import maybe_in

#: Counters of n-grams and of words.
SKETCH, WORDS = 1 << 18, 1 << 17
#: 64 times the logarithm of the expected number of documents from which an n-gram counts as one that chance repeats.
CHANCE = -640
#: Classes of an n-gram up to which all its pairs are counted.
BLOCK = 128
BLOCK_ROWS = 256
#: Dense classes outside the largest component of an n-gram up to which a join pairs them with the others.
FEW = 32
#: Pivots of an n-gram by hash, besides the one with most frequent n-grams.
PIVOTS = 2
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of every word in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    length = stop - start
    first = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(first, length)
    factor = mix((np.arange(length.max()) + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    sums = np.add.reduceat(_BYTE[_LOWER[raw[solid]]] * factor[place], first)
    return mix(sums + length.astype(np.uint64)), start


def _whole(text: bytes) -> np.ndarray:
    """The word hashes of one long text, cut between words."""
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sums(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that begins at each word of a sequence of word hashes."""
    h = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + len(h)])
    return h


Weigh = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
Sets = list[tuple[np.ndarray, np.ndarray | None]]


def shingle_sets(texts: list[bytes], n: int, weigh: Weigh | None = None, words_seen: list | None = None) -> Sets:
    """For each text the sorted distinct hashes of its word n-grams and, with ``weigh``, the weight of each.

    ``weigh`` takes word hashes, the hashes of the n-grams at their places and the number of words of an n-gram.
    ``words_seen`` gets the hashes of all words.
    """
    out: Sets = []

    def add(words: np.ndarray, bounds: list[tuple[int, int]]) -> None:
        if words_seen is not None:
            words_seen.append(words)
        grams = _sums(words, n)
        weights = weigh(words, grams, n) if weigh else None
        for a, b in bounds:
            if b - a >= n:
                own, some = grams[a : b - n + 1], None if weights is None else weights[a : b - n + 1]
            else:
                own = _sums(words[a:b], b - a) if b > a else words[:0]
                some = weigh(words[a:b], own, b - a) if weigh and b > a else own.astype(np.int64)
            own, at = np.unique(own, return_index=True)
            out.append((own, None if weigh is None else some[at]))

    k = 0
    while k < len(texts):
        if len(texts[k]) > PIECE:
            words = _whole(texts[k])
            add(words, [(0, len(words))])
            k += 1
            continue
        group, size = [], 0
        while k < len(texts) and len(texts[k]) <= PIECE and (not group or size + len(texts[k]) < PIECE):
            group.append(texts[k])
            size += len(texts[k]) + 1
            k += 1
        hashes, start = word_hashes(b"\n".join(group))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in group)])).tolist()
        add(hashes, list(zip(bounds[:-1], bounds[1:], strict=True)))
    return out


def identities(sets: list[np.ndarray], clashes: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed integers. The second takes the place of a first that is among ``clashes``."""
    lengths = np.array([len(s) for s in sets], np.int64)
    flat, some = np.concatenate([np.zeros(0, np.uint64), *sets]), lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    both = []
    for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
        total = lengths.astype(np.uint64) * seed
        if len(starts):
            total[some] += np.add.reduceat(mix(flat ^ seed), starts)
        both.append(mix(total).view(np.int64))
    if clashes:
        both[0] = np.where(np.isin(both[0], list(clashes)), both[1], both[0])
    return both[0], both[1]


def _map(docs: DataFrame, schema: str, make: Callable[[pa.RecordBatch, list[bytes]], Iterator[dict]]) -> DataFrame:
    """The rows that ``make`` gives for the texts of each part of a batch, and for none at the end of a task."""
    kinds = dict(x.split() for x in schema.split(", "))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(k, types[t]) for k, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: dict) -> pa.RecordBatch:
            n = len(next(iter(rows.values())))
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in fields], schema=fields)

        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                yield from map(given, make(part, [x or b"" for x in part.column("text").to_pylist()]))
        yield from map(given, make(None, []))

    columns = [F.col(c).cast("binary") if c == "text" else F.col(c).cast("long") for c in docs.columns]
    return docs.select(*(c.alias(n) for c, n in zip(columns, docs.columns, strict=True))).mapInArrow(run, schema)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over (doc_id, t, text): rows (doc_id, t, n, id, other) of the documents, and (g, c) of the counts.

    ``g`` is the number of a counter of n-grams or, from SKETCH on, of words; ``c`` is what a task has counted.
    """
    totals: list[np.ndarray] = []

    def make(part: pa.RecordBatch | None, texts: list[bytes]) -> Iterator[dict]:
        if not totals:
            totals.append(np.zeros(SKETCH + WORDS, np.int64))
        if part is not None:
            words: list[np.ndarray] = []
            sets = [s for s, _ in shingle_sets(texts, n, words_seen=words)]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            totals[0][:SKETCH] += np.bincount((flat & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            for w in words:
                totals[0][SKETCH:] += np.bincount((w & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS)
            first, other = identities(sets)
            yield {"doc_id": part.column("doc_id"), "t": part.column("t"), "n": [len(s) for s in sets], "id": first, "other": other}
            return
        some = np.flatnonzero(totals[0])
        for k in range(0, len(some), 50_000):
            yield {"g": some[k : k + 50_000], "c": totals[0][some[k : k + 50_000]]}
        totals.clear()

    return _map(docs, "doc_id long, t long, n long, id long, other long, g int, c long", make)


class Order:
    """The weight of an n-gram: those expected in few documents by their words first, in the order of their counters."""

    def __init__(self, counts: DataFrame):
        found = counts.toArrow()  # at most SKETCH + WORDS rows, as columns: as Row objects they would take 100 MB and more
        total = np.zeros(SKETCH + WORDS, np.int64)
        total[found["g"].to_numpy()] = found["c"].to_numpy()
        words = total[SKETCH:]
        log = lambda x: np.round(64 * np.log2(np.maximum(x, 1))).astype(np.int32)
        self.counters, self.common, self.every = total[:SKETCH], log(words), int(log(words.sum()))

    def __call__(self, words: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
        own = self.common[(words & np.uint64(WORDS - 1)).astype(np.int64)]
        expected = np.full(len(grams), -(n - 1) * self.every, np.int64)
        for k in range(n):
            expected += own[k : k + len(grams)]
        counted = self.counters[(grams & np.uint64(SKETCH - 1)).astype(np.int64)]
        return np.where(expected < CHANCE, counted, (1 << 40) + expected)


def prefix_length(n: np.ndarray | int, percent: int):  # noqa: ANN201
    return n - (percent * n + 99) // 100 + 1


def prefixes(docs: DataFrame, n: int, percent: int, weigh: Weigh, clashes: frozenset[int]) -> DataFrame:
    """(h, id, n): the first n-grams of every class in the order of their weights, with its size."""
    shared = docs.sparkSession.sparkContext.broadcast(weigh)
    seen: set[int] = set()  # of the classes that a task has given out: copies beside each other add no rows

    def make(part: pa.RecordBatch | None, texts: list[bytes]) -> Iterator[dict]:
        if part is None:
            seen.clear()
            return
        found = shingle_sets(texts, n, shared.value)
        ids = identities([s for s, _ in found], clashes)[0].tolist()
        fresh = [k for k, i in enumerate(ids) if len(found[k][0]) and i not in seen and not seen.add(i)]
        first = [found[k][0][np.lexsort(found[k])[: prefix_length(len(found[k][0]), percent)]] for k in fresh]
        counts = [len(x) for x in first]
        if fresh:
            sizes = np.array([len(found[k][0]) for k in fresh], np.int64)
            yield {"h": np.concatenate(first).view(np.int64), "id": np.repeat(np.array([ids[k] for k in fresh], np.int64), counts), "n": np.repeat(sizes, counts)}

    return _map(docs, "h long, id long, n long", make)


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _bound(a: Column, b: Column, percent: int) -> Column:
    """The least number of prefix n-grams that two sets of these sizes share if they are similar."""
    least = F.ceil((a + b) * percent / F.lit(100 + percent) - F.lit(1e-9))
    p = lambda x: x - F.floor((x * percent + 99) / F.lit(100.0)) + 1
    return F.greatest(F.least(p(a) - a + least, p(b) - b + least), F.lit(1))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Join:
    """The join of one table of documents."""

    def __init__(self, docs: DataFrame, n: int = 3, percent: int = 90):
        self.n, self.percent = n, percent
        self.docs = docs.select("doc_id", "text")
        self.known = self.docs.where(F.col("doc_id").isNotNull())
        surveyed = stored(survey(self.docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), n), "survey")
        self.counts = surveyed.where("g IS NOT NULL").groupBy("g").agg(F.sum("c").alias("c"))
        rows = surveyed.where("g IS NULL")
        # Of d different sets about d * d / 2**65 pairs clash: a short list at any size.
        clashes = rows.groupBy("id").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("id")
        self.clashes = frozenset(r["id"] for r in clashes.collect())
        key = F.when(F.col("id").isin(*self.clashes), F.col("other")).otherwise(F.col("id")) if self.clashes else F.col("id")
        self.rows = rows.select("doc_id", "t", "n", key.alias("id"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(id, grams) of the classes in ``wanted`` (id), from the whole text of one document of each."""
        n, clashes = self.n, self.clashes
        of = self.rows.where("doc_id IS NOT NULL").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

        def make(part: pa.RecordBatch | None, texts: list[bytes]) -> Iterator[dict]:
            if part is not None:
                found = [s for s, _ in shingle_sets(texts, n)]
                yield {"id": identities(found, clashes)[0], "grams": [s.tobytes() for s in found]}

        spots = stored(of, "spots")
        found = _map(maybe_in(self.known, "doc_id", spots).join(spots, "doc_id"), "id long, grams binary", make)
        return found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("grams").alias("grams"))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
        percent = self.percent
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ga, gb = batch.column("ga"), batch.column("gb")
                ok = [_alike(np.frombuffer(ga[k].as_py(), np.uint64), np.frombuffer(gb[k].as_py(), np.uint64), percent) for k in range(batch.num_rows)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return with_b.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")

    def found(self) -> DataFrame:
        """(node, label): the classes that are linked with others, and the least class of their component."""
        percent = self.percent
        first = stored(prefixes(self.known, self.n, percent, Order(self.counts), self.clashes), "prefixes")
        live = stored(first.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h"), "columns")
        # An inner join, as a semi-join would be planned before the filter. One shuffle by n-gram serves the join, the removal of copies, the count and the join with it.
        live = maybe_in(first, "h", live).join(live, "h").groupBy("h", "id", "n").agg(F.count("*").alias("copies")).drop("copies")
        many = live.groupBy("h").agg(F.count("*").alias("m"))
        sized = stored(live.join(many, "h"), "sized")
        release(first)
        few = sized.where(F.col("m") <= BLOCK).select("h", "id", "n")
        a, b = few.toDF("h", "a", "na"), few.toDF("h", "b", "nb")
        overlaps = a.join(b, "h").where((F.col("a") < F.col("b")) & _near(F.col("na"), F.col("nb"), percent)).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("o"))
        hot = sized.where(F.col("m") > BLOCK).select("h", "id", "n", "m")
        some_hot = bool(hot.take(1))
        if some_hot:
            granted = hot.groupBy("id").agg(F.count("*").alias("g"))
            hot = stored(hot.join(granted, "id"), "hot")
            overlaps = overlaps.join(granted.toDF("a", "ga"), "a", "left").join(granted.toDF("b", "gb"), "b", "left")
            overlaps = overlaps.withColumn("o", F.col("o") + F.least(F.coalesce("ga", F.lit(0)), F.coalesce("gb", F.lit(0))))
        pairs = overlaps.where(F.col("o") >= _bound(F.col("na"), F.col("nb"), percent)).select("a", "b", "o")
        pairs = stored(pairs, "pairs")
        begin = self._first(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        if some_hot:
            begin = begin.union(self._pivots(hot)).distinct()
            wanted = wanted.union(hot.select("id"))
        sets = stored(self.sets(stored(wanted.distinct(), "wanted")), "sets")
        begin = stored(begin, "begin")
        labels = components(stored(self.verified(begin, sets), "links"))
        label = lambda k: labels.toDF(k, f"{k}l")
        apart = F.coalesce("al", "a") != F.coalesce("bl", "b")
        rest = pairs.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left").where(apart).select("a", "b").join(begin, ["a", "b"], "left_anti")
        more = self.verified(rest, sets)
        more = stored(more.union(self._rest(hot, sets, labels)) if some_hot else more, "more-links")
        release(sized, pairs, begin)
        if not more.take(1):
            return labels
        return components(more.union(labels.where("node <> label").toDF("a", "b")))

    def _first(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b, o) two for each class: with the partner of least hash, and with that of the largest overlap.

        In a group of near copies most classes have the same partner of least hash, so these links join nearly all of it, and
        what is verified grows with the classes, not with the pairs.
        """
        both = pairs.union(pairs.select("b", "a", "o"))
        picked = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("p"), F.max_by("b", F.struct("o", "b")).alias("q"))
        each = picked.select("a", F.explode(F.array_distinct(F.array("p", "q"))).alias("b"))
        return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _may(self) -> Column:
        """Whether two classes (id, n, g) and (o, on, og) that share frequent n-grams alone, ``g`` and ``og`` at most, can be similar."""
        return _near(F.col("n"), F.col("on"), self.percent) & (F.least("g", "og") >= _bound(F.col("n"), F.col("on"), self.percent))

    def _pivots(self, hot: DataFrame) -> DataFrame:
        """Pairs (a, b) of the classes of a frequent n-gram and some of them that a hash picks as pivots."""
        # By the class alone: the columns that a group of near copies shares pick much the same pivots, so pairs recur.
        # The first is the class with most frequent n-grams: what copies were made of holds those that each copy has lost.
        pick = F.struct(F.col("id").alias("o"), F.col("n").alias("on"), F.col("g").alias("og"))
        picks = [F.max_by(pick, F.struct("g", "id")), *(F.min_by(pick, F.xxhash64("id", F.lit(k))) for k in range(PIVOTS))]
        pivots = hot.groupBy("h").agg(F.array_distinct(F.array(*picks)).alias("p")).select("h", F.inline("p"))
        pairs = hot.join(pivots, "h").where((F.col("id") != F.col("o")) & self._may())
        return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))

    def _rest(self, hot: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links that still join classes of frequent n-grams.

        The pairs of a column are those of the classes outside its largest component with all of its classes. A class is
        dense if its frequent n-grams are enough for a partner of its own size. A shared passage makes no class dense: only
        partners at the edge of the permitted sizes pass the test, so a join finds the few pairs. So it does in a column with
        ``FEW`` dense classes outside its largest component; where there are more, these go through the blocked product.
        """
        open_ = hot.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = open_.withColumn("dense", F.col("g") >= _bound(F.col("n"), F.col("n"), self.percent))
        parts = open_.groupBy("h", "label").agg(F.count("*").alias("c"), F.count_if("dense").alias("d"))
        split = parts.groupBy("h").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("d").alias("d"), F.max_by("d", F.struct("c", "label")).alias("most"))
        open_ = stored(open_.drop("m").join(split.where("parts > 1").drop("parts"), "h"), "open")
        large = F.col("d") - F.col("most") > FEW
        all_ = open_.select("h", F.col("id").alias("o"), F.col("n").alias("on"), F.col("g").alias("og"), F.col("label").alias("ol"), F.col("dense").alias("od"))
        among = large & F.col("dense") & F.col("od")
        pairs = open_.where("label <> main").join(all_, "h").where((F.col("label") != F.col("ol")) & ~among & self._may())
        links = self.verified(stored(pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct(), "few"), sets)
        dense = open_.where(large & F.col("dense")).withColumnRenamed("d", "m")
        return links.union(self._blocks(dense, sets)) if dense.take(1) else links

    def _blocks(self, open_: DataFrame, sets: DataFrame) -> DataFrame:
        """Spanning links of the classes outside the largest component of their n-gram against all of its classes."""
        percent = self.percent
        rest = F.col("label") != F.col("main")
        blocks = lambda rows: F.greatest(F.ceil(rows / F.lit(float(BLOCK_ROWS))), F.lit(1)).cast("int")
        dealt = open_.join(sets, "id").withColumn("ni", blocks(F.col("m"))).withColumn("nj", blocks(F.col("m") - F.col("most")))
        spot = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), count).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
        left = dealt.select("h", "id", "label", "grams", F.lit(0).alias("side"), spot(F.col("ni"), 1).alias("i"), every(F.col("nj")).alias("j"))
        right = dealt.where(rest).select("h", "id", "label", "grams", F.lit(1).alias("side"), every(F.col("ni")).alias("i"), spot(F.col("nj"), 2).alias("j"))

        def product(block: pd.DataFrame) -> pd.DataFrame:
            rows, columns = (block[block["side"] == s].reset_index(drop=True) for s in (0, 1))
            links = spanning(rows, columns, percent)
            return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

        return left.union(right).groupBy("h", "i", "j").applyInPandas(product, "a long, b long")

    def lost(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, t) of the rows that a row of lesser (doc_id, t) in their component makes superfluous, and of the repeated ones among the rest.

        ``t`` is the hash of the text, which tells apart rows that share an id.
        """
        labels = self.found().withColumnRenamed("node", "id")
        rows = self.rows.where("doc_id IS NOT NULL AND n > 0")
        counted = stored(rows.groupBy("doc_id", "t", "id").agg(F.count("*").alias("c")), "rows")
        firsts = counted.groupBy("id").agg(F.min(F.struct("doc_id", "t", "c")).alias("first"))
        firsts = firsts.join(labels, "id", "left").groupBy(F.coalesce("label", "id").alias("label")).agg(F.min("first").alias("first"))
        firsts = stored(firsts.select("first.doc_id", "first.t", "first.c"), "firsts")
        return counted.join(firsts, ["doc_id", "t"], "left_anti").select("doc_id", "t"), firsts.where("c > 1").select("doc_id", "t")

    def grouped(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        labels = self.found().withColumnRenamed("node", "id")
        first = self.rows.where("doc_id IS NOT NULL AND n > 0").join(labels, "id").groupBy("label").agg(F.min("doc_id").alias("least"))
        twins = self.rows.where("doc_id IS NOT NULL AND n > 0").groupBy("id").agg(F.min("doc_id").alias("first"))
        own = twins.join(labels.join(first, "label").select("id", "least"), "id", "left").select("id", F.coalesce("least", "first").alias("component"))
        out = self.rows.join(own, "id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def spanning(rows: pd.DataFrame, columns: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between rows and columns of different components, as few as join what can be joined.

    The overlap counts are a product of two 0/1 matrices over the n-grams of the block, accumulated over strips of
    n-grams.
    """
    if not len(rows) or not len(columns):
        return []
    xs = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    ys = [np.frombuffer(g, np.uint64) for g in columns["grams"]]
    nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    counts = np.zeros((len(xs), len(ys)), np.float32)
    for k in range(0, len(both), 4096):
        strip = both[k : k + 4096]

        def incidence(sets: list[np.ndarray], strip: np.ndarray = strip) -> np.ndarray:
            m = np.zeros((len(sets), len(strip)), np.float32)
            for r, s in enumerate(sets):
                at = np.searchsorted(strip, s)
                at[at == len(strip)] = 0
                m[r, at[strip[at] == s]] = 1
            return m

        counts += incidence(xs) @ incidence(ys).T
    union = nx[:, None] + ny[None, :] - counts
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(100 * counts.astype(np.float64) >= percent * union.astype(np.float64)):
        a, b = root(rows["label"][i]), root(columns["label"][j])
        if a != b:
            parent[a] = b
            out.append((rows["id"][i], columns["id"][j]))
    return out


def near_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that links reach from each document."""
    return Join(docs, n, percent).grouped()


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: the one of least id. Rows without id or words all stay.

    Rows that share an id are told apart by their texts; of rows with one id and one text the least in all columns stays.
    """
    lost, twice = (stored(x.toDF("__id", "__t"), "verdict") for x in Join(docs, n, percent).lost())
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__t", F.xxhash64("text"))
    rest = keyed.join(lost.union(twice), ["__id", "__t"], "left_anti")
    one = keyed.join(twice, ["__id", "__t"], "left_semi").groupBy("__id", "__t").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rest.select(*docs.columns).union(one.select("row.*"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word n-grams have a similarity of 0.9 or more."""
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
