"""Source divergence audit: how far the term distributions of a language's sources lie apart, over distinct count columns.

Every language keeps the V terms that at least ``MIN_DOCS`` of its documents hold. A group (lang, source), and the language as
a whole, gives a term the share ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, N its occurrences of kept terms; two shares
diverge by ``f = floor((p - q)^2 / q)``. Part ``pair`` sums f over all kept terms for every two sources of a language, part
``term`` lists a group's own terms with a share above the language's.

Pairs are summed over the distinct sparse count vectors of the terms, not over the terms. With z the share of a count of zero,

    sum f(p_g, p_h) = V f(z_g, z_h)
        + sum over counts c of g, times the terms that have it:  f(p_g(c), z_h) - f(z_g, z_h)
        + sum over counts c of h, times the terms that have it:  f(z_g, p_h(c)) - f(z_g, z_h)
        + sum over vectors with g and h, times the terms that have them:  f(p_g, p_h) - f(p_g, z_h) - f(z_g, p_h) + f(z_g, z_h)

so a term costs nothing for the sources that lack it, and terms with equal vectors cost as much as one. Vectors are told apart
by 128 bits of an exclusive-or over hashed (source, count) pairs; no vector is gathered in a cell. All of this is exact in
64-bit integers: shares are at most 10^9 + 1, and sums of f over terms stay below 2^63. Products with counts use decimals.

Scale: terms are counted per task first, with a bounded table that is emitted and cleared when it is full, then by Spark. Pairs
are computed in tiles of two blocks of about ``BLOCK`` sources, each tile spread over ``SPREAD`` tasks by hashed term, so neither a
source nor a language with many sources makes a single task; a task holds one tile. The number of pairs is that of the result.

Defined results: null text, lang and source are empty strings; an empty table gives an empty result. Rows that repeat a
document count as documents of their own. A group without kept terms has count 0 of each; a language that keeps none has pairs
of value 0, and one with a single source no pairs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored, table

MIN_DOCS = 3
TERM_RANKS = 200
BLOCK = 256
SPREAD = 64
#: Words that a task counts at a time.
HELD = 4_000_000
#: Pairs that a task computes at once.
AT_ONCE = 500_000
#: Letters of a term as they are, A to Z in lower case, all else a space. On UTF-8, whose longer characters have no byte below 128.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the documents of about ``HELD`` words at a time."""
    groups: dict[tuple, int] = {}
    owner, terms, lengths, held = [], [], [], 0

    def emit() -> pa.RecordBatch:
        words = pa.chunked_array(terms, pa.binary()).combine_chunks().dictionary_encode()
        code, wide = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
        doc = np.repeat(np.arange(len(owner)), np.concatenate(lengths))
        once, n = np.unique(doc * wide + code, return_counts=True)
        key = np.array(owner, np.int64)[once // wide] * wide + once % wide
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        names = list(groups)
        lang, source = (pa.array([g[i] for g in names], pa.string()).take(pa.array(key[first] // wide)) for i in (0, 1))
        docs = np.diff(first, append=len(key))
        found = [lang, source, words.dictionary.take(pa.array(key[first] % wide)), pa.array(np.add.reduceat(n, first) if len(first) else n), pa.array(docs)]
        for store in (groups, owner, terms, lengths):
            store.clear()
        return pa.RecordBatch.from_arrays(found, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in slices(batch, "text"):
            text = pa.array([t.translate(_LETTERS) for t in part.column("text").to_pylist()], pa.binary())
            split = pc.split_pattern(text, b" ")
            flat = split.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            length = np.zeros(part.num_rows, np.int64)
            np.add.at(length, np.repeat(np.arange(part.num_rows), pc.list_value_length(split).to_numpy()), full.to_numpy(zero_copy_only=False))
            terms.append(flat.filter(full))
            lengths.append(length)
            owner += [groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)]
            held += len(terms[-1])
            if held > HELD:
                yield emit()
                held = 0
    if owner:
        yield emit()


def counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head, a, b): the occurrences of every kept term in every group that has it.

    ``total`` is that of the language, ``head`` marks one row of each term, a and b are the hash of the term's count vector.
    """
    given = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    partial = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    summed = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    vector = lambda *salt: F.bit_xor(F.xxhash64(*salt, "source", "n")).over(term)
    full = summed.withColumn("held_by", F.sum("docs").over(term)).where(F.col("held_by") >= min_docs)
    full = full.withColumn("total", F.sum("n").over(term)).withColumn("a", vector()).withColumn("b", vector(F.lit(1)))
    return full.withColumn("head", F.row_number().over(term.orderBy("source")) == 1).select("lang", "source", "term", "n", "total", "head", "a", "b")


def share(n: str, total: str, kept: str) -> Column:
    """The share of a count; null where no term is kept."""
    return F.expr(f"1 + 1000000000BD * (cast({n} as decimal(19, 0)) + 1BD) div nullif(cast({total} as decimal(19, 0)) + {kept}, 0BD)")


def gap(p: Column, q: Column) -> Column:
    """Divergence of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, kept, zero, blocks, block, slot) of every group; ``zero`` is its share of a count of zero,
    ``slot`` its number in its block."""
    every = docs.select("lang", "source").distinct()
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("head").alias("kept"))
    sizes = every.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    out = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang").na.fill(0, ["n_group", "n_lang", "kept"])
    out = out.withColumn("zero", share("0", "n_group", "kept")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    return out.withColumn("slot", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).cast("long"))


def _tiles(rows: DataFrame) -> DataFrame:
    """Each row for the tiles (left, right) of its block with every block: side 0 for the left one, 1 for the right, 2 for both."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = F.when(F.col("other") == F.col("block"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = other.withColumn("side", F.explode(sides))
    left = F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("block"))
    right = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
    return both.withColumn("left", left).withColumn("right", right).drop("other", "blocks", "block")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PAIRS = "lang string, left int, right int, i long, j long, value long"


class _Sums:
    """Sums by (left slot, right slot) of one tile, emitted where they are not zero."""

    def __init__(self) -> None:
        self.key, self.table = None, np.zeros((0, 0), np.int64)

    def cover(self, i: int, j: int) -> None:
        """Make room for slots below i and j."""
        grow = [(0, max(0, n - have)) for n, have in zip((i, j), self.table.shape, strict=True)]
        if any(g[1] for g in grow):
            self.table = np.pad(self.table, grow)

    def turn(self, key: tuple | None) -> Iterator[pa.RecordBatch]:
        """Go on to another tile; the sums of the one before are emitted."""
        if key != self.key:
            i, j = np.nonzero(self.table)
            if len(i):
                same = [pa.array([v] * len(i), k) for v, k in zip(self.key, (pa.string(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(i), pa.array(j), pa.array(self.table[i, j])], [c.split()[0] for c in _PAIRS.split(", ")])
            self.key, self.table = key, np.zeros((0, 0), np.int64)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, numbers) for each stretch of rows with equal keys, batch by batch."""
    for batch in batches:
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in keys:
            column = batch.column(c)
            change |= pc.not_equal(column.slice(1), column.slice(0, max(batch.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                part = batch.slice(s, e - s)
                yield tuple(part.column(c)[0].as_py() for c in keys), {c: part.column(c).to_numpy() for c in part.schema.names if c not in keys}


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by tile and vector: what the entries of a vector on the left add with those on the right."""
    sums, kept = _Sums(), None

    def add(rows: dict[str, np.ndarray]) -> None:
        """The pairs of whole vectors, some of them at a time."""
        vector, side, slot, p, z = (rows[c] for c in ("vector", "side", "slot", "p", "zero"))
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(a) or not len(b):
            return
        sums.cover(int(slot[a].max()) + 1, int(slot[b].max()) + 1)
        left, right = vector[a], vector[b]
        first = np.searchsorted(right, left, "left")
        many = np.searchsorted(right, left, "right") - first
        ends = np.cumsum(many)
        for s in range(0, int(ends[-1]), AT_ONCE):
            pair = np.arange(s, min(s + AT_ONCE, int(ends[-1])))
            of = np.searchsorted(ends, pair, "right")
            i, j = a[of], b[pair - (ends[of] - many[of]) + first[of]]
            value = _apart(p[i], p[j]) - _apart(p[i], z[j]) - _apart(z[i], p[j]) + _apart(z[i], z[j])
            np.add.at(sums.table.reshape(-1), slot[i] * sums.table.shape[1] + slot[j], value * rows["times"][i])

    for key, rows in _runs(batches, "lang", "left", "right"):
        if key != sums.key:
            if kept is not None:
                add(kept)
            yield from sums.turn(key)
            kept = None
        if kept is not None:
            rows = {c: np.concatenate([kept[c], v]) for c, v in rows.items()}
        rows["vector"] = np.cumsum((np.diff(rows["a"], prepend=rows["a"][0]) != 0) | (np.diff(rows["b"], prepend=rows["b"][0]) != 0))
        last = np.searchsorted(rows["vector"], rows["vector"][-1], "left")  # the last vector may go on
        add({c: v[:last] for c, v in rows.items()})
        kept = {c: v[last:] for c, v in rows.items()}
    if kept is not None:
        add(kept)
    yield from sums.turn(None)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of the right block, then the counts of the left one: what a count adds for every source that lacks its term.

    ``back`` 0 has the source with the count first, 1 the one without.
    """
    sums, others = (_Sums(), _Sums()), np.zeros(0, np.int64)
    for key, rows in _runs(batches, "lang", "left", "right"):
        if key != sums[0].key:
            yield from sums[0].turn(key)
            for out in sums[1].turn(key):
                yield _turned(out)
            others = np.zeros(0, np.int64)
        group = rows["kind"] == 0  # sorted: groups come first; a task with several spreads gets them as often
        if group.any():
            place = rows["slot"][group]
            others = np.concatenate([others, np.zeros(max(0, int(place.max()) + 1 - len(others)), np.int64)])
            others[place] = rows["zero"][group]
        counted = np.flatnonzero(~group)
        for s in range(0, len(counted), 2_000):
            at = counted[s : s + 2_000]
            p, z, times = (rows[c][at][:, None] for c in ("p", "zero", "times"))
            slot = rows["slot"][at]
            for out in sums:
                out.cover(int(slot.max()) + 1, len(others))
            np.add.at(sums[0].table[:, : len(others)], slot, times * (_apart(p, others) - _apart(z, others)))
            np.add.at(sums[1].table[:, : len(others)], slot, times * (_apart(others, p) - _apart(others, z)))
    yield from sums[0].turn(None)
    for out in sums[1].turn(None):
        yield _turned(out)


def _turned(out: pa.RecordBatch) -> pa.RecordBatch:
    """Sums of (count, other) as sums of the other tile's (other, count)."""
    lang, left, right, i, j, value = out.columns
    return pa.RecordBatch.from_arrays([lang, right, left, j, i, value], out.schema.names)


def pair_values(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    heads = found.where("head").groupBy("lang", "a", "b").agg(F.count("*").alias("times"), F.min("term").alias("term"))
    known = facts.where("kept > 0").select("lang", "source", "n_group", "kept", "zero", "blocks", "block", "slot")
    entries = found.select("lang", "source", "term", "n").join(heads.select("lang", "term", "times", "a", "b"), ["lang", "term"]).join(known, ["lang", "source"]).withColumn("p", share("n", "n_group", "kept"))
    tiled = _tiles(entries.select("lang", "a", "b", "times", "p", "zero", "blocks", "block", "slot"))
    dealt = tiled.repartition("lang", "left", "right", F.pmod("a", F.lit(SPREAD))).sortWithinPartitions("lang", "left", "right", "a", "b")
    joint = dealt.select("lang", "left", "right", "a", "b", "side", "slot", "p", "zero", "times").mapInArrow(_joint, _PAIRS)

    histogram = found.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(known, ["lang", "source"]).withColumn("p", share("n", "n_group", "kept"))
    shape = ("lang", "p", "zero", "times", "blocks", "block", "slot")
    zero = F.lit(0).cast("long")
    left = _tiles(histogram.select(*shape)).where("side <> 1").withColumn("kind", F.lit(1)).withColumn("spread", F.pmod(F.xxhash64("p"), F.lit(SPREAD)))
    right = _tiles(known.select("lang", zero.alias("p"), "zero", zero.alias("times"), "blocks", "block", "slot")).where("side <> 0").withColumn("kind", F.lit(0))
    right = right.withColumn("spread", F.explode(F.sequence(zero, F.lit(SPREAD - 1).cast("long")))).select(*left.columns)
    single = left.union(right).repartition("lang", "left", "right", "spread").sortWithinPartitions("lang", "left", "right", "kind")
    single = single.select("lang", "left", "right", "kind", "slot", "p", "zero", "times").mapInArrow(_single, _PAIRS)
    sums = joint.union(single).groupBy("lang", "left", "right", "i", "j").agg(F.sum("value").alias("more"))

    sides = _tiles(facts.select("lang", "source", "kept", "zero", "blocks", "block", "slot"))
    ours = sides.where("side <> 1").select("lang", "left", "right", F.col("slot").alias("i"), "source", "kept", "zero")
    theirs = sides.where("side <> 0").select("lang", "left", "right", F.col("slot").alias("j"), F.col("source").alias("item"), F.col("zero").alias("other"))
    every = ours.join(theirs, ["lang", "left", "right"]).where("source <> item").join(sums, ["lang", "left", "right", "i", "j"], "left")
    value = F.coalesce(F.col("kept") * gap(F.col("zero"), F.col("other")), F.lit(0)) + F.coalesce("more", F.lit(0))
    return every.select("lang", "source", "item", value.cast("long").alias("value"))


def term_values(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): a group's terms with a share above the language's."""
    both = found.join(facts.select("lang", "source", "n_group", "n_lang", "kept"), ["lang", "source"])
    shares = both.select("lang", "source", F.col("term").alias("item"), share("n", "n_group", "kept").alias("p"), share("total", "n_lang", "kept").alias("q"))
    return shares.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text)."""
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = stored(counts(given, min_docs), "counts")
    facts = stored(groups(given, found), "groups")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, name: df.withColumn("rank", order).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair_values(found, facts), "pair").union(part(term_values(found, facts), "term").where(F.col("rank") <= term_ranks))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all sources of each language, and the terms that mark them."""
    return audit(table(spark, sf_dir, "documents"))


_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
    langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
    here AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN here h USING (lang, source) GROUP BY g.lang, g.source),
    shares AS (SELECT t.lang, t.source, k.term, coalesce(h.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 1) // (t.total + l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS q
        FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN here h ON h.lang = t.lang AND h.source = t.source AND h.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
    rows AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM rows)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TERM_RANKS}"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLE_SQL = {"op13_divergence": _SQL}
