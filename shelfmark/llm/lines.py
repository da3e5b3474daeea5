"""Line dedup by a deletion-neighbourhood join, with an edit bound of one.

A line is dropped if an earlier line, in the order of (doc_id, line number), equals it or is within one edit of it:
one code point replaced, inserted or deleted. Lines of fewer than ``MIN_CHARS`` code points are not compared by edits: they
are dropped if an earlier one equals them, unless they are blank. Without ``every`` they stay.

1. Equal lines are found by a 128-bit hash; the first place of each distinct line is kept.
2. Two different lines within one edit agree in the first or the second half. Only distinct lines that share a hashed
   half (with its length) with another line go on.
3. Those emit their deletion neighbourhood as hashed keys: the line without code point p, for each p. Equal keys with
   the same length and p are lines that differ by a replacement; a key that equals the hash of a whole line is an
   insertion. Keys are hashed by segments of ``SEGMENT`` code points, so a long line costs little more than its length.
4. Equal keys meet in an aggregate that keeps the earliest line, never all pairs: every member of a key is compared with
   the earliest line it could repeat, so a key with many lines costs rows in proportion to them. The edit distance of
   member and earliest line is verified on the texts.

Main path: SQL functions only. Filters of fixed size (``BITS`` bits, broadcast) spare most rows a shuffle; they never
lose one.

Defined results: a null text or a null doc_id takes no part and its row is returned as it is; an empty text has one
short line. Rows that share a doc_id count as one document whose line is kept if one of them keeps it. Columns other
than text (and n_chars, if there) pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import let, stored, table

MIN_CHARS = 20
SEGMENT = 64
BITS = 1 << 23
NOT_BLANK = r"[^ \t\n\x0B\f\r]"


def maybe_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be among those of ``wanted``: a bitmap of BITS bits, as 64-bit words."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = wanted.select(at(F.col(key)).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("__mask"))
    joined = df.withColumn("__p", at(F.col(key))).withColumn("__word", F.floor(F.col("__p") / 64)).join(F.broadcast(words), "__word")
    return joined.where(F.expr("shiftright(__mask, cast(__p % 64 as int)) & 1L = 1L")).select(*df.columns)


def droppable(line: Column, every: bool) -> Column:
    """Whether a line can be dropped; ``every`` adds the short ones that are not blank."""
    long = F.length(line) >= MIN_CHARS
    return long | line.rlike(NOT_BLANK) if every else long


def split_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, line_no, line, a, b, len) of the lines that can be dropped."""
    given = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = given.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("len", F.length("line")).where(droppable(F.col("line"), every))
    return rows.select("doc_id", "line_no", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"), "len")


def _halves(line: Column, n: Column) -> Column:
    """Hashed halves: of the line as it is, and as one that loses a code point to reach the length n - 1."""

    def pair(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("head"), m, F.left(line, h)), F.xxhash64(F.lit("tail"), m, F.right(line, m - h))]

    return F.array(*pair(n), *pair(n - 1))


def _variants(line: Column, n: Column) -> Column:
    """Array of (key, role): S for a replacement at a position, D for the line less a code point, X for the whole line."""

    def grid(m: Column, wide: int, keys) -> Column:  # noqa: ANN001
        """``keys(s, head, middle, tail)`` for every segment s of a line of length m, its middle ``wide`` longer."""

        def one(s: Column) -> Column:
            start = s * SEGMENT
            middle = F.least(F.lit(SEGMENT), m - start) + wide
            parts = F.struct(
                F.xxhash64(F.left(line, start)).alias("head"), F.substring(line, start + 1, middle).alias("middle"), F.xxhash64(F.substring(line, start + middle + 1, n)).alias("tail")
            )
            return let(parts, lambda x: keys(s, x["head"], x["middle"], x["tail"]))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((m - 1) / SEGMENT).cast("int")), one))

    def less(kind: str, m: Column, with_place: bool):  # noqa: ANN202
        def keys(s: Column, head: Column, middle: Column, tail: Column) -> Column:
            def one(p: Column) -> Column:
                place = [p] if with_place else []
                shorter = F.concat(F.left(middle, p - 1), F.substring(middle, p + 1, F.length(middle)))
                return F.struct(F.xxhash64(F.lit(kind == "S"), m, s, *place, head, shorter, tail).alias("key"), F.lit(kind).alias("role"))

            return F.transform(F.sequence(F.lit(1), F.length(middle)), one)

        return keys

    def whole(s: Column, head: Column, middle: Column, tail: Column) -> Column:
        return F.array(F.struct(F.xxhash64(F.lit(False), n, s, head, middle, tail).alias("key"), F.lit("X").alias("role")))

    return F.concat(grid(n, 0, less("S", n, True)), grid(n - 1, 1, less("D", n - 1, False)), grid(n, 0, whole))


def near_repeats(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b) of the distinct lines that an earlier line within one edit makes superfluous.

    ``first`` has (a, b, at) with ``at`` the first place (doc_id, line_no) of each distinct line.
    """
    rows = split_lines(docs)
    keyed = rows.select(F.explode(_halves(F.col("line"), F.col("len"))).alias("key"), "a", "b")
    shared = stored(keyed.groupBy("key").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).where("lo <> hi").select("key"), "halves")
    # Inner joins with distinct keys, as semi-joins would be planned before the bitmaps that spare them rows.
    wanted = maybe_in(keyed, "key", shared).join(shared, "key").select("a", "b").distinct()
    spots = stored(first.join(wanted, ["a", "b"]).select("a", "b", "at.doc_id", "at.line_no"), "spots")
    texts = maybe_in(rows, "doc_id", spots).join(spots, ["doc_id", "line_no", "a", "b"]).select("a", "b", "line", "len", F.struct("doc_id", "line_no").alias("at"))
    texts = stored(texts.dropDuplicates(["a", "b"]), "lines")
    emitted = texts.select("a", "b", "at", F.explode(_variants(F.col("line"), F.col("len"))).alias("v")).select("a", "b", "at", "v.key", "v.role")
    equal = stored(emitted.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("key"), "keys")
    met = stored(maybe_in(emitted, "key", equal).join(equal, "key").distinct(), "met")
    who = F.struct("at", "a", "b")
    earliest = met.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, who)).alias(r) for r in "SDX"))
    other = F.when(F.col("role") == "S", F.col("S")).when(F.col("role") == "D", F.col("X")).otherwise(F.col("D"))
    pairs = met.join(earliest, "key").withColumn("o", other).where(F.col("o.at") < F.col("at")).select("a", "b", F.col("o.a").alias("oa"), F.col("o.b").alias("ob")).distinct()
    mine, theirs = texts.select("a", "b", "line"), texts.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("line").alias("o"))
    both = pairs.join(mine, ["a", "b"]).join(theirs, ["oa", "ob"])
    return both.where(F.levenshtein("line", "o", 1).between(0, 1)).select("a", "b").distinct()


def kept_lines(docs: DataFrame, every: bool = True) -> DataFrame:
    """(doc_id, kept): for each document the sorted numbers of its droppable lines that stay."""
    first = stored(split_lines(docs, every).groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("at")), "first")
    stay = first.join(stored(near_repeats(docs, first), "near"), ["a", "b"], "left_anti")
    return stay.select("at.doc_id", "at.line_no").groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("kept"))


def dedup_lines(docs: DataFrame, every: bool = True, spare: float | None = None) -> DataFrame:
    """``docs`` with superfluous lines cut out of ``text``, and long columns ``n_lines`` and ``n_dropped``.

    ``every`` finds exact repeats of short lines too. With ``spare``, a document that would lose at least this share of its
    characters, but not all its words, stays as it is: it is a version of another one, of which cutting would leave a stub.
    """
    kept = kept_lines(docs.select("doc_id", "text"), every)
    lines = F.split("text", "\n", -1)
    gap = lambda k, j: F.concat(F.array_repeat(F.lit(False), k - F.when(j == 0, F.lit(-1)).otherwise(F.get("kept", F.greatest(j - 1, F.lit(0)))) - 1), F.array(F.lit(True)))
    mask = F.flatten(F.transform(F.coalesce("kept", F.array().cast("array<int>")), gap))

    def cut(x: Column) -> Column:
        stays = F.filter(x["lines"], lambda line, i: ~droppable(line, every) | F.coalesce(F.get(x["mask"], i), F.lit(False)))
        n = F.size(x["lines"]).cast("long")
        result = lambda text, dropped: F.struct(text.alias("text"), n.alias("n"), dropped.cast("long").alias("dropped"))

        def spared(r: Column) -> Column:
            version = (F.length("text") - F.length(r["text"]) >= F.lit(spare) * F.length("text")) & r["text"].rlike(NOT_BLANK)
            return F.when(version & (r["dropped"] > 0), result(F.col("text"), F.lit(0))).otherwise(r)

        whole = let(stays, lambda s: result(F.concat_ws("\n", s), F.size(x["lines"]) - F.size(s)))
        return whole if spare is None else let(whole, spared)

    done = F.when(F.col("text").isNotNull() & F.col("doc_id").isNotNull(), let(F.struct(lines.alias("lines"), mask.alias("mask")), cut))
    out = docs.drop("n_lines", "n_dropped", "kept").join(kept, "doc_id", "left").withColumn("__cut", done)
    columns = [F.coalesce("__cut.text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return out.select(*columns, F.coalesce("__cut.n", F.size(lines).cast("long"), F.lit(0)).alias("n_lines"), F.coalesce("__cut.dropped", F.lit(0)).alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document stay, and the digest of what stays."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_SQL = f"""
    WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM parts),
    firsts AS (
        SELECT line, length(line) AS n, min((doc_id, line_no)) AS spot FROM lines WHERE length(line) >= {MIN_CHARS} OR regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY line),
    long AS (SELECT * FROM firsts WHERE n >= {MIN_CHARS}),
    cut AS (SELECT line, n, spot, p, substr(line, 1, p - 1) || substr(line, p + 1) AS less FROM long, unnest(range(1, n + 1)) AS t(p)),
    replaced AS (SELECT n, p, less, min(spot) AS earliest FROM cut GROUP BY n, p, less HAVING count(*) > 1),
    near AS (
        SELECT c.line FROM cut c JOIN replaced r ON c.n = r.n AND c.p = r.p AND c.less = r.less WHERE r.earliest < c.spot
        UNION SELECT c.line FROM cut c JOIN long f ON c.less = f.line WHERE f.spot < c.spot
        UNION SELECT f.line FROM cut c JOIN long f ON c.less = f.line WHERE c.spot < f.spot),
    stay AS (
        SELECT l.doc_id, l.line_no, l.line, f.line IS NULL OR (f.spot = (l.doc_id, l.line_no) AND n.line IS NULL) AS kept
        FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
           md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kept), '')) AS text_md5
    FROM stay GROUP BY doc_id"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": _SQL}
