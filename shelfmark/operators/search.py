"""Search: a SearchSpec compiled to columns, ranked top-k, totals, and the sorting of what is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scalars as x
from shelfmark.operators.catalog import checkpointed
from shelfmark.operators.content import MAX_FILE, first_lines, first_lines_of_files
from shelfmark.operators.fuzzy import fuzzy_prefilter, fuzzy_score
from shelfmark.plans.regexes import translate
from shelfmark.plans.spec import Category, MatchMode, SearchSpec, SortKey, TypeFilter

DEFAULT_RESULTS = 1_000
#: Candidates whose content is searched: the best by rank.
CONTENT_CANDIDATES = 50_000
#: Up to so many rows a top-k sends to one task; slices of a range of ids that are counted at a time.
FEW_RESULTS, SLICES = 10_000, 1_024

#: Points for a term by where it stands.
WHOLE_NAME, WHOLE_STEM, FIRST_WORD, WORD, START, INSIDE, LENGTH_BONUS = 5000, 4000, 1500, 700, 400, 100, 200


def _boundary(name: Column, at: Column) -> Column:
    """Whether the code point at a 1-based place is missing or no ASCII letter or digit."""
    c = F.substring(name, at, F.lit(1))
    return (at < 1) | (at > F.length(name)) | ~c.rlike("^[A-Za-z0-9]$")


def term_points(name: Column, term: str, case_sensitive: bool) -> Column:
    """Points of the first occurrence of a term in a name; null if there is none."""
    pos = x.position(name, term, case_sensitive)
    end = pos + len(term)  # the place after the occurrence
    left, right = _boundary(name, pos - 1), _boundary(name, end)
    return (
        F.when(pos == 0, F.lit(None).cast("long"))
        .when((pos == 1) & (end == F.length(name) + 1), WHOLE_NAME)
        .when((pos == 1) & (end == x.stem_length(name) + 1), WHOLE_STEM)
        .when((pos == 1) & right, FIRST_WORD)
        .when(left & right, WORD)
        .when(pos == 1, START)
        .otherwise(INSIDE)
        .cast("long")
    )


def substring_score(name: Column, terms: tuple[str, ...], case_sensitive: bool) -> Column:
    """The sum of the points of all terms and a bonus for short names; null if a term is missing, 1 without terms."""
    if not terms:
        return F.lit(1).cast("long")
    total = sum((term_points(name, t, case_sensitive) for t in terms[1:]), term_points(name, terms[0], case_sensitive))
    return total + (LENGTH_BONUS - F.least(F.octet_length(name), F.lit(LENGTH_BONUS))).cast("long")


def structural(spec: SearchSpec, category: Category = Category.ALL) -> Column:
    """The predicates besides name and content. They read plain columns, so Spark pushes what it can to the scan."""
    keep = ~F.col("is_deleted")
    if spec.type is TypeFilter.FILE:
        keep = keep & ~F.col("is_dir")
    elif spec.type is TypeFilter.FOLDER:
        keep = keep & F.col("is_dir")
    if category is not Category.ALL:
        keep = keep & x.in_category(F.col("name"), F.col("is_dir"), category)
    if spec.extensions:
        keep = keep & F.coalesce(x.folded(x.extension(F.col("name"))).isin(*spec.extensions), F.lit(False))
    if spec.size_min is not None or spec.size_max is not None:
        keep = keep & ~F.col("is_dir")
        if spec.size_min is not None:
            keep = keep & (F.col("size") >= spec.size_min)
        if spec.size_max is not None:
            keep = keep & (F.col("size") <= spec.size_max)
    if spec.date_min is not None:
        keep = keep & (F.col("modified") >= spec.date_min)
    if spec.date_max is not None:
        keep = keep & (F.col("modified") < spec.date_max)
    for p in spec.paths:
        keep = keep & x.holds(F.col("path"), p, spec.case_sensitive)
    return keep


def matches(catalog: DataFrame, spec: SearchSpec, category: Category = Category.ALL) -> DataFrame:
    """All rows that match by name and structure, with ``score``. An invalid regular expression matches nothing."""
    rows = catalog.where(structural(spec, category))
    name = F.col("name")
    if spec.mode is MatchMode.SUBSTRING or not spec.terms:
        for t in spec.terms:
            rows = rows.where(x.holds(name, t, spec.case_sensitive))
        return rows.withColumn("score", substring_score(name, spec.terms, spec.case_sensitive))
    if spec.mode is MatchMode.REGEX:
        pattern = translate(" ".join(spec.terms), spec.case_sensitive)
        if pattern is None:
            return rows.withColumn("score", F.lit(0).cast("long")).limit(0)
        return rows.where(name.rlike(pattern)).withColumn("score", F.greatest(F.lit(0), 1000 - F.octet_length(name)).cast("long"))
    joined = " ".join(spec.terms)
    rows = rows.where(fuzzy_prefilter(name, joined, spec.case_sensitive))
    return rows.withColumn("score", fuzzy_score(name, joined, spec.case_sensitive)).where("score IS NOT NULL")


def ranked(matched: DataFrame, k: int = DEFAULT_RESULTS, few: int = FEW_RESULTS) -> DataFrame:
    """The best k by score, then entry_id.

    Few are a distributed top-k, in which every task sends its best k to one. For more, thresholds are found first and what
    passes them is sorted by ranges, so no task sees k rows.
    """
    order = (F.desc("score"), F.asc("entry_id"))
    if k <= few:
        return matched.orderBy(*order).limit(k)
    # Written once: the scores are read by every count, and dearer than reading them back.
    return above_threshold(checkpointed(matched), k, few).orderBy(*order)


def above_threshold(matched: DataFrame, k: int, few: int = FEW_RESULTS) -> DataFrame:
    """The best k by score, then entry_id, in no order; exactly those, by filters.

    A histogram gives the least score of the best k. Of the rows with that score the lowest ids go in: the range of ids is split
    into ``SLICES`` until the slice in which the last one lies holds ``few`` rows or fewer, of which a top-k takes its share.
    A score has few distinct values; the counts that reach the driver are at most those, and ``SLICES`` a round.
    """
    left, least = k, None
    for r in sorted(matched.groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"]):
        if r["n"] >= left:
            least = r["score"]
            break
        left -= r["n"]
    if least is None:
        return matched  # fewer than k, or k
    tied, key = matched.where(F.col("score") == least), F.col("entry_id")
    low, high = tied.agg(F.min(key), F.max(key)).first()
    while True:
        width = max(1, -(-(high - low + 1) // SLICES))
        inside = tied.where(key.between(low, high)).groupBy(F.floor((key - low) / width).cast("long").alias("s")).agg(F.count("*").alias("n"))
        for r in sorted(inside.collect(), key=lambda r: r["s"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        low, high = low + r["s"] * width, min(high, low + (r["s"] + 1) * width - 1)
        if r["n"] <= few or low == high:
            break
    last = tied.where(key.between(low, high)).orderBy(key).limit(left)
    return matched.where((F.col("score") > least) | ((F.col("score") == least) & (key < low))).union(last)


HITS = ("entry_id", "score", "name", "path", "is_dir", "size", "modified")


@dataclass
class Outcome:
    """The shown rows, and a one-row frame with ``total`` and ``truncated``. Neither has run yet."""

    hits: DataFrame
    totals: DataFrame


def totals_of(matched: DataFrame, k: int) -> DataFrame:
    return matched.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > k)


def found(catalog: DataFrame, spec: SearchSpec, category: Category = Category.ALL, texts: DataFrame | None = None, documents: DataFrame | None = None, candidates: int | None = CONTENT_CANDIDATES, max_file: int | None = MAX_FILE, files: bool = False) -> DataFrame:
    """All rows that a search finds, with ``score``; see ``search``."""
    if spec.is_empty and category is Category.ALL:
        return catalog.where(~F.col("is_deleted")).withColumn("score", F.lit(0).cast("long"))
    matched = matches(catalog, spec, category)
    if spec.content is None:
        return matched
    if texts is None and not files:
        raise ValueError("a content predicate needs the texts")
    best = matched if candidates is None else ranked(matched, candidates)
    if files:
        return first_lines_of_files(best.select(*HITS), spec.content, spec.mode is MatchMode.REGEX, spec.case_sensitive, max_file)
    return first_lines(best.select(*HITS), texts, spec.content, spec.mode is MatchMode.REGEX, spec.case_sensitive, documents=documents, max_file=max_file)


def search(catalog: DataFrame, spec: SearchSpec, category: Category = Category.ALL, k: int = DEFAULT_RESULTS, texts: DataFrame | None = None, documents: DataFrame | None = None, candidates: int | None = CONTENT_CANDIDATES, max_file: int | None = MAX_FILE, files: bool = False) -> Outcome:
    """Run a query over a catalog; ``texts`` (entry_id, text) serves content predicates, ``documents`` (entry_id, data) those on
    office documents; with ``files`` the files at the rows' paths are read. Content is searched in the best ``candidates`` by rank and in files of up to ``max_file`` bytes; None
    lifts either limit.

    A query that asks for nothing shows the first k live rows by id, with score 0.
    """
    rows = found(catalog, spec, category, texts, documents, candidates, max_file, files)
    columns = rows.columns if spec.content is not None else HITS
    return Outcome(ranked(rows, k).select(*columns), totals_of(rows, k))


def numbered(hits: DataFrame, key: SortKey = SortKey.RELEVANCE, descending: bool = True) -> DataFrame:
    """The shown rows with ``row_number``, sorted anew. At most k rows: one task sorts them.

    Ties keep the order of relevance, or its reverse where the order as a whole is a reversed one.
    """
    order = Window.orderBy(F.desc("score"), F.asc("entry_id"))
    by_rank = hits.withColumn("__rank", F.row_number().over(order))
    value, natural = {
        SortKey.RELEVANCE: (F.col("score"), True),
        SortKey.NAME: (F.lower("name"), False),
        SortKey.PATH: (F.col("path"), False),
        SortKey.SIZE: (F.col("size"), True),
        SortKey.MODIFIED: (F.col("modified"), True),
    }[key]
    reversed_ = descending is not natural
    window = Window.orderBy(value.desc() if descending else value.asc(), F.desc("__rank") if reversed_ else F.asc("__rank"))
    return by_rank.withColumn("row_number", F.row_number().over(window).cast("long")).drop("__rank")


def without_paths(hits: DataFrame, gone: DataFrame) -> DataFrame:
    """Results without rows that have just been removed."""
    return hits.join(gone.select("path").distinct(), "path", "left_anti").select(*hits.columns)
