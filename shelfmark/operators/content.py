"""Content search: the first matching line of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import extension, folded, is_document
from shelfmark.operators.extract import document_text
from shelfmark.plans.regexes import literal, translate
from shelfmark.sources.texts import RANGE, file_texts

MAX_FILE = 16 * 1024 * 1024
EXCERPT = 300


class InvalidPattern(ValueError):
    """The content pattern is no regular expression of the dialect."""


def line_pattern(pattern: str, as_regex: bool, case_sensitive: bool) -> str:
    found = translate(pattern if as_regex else literal(pattern), case_sensitive)
    if found is None:
        raise InvalidPattern(pattern)
    return found


def first_line(text: Column, pattern: str, document: bool = False) -> Column:
    """Struct (line_no, line) of the first line with a match, null if there is none.

    A line loses trailing white space (``document``: leading too) and is cut to EXCERPT code points. A text with a NUL
    before the match is binary and has none.
    """
    # Lines by line feeds; a carriage return before one is cut with the trailing white space, and lets ``$`` match before it.
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).cast("long").alias("line_no"), F.regexp_replace(line, r"\r\z", "").alias("line")))
    hit = F.get(F.filter(numbered, lambda m: m["line"].rlike(pattern) & ((m["line"] != "") | (m["line_no"] < F.size(lines)))), 0)
    trim = r"(?U)^\s+|\s+\z" if document else r"(?U)\s+\z"
    nul = F.locate("\0", text)
    upto = F.length(F.concat_ws("\n", F.slice(lines, F.lit(1), hit["line_no"].cast("int"))))
    shown = F.struct(hit["line_no"].alias("line_no"), F.left(F.regexp_replace(hit["line"], trim, ""), F.lit(EXCERPT)).alias("line"))
    return F.when(hit.isNotNull() & ((nul == 0) | (nul > upto)), shown)


def first_lines(hits: DataFrame, texts: DataFrame, pattern: str, as_regex: bool = False, case_sensitive: bool = False, document: bool = False, documents: DataFrame | None = None, max_file: int | None = MAX_FILE) -> DataFrame:
    """``hits`` that have a matching line in ``texts`` (entry_id, text), with ``line_no`` and ``line``.

    Folders and files over ``max_file`` bytes (None: no limit) are left out. A text without a match is dropped by a plain test
    on the whole text before lines are split; the test is no stricter than the lines are. With ``documents`` (entry_id, data),
    files with the extension of a document are searched in the text that their bytes hold, and have no match if they hold none.
    """
    found = line_pattern(pattern, as_regex, case_sensitive)
    wanted = hits.where(~F.col("is_dir"))
    if max_file is not None:
        wanted = wanted.where(F.col("size") <= max_file)
    own = texts.select("entry_id", "text").where(F.col("text").isNotNull())
    if not as_regex:
        own = own.where(F.contains("text", F.lit(pattern)) if case_sensitive else F.col("text").rlike(found))
    if documents is None:
        joined = wanted.join(own, "entry_id").withColumn("__hit", first_line(F.col("text"), found, document))
    else:
        office, kind = is_document(F.col("name")), folded(extension(F.col("name")))
        both = wanted.join(own, "entry_id", "left").join(documents.select("entry_id", F.col("data").alias("__data")), "entry_id", "left")
        both = both.withColumn("__inside", document_text(F.when(office, F.col("__data")), kind))
        joined = both.withColumn("__hit", F.when(office, first_line(F.col("__inside"), found, True)).otherwise(first_line(F.col("text"), found)))
    return joined.where("__hit IS NOT NULL").select(*hits.columns, "__hit.line_no", "__hit.line")


def first_lines_of_files(hits: DataFrame, pattern: str, as_regex: bool = False, case_sensitive: bool = False, max_file: int | None = MAX_FILE, size: int = RANGE) -> DataFrame:
    """``hits`` whose files, at ``path``, have a matching line, with ``line_no`` and ``line``.

    A file is searched in ranges of ``size`` bytes. Each gives its own first match; the ranges before it give the line feeds to
    add to its number, and rule it out if one of them holds a NUL. What is shuffled are numbers and the matching lines.
    """
    found = line_pattern(pattern, as_regex, case_sensitive)
    wanted = hits.where(~F.col("is_dir"))
    if max_file is not None:
        wanted = wanted.where(F.col("size") <= max_file)
    parts = file_texts(wanted.select("entry_id", "path", "size"), size)
    ranges = parts.select("entry_id", "part", "n_lines", F.contains("text", F.lit("\0")).alias("binary"), first_line(F.col("text"), found).alias("hit"))
    before = Window.partitionBy("entry_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("above", F.coalesce(F.sum("n_lines").over(before), F.lit(0))).withColumn("spoilt", F.coalesce(F.max("binary").over(before), F.lit(False)))
    best = placed.where("hit IS NOT NULL AND NOT spoilt").groupBy("entry_id").agg(F.min_by(F.struct((F.col("hit.line_no") + F.col("above")).alias("line_no"), "hit.line"), "part").alias("hit"))
    return wanted.join(best, "entry_id").select(*hits.columns, "hit.line_no", "hit.line")
