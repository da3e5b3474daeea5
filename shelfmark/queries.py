"""The engine's queries over the shared tables, and independent SQL for DuckDB.

Catalog adapters are stated once per engine; predicates, scores and orders are written by hand in SQL.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.functions import scalars as x
from shelfmark.operators import catalog as cat
from shelfmark.operators import changes as ch
from shelfmark.operators.content import first_lines_of_files
from shelfmark.operators.extract import document_text, media_info
from shelfmark.operators.intervals import labelled, removed_at, subtree
from shelfmark.operators.log import ChangeLog
from shelfmark.operators.names import NameIndex
from shelfmark.operators.preview import preview_kind
from shelfmark.operators.rescan import differences, open_or_build
from shelfmark.operators.search import matches, numbered, search, without_paths
from shelfmark.operators.session import one_pass
from shelfmark.plans.parser import parse, within_folder
from shelfmark.plans.spec import Category, MatchMode, SortKey
from shelfmark.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Catalogs, as SQL ------------------------------------------------------------------------------------------------


def _choice(key: str, choices: str) -> str:
    names = choices.split()
    return f"list_extract([{', '.join(f"'{n}'" for n in names)}], CAST({key} % {len(names)} AS INTEGER) + 1)"


PARTS = f"""parts AS (
    SELECT p_partkey AS entry_id, n AS name, '/parts/' || p_brand || '/' || n AS path, d AS is_dir,
           CASE WHEN d THEN 0 ELSE CAST(p_size AS BIGINT) * 1024 END AS size, CAST(0 AS BIGINT) AS modified
    FROM (SELECT *, p_partkey % 7 = 0 AS d, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_name || '.' || {_choice('p_partkey', cat.PART_KINDS)} END AS n FROM part))"""
ITEMS = f"""items AS (
    SELECT l_orderkey * 10 + l_linenumber AS entry_id, n AS name, '/ship/' || l_returnflag || '/' || l_linestatus || '/' || n AS path, false AS is_dir,
           CAST(floor(l_extendedprice) AS BIGINT) AS size, greatest(epoch_us(l_shipdate) // 1000000, 0) AS modified
    FROM (SELECT *, 'item_' || l_orderkey || '_' || l_linenumber || '.' || {_choice('l_partkey', cat.ITEM_KINDS)} AS n FROM lineitem))"""
DOCS = """docs AS (
    SELECT doc_id AS entry_id, n AS name, '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || n AS path, false AS is_dir,
           CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CAST(0 AS BIGINT) AS modified, text
    FROM (SELECT *, 'doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' ELSE 'log' END AS n FROM documents))"""
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HIT = "entry_id, score, name, path, is_dir, size, modified"


def _fold(c: str) -> str:
    return FOLD.format(c)


def _ext(name: str = "name") -> str:
    return f"nullif(regexp_extract({name}, '^.+[.]([^.]+)$', 1), '')"


def _points(term: str, case_sensitive: bool = False) -> str:
    """Points of a term, in SQL."""
    t = term if case_sensitive else term.lower()
    pos = f"strpos({'name' if case_sensitive else _fold('name')}, '{t}')"
    alnum = lambda at: f"regexp_matches(substr(name, {at}, 1), '^[A-Za-z0-9]$')"
    left, right = f"({pos} = 1 OR NOT {alnum(pos + ' - 1')})", f"(NOT {alnum(f'{pos} + {len(t)}')})"
    return f"""CASE WHEN {pos} = 0 THEN NULL WHEN {pos} = 1 AND length(name) = {len(t)} THEN 5000
        WHEN {pos} = 1 AND length(name) - coalesce(length({_ext()}) + 1, 0) = {len(t)} THEN 4000
        WHEN {pos} = 1 AND {right} THEN 1500 WHEN {left} AND {right} THEN 700 WHEN {pos} = 1 THEN 400 ELSE 100 END"""


def _score(*terms: str, case_sensitive: bool = False) -> str:
    if not terms:
        return "CAST(1 AS BIGINT)"
    return "CAST(" + " + ".join(f"({_points(t, case_sensitive)})" for t in terms) + " + 200 - least(strlen(name), 200) AS BIGINT)"


def _select(source: str, cte: str, where: str = "true", terms: tuple[str, ...] = (), k: int | None = 1000, case_sensitive: bool = False, score: str | None = None) -> str:
    rows = f"SELECT *, {score or _score(*terms, case_sensitive=case_sensitive)} AS score FROM {source} WHERE {where}"
    cut = f"ORDER BY score DESC, entry_id LIMIT {k}" if k else ""
    return f"WITH {cte} SELECT {HIT} FROM ({rows}) WHERE score IS NOT NULL {cut}"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_SOURCES = {"parts": (cat.parts, PARTS), "items": (cat.items, ITEMS), "docs": (cat.docs, DOCS)}


def hits(name: str, source: str, text: str, where: str = "true", terms: tuple[str, ...] = (), category: Category = Category.ALL, k: int = 1000, case: bool = False, mode: MatchMode = MatchMode.SUBSTRING, score: str | None = None) -> None:
    """Register a search and its SQL."""
    make, cte = _SOURCES[source]
    add(name, lambda spark, d: search(make(spark, d), parse(text, mode, case), category, k).hits, _select(source, cte, where, terms, k, case, score))


_in = lambda c: f"NOT is_dir AND coalesce({_fold(_ext())} IN ({', '.join(f"'{e}'" for e in c.extensions)}), false)"

# Names -----------------------------------------------------------------------------------------------------------

add(
    "head_natural",
    lambda spark, d: search(cat.items(spark, d), parse("")).hits,
    f"WITH {ITEMS} SELECT {HIT} FROM (SELECT *, CAST(0 AS BIGINT) AS score FROM items) ORDER BY entry_id LIMIT 1000",
)
hits("name_substring", "parts", "bolt", terms=("bolt",), k=100_000)
hits("name_multi_term", "parts", "b old", terms=("b", "old"))
hits("name_case_sensitive", "parts", "bolt", "NOT contains(name, 'Bolt')", terms=("bolt",), case=True, k=100_000)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every third part's name in upper case."""
    return cat.parts(spark, d).withColumn("name", F.when(F.col("entry_id") % 3 == 0, F.upper("name")).otherwise(F.col("name")))


for _case in (False, True):
    add(
        "name_mixed_case" + "_sensitive" * _case,
        lambda spark, d, case=_case: search(_mixed(spark, d), parse("BOLT", case_sensitive=case), k=100_000).hits,
        _select("mixed", f"{PARTS}, mixed AS (SELECT * REPLACE (CASE WHEN entry_id % 3 = 0 THEN upper(name) ELSE name END AS name) FROM parts)", terms=("BOLT",), k=100_000, case_sensitive=_case),
    )
hits("name_ranked_topk", "parts", "bolt", terms=("bolt",), k=50)
hits("name_ranked_items", "items", "item_1", terms=("item_1",))
hits("name_ranked_many", "items", "item_", terms=("item_",), k=30_000)
add(
    "match_totals",
    lambda spark, d: search(cat.items(spark, d), parse("item_1 ext:csv")).totals,
    f"WITH {ITEMS} SELECT count(*) AS total, count(*) > 1000 AS truncated FROM items WHERE contains(name, 'item_1') AND {_ext()} = 'csv'",
)


def _returned(spark: SparkSession, d: str) -> DataFrame:
    """The items, of which those that were returned count as removed."""
    return cat.items(spark, d).withColumn("is_deleted", F.startswith("path", F.lit("/ship/R/")))


add("live_count", lambda spark, d: cat.live_count(_returned(spark, d)), f"WITH {ITEMS} SELECT count(*) AS live FROM items WHERE path NOT LIKE '/ship/R/%'")
add("live_rows", lambda spark, d: search(_returned(spark, d), parse("item_1"), k=1_000_000).hits, _select("items", ITEMS, "path NOT LIKE '/ship/R/%'", ("item_1",), 1_000_000))



def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """By the name index, after a change that renames every ninth part and adds some."""
    import uuid

    index, parts = NameIndex(spark, f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"), cat.parts(spark, d)
    index.add(parts)
    moved = parts.where("entry_id % 9 = 0")
    index.add(moved.withColumn("name", F.replace("name", F.lit("bolt"), F.lit("nut"))).union(moved.withColumn("entry_id", F.col("entry_id") + 10_000_000).withColumn("name", F.concat(F.lit("a BOLT "), "name"))))
    return index.matches(parse("bolt")).select("entry_id", "score", "name")


_RENAMED = f"""{PARTS}, changed AS (SELECT entry_id, CASE WHEN entry_id % 9 = 0 THEN replace(name, 'bolt', 'nut') ELSE name END AS name FROM parts UNION ALL SELECT entry_id + 10000000, 'a BOLT ' || name FROM parts WHERE entry_id % 9 = 0)"""
add("name_indexed", _indexed, f"WITH {_RENAMED} SELECT * FROM (SELECT entry_id, {_score('bolt')} AS score, name FROM changed) WHERE score IS NOT NULL")


def _one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Total and shown rows of one action: the catalog is read once."""
    rows, seen = one_pass(matches(cat.items(spark, d), parse("item_1 ext:csv")), 500)
    shown = rows.select("entry_id").toArrow().num_rows  # at most k
    total = int(seen.get["total"])
    return spark.createDataFrame([(total, total > shown, shown)], "total bigint, truncated boolean, shown bigint")


add("totals_one_pass", _one_pass, f"WITH {ITEMS} SELECT count(*) AS total, count(*) > 500 AS truncated, least(count(*), 500) AS shown FROM items WHERE contains(name, 'item_1') AND {_ext()} = 'csv'")

# Filters ---------------------------------------------------------------------------------------------------------

hits("filter_ext", "items", "ext:csv", "name LIKE '%.csv'", k=1_000_000)
hits("filter_ext_multi", "items", "ext:.CSV,rs e:flac", "regexp_matches(name, '[.](csv|rs|flac)$')", k=1_000_000)
hits("filter_path", "items", "path:/ship/R", f"contains({_fold('path')}, '/ship/r')", k=1_000_000)
hits("filter_path_multi", "items", "p:/a/ in:_7", f"contains({_fold('path')}, '/a/') AND contains(path, '_7')", k=1_000_000)
hits("filter_size_min", "items", "size:>90kb", "size >= 92160", k=1_000_000)
hits("filter_size_range", "items", "size:1kb..1.5kb", "size BETWEEN 1024 AND 1536")
hits("filter_size_approx", "parts", "size:10kb", "NOT is_dir AND size BETWEEN 9216 AND 11264")
hits("filter_size_two_sided", "items", "size:>2kb size:<=3kb", "size BETWEEN 2048 AND 3072")
hits("filter_date_min", "items", "date:>=1998-06-01", "modified >= 896659200", k=1_000_000)
hits("filter_date_max_excludes_day", "items", "date:<=1996-03-01", "modified < 825638400", k=1_000_000)
hits("filter_date_range", "items", "date:1995-01..1995-02", "modified >= 788918400 AND modified < 791683200")
hits("filter_date_day", "items", "modified:1996-03-05", "modified >= 825984000 AND modified < 826070400")
hits("filter_type_file", "parts", "type:file", "NOT is_dir", k=1_000_000)
hits("filter_type_folder", "parts", "t:dirs", "is_dir")
hits("filter_combined", "items", "item_2 ext:docx,csv size:>5kb date:>1994 path:/ship/n", f"regexp_matches(name, '[.](docx|csv)$') AND size >= 5120 AND modified >= 757382400 AND contains({_fold('path')}, '/ship/n')", terms=("item_2",))
for _c in (Category.DOCUMENTS, Category.IMAGES, Category.AUDIO, Category.VIDEO, Category.ARCHIVES, Category.CODE, Category.EXECUTABLES):
    hits(f"category_{_c.label.lower()}", "parts", "", _in(_c), category=_c)
hits("category_folders", "parts", "", "is_dir", category=Category.FOLDERS)
hits("category_files", "parts", "", "NOT is_dir", category=Category.FILES, k=1_000_000)

# Regular expressions and fuzzy names --------------------------------------------------------------------------------

hits("regex_name", "items", "^item_\\d+5_[12]\\.(csv|rs)$", "regexp_matches(name, '^item_[0-9]+5_[12]\\.(csv|rs)$')", mode=MatchMode.REGEX, score="CAST(greatest(0, 1000 - strlen(name)) AS BIGINT)")
hits("regex_case", "parts", "BOLT|gear", "regexp_matches(name, '(?i)bolt|gear')", mode=MatchMode.REGEX, score="CAST(greatest(0, 1000 - strlen(name)) AS BIGINT)")
hits("regex_invalid_empty", "items", "(unclosed", "false", mode=MatchMode.REGEX)
add(
    "fuzzy_members",
    lambda spark, d: matches(cat.parts(spark, d), parse("obt lt", MatchMode.FUZZY)).select("entry_id", "name"),
    f"WITH {PARTS} SELECT entry_id, name FROM parts WHERE regexp_matches({_fold('name')}, 'o.*b.*t') AND regexp_matches({_fold('name')}, 'l.*t')",
)
for _name, _text, _where in (
    ("fuzzy_prefix", "^ol bt", "starts_with({f}, 'ol') AND regexp_matches({f}, 'b.*t')"),
    ("fuzzy_suffix", "o png$", "ends_with({f}, 'png') AND contains({f}, 'o')"),
    ("fuzzy_substring", "'bolt !txt$ !^steel", "contains({f}, 'bolt') AND NOT ends_with({f}, 'txt') AND NOT starts_with({f}, 'steel')"),
    ("fuzzy_negative", "r !e", "contains({f}, 'r') AND NOT contains({f}, 'e')"),
):
    add(
        _name,
        lambda spark, d, text=_text: matches(cat.parts(spark, d), parse(text, MatchMode.FUZZY)).select("entry_id", "name"),
        f"WITH {PARTS} SELECT entry_id, name FROM parts WHERE {_where.format(f=_fold('name'))}",
    )


def _accented(spark: SparkSession, d: str) -> DataFrame:
    """Names with marks on their vowels, by turns in upper case: an atom without marks finds them, one with marks only itself."""
    name = F.translate("name", "aeo", "áêö")
    rows = cat.parts(spark, d).withColumn("name", F.when(F.col("entry_id") % 2 == 0, F.upper(name)).otherwise(name))
    return matches(rows, parse("bolt öl", MatchMode.FUZZY)).select("entry_id", "name")


add(
    "fuzzy_marks",
    _accented,
    f"""WITH {PARTS}, marked AS (SELECT entry_id, translate(name, 'aeo', 'áêö') AS low FROM parts)
    SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN upper(low) ELSE low END AS name FROM marked WHERE regexp_matches(strip_accents(lower(low)), 'b.*o.*l.*t') AND regexp_matches(lower(low), 'ö.*l')""",
)
_PLACES = "SELECT entry_id, name, unnest(range(1, length(name) + 1)) AS p FROM parts"
_GAIN = "16 + CASE WHEN p = 1 OR NOT regexp_matches(substr(name, p - 1, 1), '[A-Za-z0-9]') OR (regexp_matches(substr(name, p, 1), '[A-Z]') AND regexp_matches(substr(name, p - 1, 1), '[a-z]')) THEN 8 ELSE 0 END"
_STEP = "CASE WHEN {1}.p = {0}.p + 1 THEN 4 ELSE -3 - ({1}.p - {0}.p - 1) END"
add(
    "fuzzy_ranked",
    lambda spark, d: search(cat.parts(spark, d), parse("obt", MatchMode.FUZZY), k=100).hits,
    f"""WITH {PARTS}, places AS (SELECT entry_id, p, {_fold('substr(name, p, 1)')} AS c, {_GAIN} AS gain FROM ({_PLACES})),
    best AS (SELECT o.entry_id, max(o.gain + b.gain + t.gain + {_STEP.format('o', 'b')} + {_STEP.format('b', 't')}) AS score
        FROM places o JOIN places b ON b.entry_id = o.entry_id AND b.p > o.p JOIN places t ON t.entry_id = o.entry_id AND t.p > b.p WHERE o.c = 'o' AND b.c = 'b' AND t.c = 't' GROUP BY o.entry_id)
    SELECT entry_id, CAST(score AS BIGINT) AS score, name, path, is_dir, size, modified FROM parts JOIN best USING (entry_id) ORDER BY score DESC, entry_id LIMIT 100""",
)

# Content ---------------------------------------------------------------------------------------------------------


def _grep(source_where: str, test: str, k: int | None = 1000, count: bool = False, cap: int = 50_000) -> str:
    return f"""WITH {DOCS}, best AS (SELECT *, CAST(1 AS BIGINT) AS score FROM docs WHERE {source_where} ORDER BY entry_id LIMIT {cap}),
    lines AS (SELECT entry_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM best),
    firsts AS (SELECT entry_id, min(line_no) AS line_no FROM lines WHERE {test} GROUP BY entry_id),
    found AS (SELECT b.*, CAST(f.line_no AS BIGINT) AS line_no, left(rtrim(l.line, chr(9) || chr(10) || chr(13) || ' '), 300) AS line
              FROM best b JOIN firsts f USING (entry_id) JOIN lines l ON l.entry_id = f.entry_id AND l.line_no = f.line_no)
    """ + (f"SELECT count(*) AS total, count(*) > {k} AS truncated FROM found" if count else f"SELECT {HIT}, line_no, line FROM found ORDER BY score DESC, entry_id LIMIT {k}")


def _content(text: str, k: int = 1000, case: bool = False, mode: MatchMode = MatchMode.SUBSTRING) -> Query:
    return lambda spark, d: search(cat.docs(spark, d), parse(text, mode, case), k=k, texts=cat.doc_texts(spark, d)).hits


add("content_literal", _content('content:"license"', 100_000), _grep("true", "regexp_matches(line, '(?i)license')", 100_000))
add("content_case", _content("content:License", 100_000, True), _grep("true", "contains(line, 'License')", 100_000))
for _case in (False, True):
    add("content_mixed_case" + "_sensitive" * _case, _content("content:LES", 100_000, _case), _grep("true", "contains(line, 'LES')" if _case else "regexp_matches(line, '(?i)les')", 100_000))
add("content_regex", _content("c:(password|token)\\s*=", 100_000, mode=MatchMode.REGEX), _grep("true", "regexp_matches(line, '(?i)(password|token)\\s*=')", 100_000))
add("content_first_line", _content("ext:md content:les"), _grep("name LIKE '%.md'", "regexp_matches(line, '(?i)les')"))
add(
    "content_candidate_cap",
    lambda spark, d: search(cat.docs(spark, d), parse("doc_ content:the"), k=1000, texts=cat.doc_texts(spark, d), candidates=100).hits,
    f"""WITH {DOCS}, best AS (SELECT *, {_score('doc_')} AS score FROM docs ORDER BY score DESC, entry_id LIMIT 100),
    lines AS (SELECT entry_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM best),
    firsts AS (SELECT entry_id, min(line_no) AS n FROM lines WHERE regexp_matches(line, '(?i)the') GROUP BY entry_id)
    SELECT {', '.join('b.' + c.strip() for c in HIT.split(','))}, CAST(f.n AS BIGINT) AS line_no, left(rtrim(l.line), 300) AS line FROM best b JOIN firsts f USING (entry_id) JOIN lines l ON l.entry_id = f.entry_id AND l.line_no = f.n""",
)
add(
    "content_totals",
    lambda spark, d: search(cat.docs(spark, d), parse("content:license"), k=5, texts=cat.doc_texts(spark, d)).totals,
    _grep("true", "regexp_matches(line, '(?i)license')", 5, True),
)



def _written(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files in the shared folder; the catalog of them."""
    import os
    import uuid

    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}".removeprefix("file://")

    def write(batches):  # noqa: ANN001, ANN202
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                with open(f"{folder}/{i}.txt", "wb") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "size": [len((t or "").encode()) for t in batch["text"]]})

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cat.checkpointed(docs.mapInPandas(write, "doc_id long, size long"))
    return cat.entries(rows, F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.lit(folder), F.col("size"), F.lit(0))


def _in_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in ranges of a kilobyte, so that most are read by several tasks."""
    hits = search(_written(spark, d), parse("type:file"), k=1_000_000).hits
    return first_lines_of_files(hits, "license", size=1_024).select("entry_id", "size", "line_no", "line")


add("content_files", _in_files, f"SELECT entry_id, size, line_no, line FROM ({_grep('true', "regexp_matches(line, '(?i)license')", 1_000_000, cap=1_000_000)})")

# Documents and media, out of bytes built from the tables -------------------------------------------------------------


def office(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, kind, data): the documents table as zipped office files, a paragraph or cell for each line."""

    @pandas_udf("binary")
    def packed(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        members = {"docx": ("word/document.xml", "w:p"), "odt": ("content.xml", "text:p"), "xlsx": ("xl/sharedStrings.xml", "si")}
        out = []
        for text, kind in zip(texts, kinds, strict=True):
            data = io.BytesIO()
            if kind in members:
                name, tag = members[kind]
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, "<root>" + "".join(f"<{tag}><t>{escape(line)}</t></{tag}>" for line in (text or "").split("\n")) + "</root>")
            out.append(data.getvalue())
        return pd.Series(out, dtype=object)

    kind = F.when(F.col("lang") == "en", "docx").when(F.col("lang") == "fr", "odt").when(F.col("lang") == "de", "xlsx").otherwise("txt")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("entry_id"), kind.alias("kind"), "text")
    return rows.select("entry_id", "kind", packed(F.col("text"), F.col("kind")).alias("data"))


def _office_catalog(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.endswith("path", F.lit(".txt")), "docx").when(F.endswith("path", F.lit(".md")), "odt").when(F.contains("path", F.lit("/de/")), "xlsx").otherwise("txt")
    name = F.concat(F.lit("doc_"), F.col("entry_id").cast("string"), F.lit("."), kinds)
    return cat.docs(spark, d).withColumn("name", name).withColumn("path", F.concat(F.lit("/office/"), F.col("name")))


_OFFICE = """office AS (
    SELECT doc_id AS entry_id, 'doc_' || doc_id || '.' || kind AS name, '/office/doc_' || doc_id || '.' || kind AS path, false AS is_dir, kind,
           CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CAST(0 AS BIGINT) AS modified, CAST(1 AS BIGINT) AS score,
           CASE WHEN kind = 'txt' THEN string_split(text, chr(10))
                ELSE list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')), lambda s: s <> '') END AS lines
    FROM (SELECT *, CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'odt' WHEN 'de' THEN 'xlsx' ELSE 'txt' END AS kind FROM documents))"""
add(
    "content_documents",
    lambda spark, d: search(_office_catalog(spark, d), parse("content:le"), k=100_000, texts=cat.doc_texts(spark, d), documents=office(spark, d), candidates=None, max_file=None).hits,
    f"""WITH {_OFFICE}, lines AS (SELECT entry_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM office),
    firsts AS (SELECT entry_id, min(n) AS n FROM lines WHERE regexp_matches(line, '(?i)le') GROUP BY entry_id)
    SELECT {HIT}, CAST(n AS BIGINT) AS line_no, left(rtrim(lines[n], chr(9) || chr(10) || chr(13) || ' '), 300) AS line FROM office JOIN firsts USING (entry_id)""",
)
add(
    "extract_documents",
    lambda spark, d: office(spark, d).select("entry_id", document_text(F.col("data"), F.col("kind")).alias("text")),
    f"WITH {_OFFICE} SELECT entry_id, CASE WHEN kind <> 'txt' AND len(lines) > 0 THEN array_to_string(lines, chr(10)) END AS text FROM office",
)


def clips(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, kind, data): a movie for each part, by turns as MP4 and as Matroska, of p_size by p_size + 1 points."""

    @pandas_udf("binary")
    def filmed(keys: pd.Series, sizes: pd.Series, kinds: pd.Series) -> pd.Series:
        box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
        out = []
        for key, size, kind in zip(keys, sizes, kinds, strict=True):
            if kind == "mp4":
                head = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, int(key) * 10 + 10) + bytes(80))
                track = box(b"trak", box(b"tkhd", bytes(76) + struct.pack(">II", int(size) << 16, int(size) + 1 << 16)))
                out.append(box(b"ftyp", b"isom") + box(b"moov", head + track))
            else:
                out.append(b"\x1aE\xdf\xa3\x80" + bytes([0xB0, 0x81, size, 0xBA, 0x81, size + 1]) + b"\x2a\xd7\xb1\x83\x0f\x42\x40\x44\x89\x88" + struct.pack(">d", float(size)))
        return pd.Series(out, dtype=object)

    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("entry_id"), "p_size", F.when(F.col("p_partkey") % 2 == 0, "mp4").otherwise("mkv").alias("kind"))
    return rows.select("entry_id", "kind", filmed(F.col("entry_id"), F.col("p_size"), F.col("kind")).alias("data"))


add(
    "media_facts",
    lambda spark, d: clips(spark, d).select("entry_id", media_info(F.col("data"), F.col("kind")).alias("i")).select("entry_id", "i.*"),
    """SELECT CAST(p_partkey AS BIGINT) AS entry_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey * 10 + 10 AS DOUBLE) / 1000 ELSE CAST(p_size AS DOUBLE) / 1000 END AS duration_secs,
    CAST(p_size AS INTEGER) AS width, CAST(p_size + 1 AS INTEGER) AS height, CASE WHEN p_partkey % 2 = 0 THEN 'MP4' ELSE 'MKV' END AS format FROM part""",
)

# Sorting what is shown ----------------------------------------------------------------------------------------------

_TOP = f"WITH {PARTS}, top AS ({{}}), by_rank AS (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS r FROM top)".format(
    f"SELECT *, {_score('bolt')} AS score FROM parts WHERE contains({_fold('name')}, 'bolt') ORDER BY score DESC, entry_id LIMIT 40"
)
for _key, _down, _order in (
    (SortKey.NAME, False, "lower(name), r"),
    (SortKey.NAME, True, "lower(name) DESC, r DESC"),
    (SortKey.PATH, False, "path, r"),
    (SortKey.SIZE, True, "size DESC, r"),
    (SortKey.SIZE, False, "size, r DESC"),
):
    add(
        f"sort_{_key.value}" + ("" if _down is (_key not in (SortKey.NAME, SortKey.PATH)) else "_reversed"),
        lambda spark, d, key=_key, down=_down: numbered(search(cat.parts(spark, d), parse("bolt"), k=40).hits, key, down),
        f"{_TOP} SELECT {HIT}, CAST(row_number() OVER (ORDER BY {_order}) AS BIGINT) AS row_number FROM by_rank",
    )
for _down in (True, False):
    add(
        "sort_modified" + ("" if _down else "_reversed"),
        lambda spark, d, down=_down: numbered(search(cat.items(spark, d), parse("item_1"), k=200).hits, SortKey.MODIFIED, down),
        f"""WITH {ITEMS}, top AS (SELECT * FROM (SELECT *, {_score('item_1')} AS score FROM items) WHERE score IS NOT NULL ORDER BY score DESC, entry_id LIMIT 200),
        by_rank AS (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS r FROM top)
        SELECT {HIT}, CAST(row_number() OVER (ORDER BY {'modified DESC, r' if _down else 'modified, r DESC'}) AS BIGINT) AS row_number FROM by_rank""",
    )
add("row_numbers", lambda spark, d: numbered(search(cat.parts(spark, d), parse("bolt"), k=40).hits), f"{_TOP} SELECT {HIT}, CAST(r AS BIGINT) AS row_number FROM by_rank")

# Hierarchy -----------------------------------------------------------------------------------------------------------

_TREE = """tree AS (
    SELECT CAST(r_regionkey AS BIGINT) * 10 + 1 AS entry_id, '/' || r_name AS path, 0 AS hops FROM region
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 2, '/' || r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_custkey * 10 + 3, '/' || r_name || '/' || n_name || '/' || c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT o_orderkey * 10 + 4, '/' || r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey || '.ord', 3
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
add("resolve_paths", lambda spark, d: cat.resolve_paths(cat.tree(spark, d)).select("entry_id", "path", "hops"), f"WITH {_TREE} SELECT entry_id, path, CAST(hops AS INTEGER) AS hops FROM tree")


def _corrupt(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth customer is no folder, so paths below start at the order."""
    nodes = cat.tree(spark, d)
    return cat.resolve_paths(nodes.withColumn("is_dir", F.col("is_dir") & ~((F.col("entry_id") % 10 == 3) & (F.floor(F.col("entry_id") / 10) % 5 == 0)))).select("entry_id", "path", "hops")


add(
    "resolve_paths_corrupt",
    _corrupt,
    f"WITH {_TREE} SELECT entry_id, CASE WHEN bad THEN o_orderkey || '.ord' ELSE path END AS path, CAST(CASE WHEN bad THEN 0 ELSE hops END AS INTEGER) AS hops FROM (SELECT t.*, o_orderkey, coalesce(o_custkey % 5 = 0, false) AS bad FROM tree t LEFT JOIN orders ON t.entry_id = o_orderkey * 10 + 4)",
)
add(
    "derive_dirs",
    lambda spark, d: cat.derive_folders(cat.items(spark, d)),
    f"""WITH {ITEMS}, up AS (SELECT '/ship' AS path, 'ship' AS name, 1 AS depth FROM items UNION ALL SELECT '/ship/' || split_part(path, '/', 3), split_part(path, '/', 3), 2 FROM items
        UNION ALL SELECT '/ship/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4), split_part(path, '/', 4), 3 FROM items)
        SELECT path, name, CAST(depth AS BIGINT) AS depth, count(*) AS n_entries FROM up GROUP BY ALL""",
)
add(
    "metadata_fill",
    lambda spark, d: cat.fill_metadata(
        cat.parts(spark, d),
        spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entry_id"), (F.col("p_size").cast("long") * 7).alias("size"), (F.col("p_partkey") + 1000).alias("modified")),
    ).select("entry_id", "size", "modified"),
    f"WITH {PARTS} SELECT entry_id, CASE WHEN entry_id % 3 = 0 AND NOT is_dir THEN CAST(p_size AS BIGINT) * 7 ELSE size END AS size, CASE WHEN entry_id % 3 = 0 THEN entry_id + 1000 ELSE modified END AS modified FROM parts JOIN part ON entry_id = p_partkey",
)
add(
    "delete_from_results",
    lambda spark, d: without_paths(search(cat.parts(spark, d), parse("bolt"), k=100).hits, cat.parts(spark, d).where("entry_id % 2 = 0")),
    f"WITH {PARTS} SELECT * FROM (SELECT {HIT} FROM (SELECT *, {_score('bolt')} AS score FROM parts) WHERE score IS NOT NULL ORDER BY score DESC, entry_id LIMIT 100) WHERE path NOT IN (SELECT path FROM parts WHERE entry_id % 2 = 0)",
)
hits("search_in_folder", "parts", within_folder("bolt path:/elsewhere", "/parts/Brand#1"), f"contains({_fold('path')}, '/parts/brand#1')", terms=("bolt",))

# Exclusions ----------------------------------------------------------------------------------------------------------

add("exclude_component", lambda spark, d: cat.items(spark, d).where(~x.excluded(F.col("path"), ["r", "SHI", "f"])).select("entry_id", "path"), f"WITH {ITEMS} SELECT entry_id, path FROM items WHERE path NOT LIKE '%/R/%' AND path NOT LIKE '%/F/%'")
add("exclude_segment", lambda spark, d: cat.items(spark, d).where(~x.excluded(F.col("path"), ["\\ship\\n", "a/F", "hip/R/"])).select("entry_id", "path"), f"WITH {ITEMS} SELECT entry_id, path FROM items WHERE path NOT LIKE '/ship/N/%' AND path NOT LIKE '/ship/A/F/%'")

# Scalars -------------------------------------------------------------------------------------------------------------


def _item_scalar(name: str, column: Callable[[], Column], sql: str) -> None:
    add(name, lambda spark, d: cat.items(spark, d).select("entry_id", column().alias("value")), f"WITH {ITEMS} SELECT entry_id, {sql} AS value FROM items")


_item_scalar(
    "human_sizes",
    lambda: x.human_size(F.col("size") * F.col("size") % 5_000_000_000),
    "CASE WHEN s < 1024 THEN s || ' B' ELSE printf(CASE WHEN v >= 100 THEN '%.0f ' ELSE '%.1f ' END, v) || u END",
)
ORACLE_SQL["human_sizes"] = f"""WITH {ITEMS}, sized AS (SELECT entry_id, size * size % 5000000000 AS s FROM items),
    scaled AS (SELECT *, CASE WHEN s >= 1073741824 THEN s / 1073741824.0::DOUBLE WHEN s >= 1048576 THEN s / 1048576.0::DOUBLE ELSE s / 1024.0::DOUBLE END AS v,
               CASE WHEN s >= 1073741824 THEN 'GB' WHEN s >= 1048576 THEN 'MB' ELSE 'KB' END AS u FROM sized)
    SELECT entry_id, CASE WHEN s < 1024 THEN s || ' B' WHEN v >= 100 THEN printf('%.0f', v) || ' ' || u ELSE printf('%.1f', v) || ' ' || u END AS value FROM scaled"""
_item_scalar("human_dates", lambda: x.human_date(F.col("modified")), "strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M')")
_item_scalar("thousands", lambda: x.thousands(F.col("entry_id") * 7), "format('{:,}', entry_id * 7)")
_item_scalar("extensions", lambda: x.extension(F.col("name")), "regexp_extract(name, '[.]([a-z0-9]+)$', 1)")
add(
    "category_of",
    lambda spark, d: cat.parts(spark, d).where("not is_dir").select("entry_id", x.category_label(F.col("name")).alias("value")),
    f"""WITH {PARTS} SELECT entry_id, CASE {_ext()} WHEN 'txt' THEN 'Documents' WHEN 'pdf' THEN 'Documents' WHEN 'png' THEN 'Images' WHEN 'mp3' THEN 'Audio' WHEN 'mp4' THEN 'Video'
        WHEN 'zip' THEN 'Archives' WHEN 'py' THEN 'Code' WHEN 'exe' THEN 'Executables' ELSE 'Files' END AS value FROM parts WHERE NOT is_dir""",
)
add(
    "file_predicates",
    lambda spark, d: cat.parts(spark, d).select("entry_id", *(f(F.col("name")).alias(n) for n, f in (("texty", x.is_texty), ("image", x.is_image), ("document", x.is_document), ("media", x.is_media)))),
    f"WITH {PARTS}, e AS (SELECT entry_id, {_ext()} AS e FROM parts) SELECT entry_id, e IS NULL OR e IN ('txt', 'py') AS texty, coalesce(e = 'png', false) AS image, coalesce(e = 'pdf', false) AS document, coalesce(e IN ('mp3', 'mp4'), false) AS media FROM e",
)
add(
    "xml_strip",
    lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", x.strip_markup(F.col("html"), "</p>").alias("text")),
    """WITH plain AS (SELECT page_id, replace(regexp_replace(replace(html, '</p>', chr(10)), '<[^>]*(>|$)', '', 'g'), '>', '') AS t FROM pages),
    decoded AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)) AS t FROM plain)
    SELECT page_id, list_aggregate(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda s: regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')), lambda s: s <> ''), lambda s: s || chr(10)), 'string_agg', '') AS text FROM decoded""",
)
add(
    "preview_kinds",
    lambda spark, d: cat.parts(spark, d).select("entry_id", preview_kind(F.col("name"), F.col("is_dir"), F.col("size")).alias("kind")),
    f"WITH {PARTS}, e AS (SELECT entry_id, is_dir, {_ext()} AS e FROM parts) SELECT entry_id, CASE WHEN is_dir THEN 'folder' WHEN e = 'png' THEN 'image' WHEN e IN ('mp3', 'mp4') THEN 'media' WHEN e = 'pdf' THEN 'document' WHEN e IN ('txt', 'py') OR e IS NULL THEN 'text' ELSE 'info' END AS kind FROM e",
)
add(
    "parent_and_base",
    lambda spark, d: cat.items(spark, d).select("entry_id", x.parent_path(F.col("path")).alias("parent"), x.base_name(F.col("path")).alias("base")),
    f"WITH {ITEMS} SELECT entry_id, left(path, length(path) - length(name) - 1) AS parent, name AS base FROM items",
)
add(
    "selection_summary",
    lambda spark, d: cat.parts(spark, d).groupBy(F.col("path")).agg(F.count("*").alias("c")).select("path", x.selection_summary(F.col("c") - 1, F.col("path")).alias("summary")),
    f"WITH {PARTS} SELECT path, CASE count(*) WHEN 1 THEN 'nothing' WHEN 2 THEN any_value(name) ELSE (count(*) - 1) || ' items' END AS summary FROM parts GROUP BY path",
)

# Changes -------------------------------------------------------------------------------------------------------------

KINDS = {"signup": "create", "click": "modify", "view": "access", "purchase": "other", "error": "remove"}


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Change events out of the events table: a file per user, in ten folders."""
    kind = F.lit("any")
    for event, k in KINDS.items():
        kind = F.when(F.col("event_type") == event, k).otherwise(kind)
    path = F.concat(F.lit("/users/u"), (F.col("user_id") % 10).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".log"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").cast("long").alias("seq"), kind.alias("kind"), path.alias("path"), (F.col("event_id") % 11 != 0).alias("exists"), F.lit(False).alias("is_dir"), F.floor("value").cast("long").alias("size"), F.col("event_id").cast("long").alias("modified")
    )


def users(spark: SparkSession) -> DataFrame:
    """The catalog before the feed: the root, ten folders, and a file for each of the first 60 users."""
    n = spark.range(71).withColumnRenamed("id", "entry_id")
    u = F.col("entry_id") - 11
    path = F.when(F.col("entry_id") == 0, "/users").when(F.col("entry_id") <= 10, F.concat(F.lit("/users/u"), (F.col("entry_id") - 1).cast("string")))
    path = path.otherwise(F.concat(F.lit("/users/u"), (u % 10).cast("string"), F.lit("/f"), u.cast("string"), F.lit(".log")))
    return n.select("entry_id", F.lit(None).cast("long").alias("parent_id"), x.base_name(path).alias("name"), path.alias("path"), (F.col("entry_id") <= 10).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified"), F.lit(False).alias("is_deleted"))


_FEED = """feed AS (
    SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'access' WHEN 'purchase' THEN 'other' WHEN 'error' THEN 'remove' ELSE 'any' END AS kind,
           '/users/u' || (user_id % 10) || '/f' || user_id || '.log' AS path, event_id % 11 <> 0 AS exists_, CAST(floor(value) AS BIGINT) AS size FROM events),
    ops AS (SELECT *, CASE WHEN kind = 'access' THEN 'none' WHEN kind = 'remove' OR NOT exists_ THEN 'delete' ELSE 'upsert' END AS op FROM feed)"""
_USERS = """users AS (
    SELECT 0 AS entry_id, '/users' AS path, true AS is_dir UNION ALL SELECT k + 1, '/users/u' || k, true FROM range(10) t(k)
    UNION ALL SELECT k + 11, '/users/u' || (k % 10) || '/f' || k || '.log', false FROM range(60) t(k))"""
_MERGED = f"""WITH {_FEED}, {_USERS}, last AS (SELECT path, arg_max(op, seq) AS op, arg_max(size, seq) AS size, max(seq) AS seq FROM ops WHERE op <> 'none' {{}} GROUP BY path)
    SELECT path, coalesce(is_dir, false) AS is_dir, CASE WHEN op = 'upsert' THEN last.size ELSE 0 END AS size, CASE WHEN op = 'upsert' THEN seq ELSE 0 END AS modified, coalesce(op = 'delete', false) AS is_deleted
    FROM users FULL JOIN last USING (path) WHERE entry_id IS NOT NULL OR op = 'upsert'"""
_SHOWN = ("path", "is_dir", "size", "modified", "is_deleted")
_NUMBERED = f"""SELECT coalesce(entry_id, 70 + row_number() OVER (PARTITION BY entry_id IS NULL ORDER BY path)) AS entry_id, {', '.join(_SHOWN)} FROM ({_MERGED.replace('SELECT path, coalesce', 'SELECT entry_id, path, coalesce').format('')})"""
add("change_classify", lambda spark, d: ch.classified(feed(spark, d)).select("seq", "path", "op"), f"WITH {_FEED} SELECT seq, path, op FROM ops")
add("change_merge", lambda spark, d: ch.shown(ch.merge(users(spark), feed(spark, d))).select("entry_id", *_SHOWN), _NUMBERED)


def _late(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the feed first, then the first half: late events change nothing that later ones have decided."""
    events = feed(spark, d)
    later = F.col("seq") % 2 == 0
    once = ch.merge(users(spark), events.where(later))
    return ch.shown(ch.merge(once, events.where(~later))).select(*_SHOWN)


add("change_late_events", _late, _MERGED.format(""))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files of every second user become folders by their last event."""
    folder = F.col("path").rlike("f[0-9]*[02468][.]log$")
    return ch.shown(ch.merge(users(spark), feed(spark, d).withColumn("is_dir", folder).withColumn("size", F.when(folder, 0).otherwise(F.col("size"))))).select(*_SHOWN)


add(
    "change_kind",
    _kinds,
    f"""SELECT path, CASE WHEN turned THEN true ELSE is_dir END AS is_dir, CASE WHEN turned THEN 0 ELSE size END AS size, modified, is_deleted
    FROM (SELECT *, modified > 0 AND regexp_matches(path, 'f[0-9]*[02468][.]log$') AS turned FROM ({_MERGED.format('')}))""",
)
add("change_merge_excluded", lambda spark, d: ch.shown(ch.merge(users(spark), feed(spark, d), ["u3", "/u5"])).select(*_SHOWN), _MERGED.format("AND path NOT LIKE '/users/u3/%' AND path NOT LIKE '/users/u5/%'"))


def _subtree(spark: SparkSession, d: str) -> DataFrame:
    """Remove two folders of a large catalog."""
    gone = spark.range(1).select(F.explode(F.array(F.lit("/ship/R"), F.lit("/ship/N/O"))).alias("path"))
    return ch.shown(ch.merge(cat.items(spark, d), ch.removals(gone, 1))).groupBy("is_deleted").agg(F.count("*").alias("n"))


add("change_remove_subtree", _subtree, f"WITH {ITEMS} SELECT path LIKE '/ship/R/%' OR path LIKE '/ship/N/O/%' AS is_deleted, count(*) AS n FROM items GROUP BY 1")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The feed through Structured Streaming, in one pass over its files."""
    import uuid

    from shelfmark.streaming.feed import changes_stream, follow

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    changes = feed(spark, d)
    n = changes.count()
    for k in range(2):  # two arrivals
        changes.where((F.col("seq") < n // 2) if k == 0 else (F.col("seq") >= n // 2)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    log = ChangeLog(spark, f"{base}/catalog")
    log.start(users(spark), ["/users"], 1)
    follow(changes_stream(spark, f"{base}/in", 1), log, f"{base}/state", once=True).awaitTermination()
    return log.live().select(*_SHOWN)


add("change_stream", _streamed, f"SELECT * FROM ({_MERGED.format('')}) WHERE NOT is_deleted")

def _logged(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a log in five batches, out of order, with a compaction between and a batch that comes twice."""
    import uuid

    log, events = ChangeLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"), feed(spark, d)
    log.start(users(spark), ["/users"], 1)
    for number, part in enumerate((3, 0, 4)):
        log.append(events.where(F.col("seq") % 5 == part), number)
    log.compact()
    for number, part in ((3, 2), (4, 1), (4, 1)):
        log.append(events.where(F.col("seq") % 5 == part), number)
    return log.read().select(*_SHOWN)


add("change_log", _logged, _MERGED.format(""))

# Subtrees as ranges ----------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(cat.resolve_paths(cat.tree(spark, d))).select("entry_id", "pre", "last")


_KEYED = f"""WITH {_TREE}, keyed AS (SELECT entry_id, path, row_number() OVER (ORDER BY replace(path, '/', chr(1)), entry_id) - 1 AS pre FROM tree),
    below AS (SELECT path, unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(2, len(string_split(path, '/')) + 1)]) AS folder FROM tree),
    sizes AS (SELECT folder, count(*) AS n FROM below GROUP BY folder)"""
add("subtree_labels", _labels, f"{_KEYED} SELECT entry_id, pre, pre + n - 1 AS last FROM keyed JOIN sizes ON folder = path")


def _in_subtree(spark: SparkSession, d: str) -> DataFrame:
    """The orders below one nation, as a range of labels."""
    labels = labelled(cat.resolve_paths(cat.tree(spark, d)))
    return subtree(labels, "/EUROPE/FRANCE").where(~F.col("is_dir")).select("entry_id", "path")


add("subtree_range", _in_subtree, f"WITH {_TREE} SELECT entry_id, path FROM tree WHERE path LIKE '/EUROPE/FRANCE/%' AND hops = 3")


def _swept(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth customer's folder is removed, and a nation's: more folders than range predicates are made for."""
    nodes = cat.resolve_paths(cat.tree(spark, d))
    customer, n = F.col("entry_id") % 10 == 3, F.floor(F.col("entry_id") / 10)
    removed = nodes.where((customer & (n % 10 == 0)) | F.endswith("path", F.lit("/FRANCE"))).select("path", F.when(customer, n).otherwise(100).alias("seq"))
    return removed_at(nodes.select("path"), removed)


add(
    "subtree_removals",
    _swept,
    f"""WITH {_TREE}, removed AS (SELECT path, CASE WHEN entry_id % 10 = 3 THEN entry_id // 10 ELSE 100 END AS seq FROM tree WHERE (entry_id % 10 = 3 AND entry_id // 10 % 10 = 0) OR path LIKE '%/FRANCE'),
    up AS (SELECT path, unnest([path, regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*/[^/]*$', '')]) AS folder FROM tree)
    SELECT up.path, max(seq) AS removed_at FROM up JOIN removed ON folder = removed.path GROUP BY up.path""",
)

# Rescans ---------------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """The tree with sizes and times."""
    rows, none = cat.resolve_paths(cat.tree(spark, d)), F.lit(0).cast("long")
    return rows.select("entry_id", "parent_id", "name", "path", "is_dir", F.when(F.col("is_dir"), none).otherwise(F.col("entry_id")).alias("size"), none.alias("modified"), F.lit(False).alias("is_deleted"))


def _rescanned(rows: DataFrame) -> DataFrame:
    """Customers gone, orders grown and renamed since."""
    customer = F.regexp_extract("path", "^/[^/]+/[^/]+/Customer#0*([0-9]+)", 1).try_cast("long")
    order = F.floor(F.col("entry_id") / 10)
    left = rows.where(F.coalesce(customer % 7 != 0, F.lit(True)))
    grown = F.when(~F.col("is_dir") & (order % 5 == 0), F.col("size") + 1).otherwise(F.col("size"))
    return left.withColumn("size", grown).withColumn("path", F.when(~F.col("is_dir") & (order % 11 == 0), F.concat("path", F.lit("~"))).otherwise(F.col("path")))


def _rescan(spark: SparkSession, d: str) -> DataFrame:
    held = cat.checkpointed(_sized(spark, d))
    return differences(held, _rescanned(held), 1).select("kind", "path", "is_dir", "size")


_AGAIN = f"""WITH {_TREE}, held AS (SELECT path, hops < 3 AS is_dir, CASE WHEN hops < 3 THEN 0 ELSE entry_id END AS size, entry_id // 10 AS n FROM tree),
    kept AS (SELECT *, coalesce(TRY_CAST(regexp_extract(path, '^/[^/]+/[^/]+/Customer#0*([0-9]+)', 1) AS BIGINT) % 7 = 0, false) AS gone FROM held),
    again AS (SELECT CASE WHEN NOT is_dir AND n % 11 = 0 THEN path || '~' ELSE path END AS path, is_dir, CASE WHEN NOT is_dir AND n % 5 = 0 THEN size + 1 ELSE size END AS size FROM kept WHERE NOT gone)"""
add(
    "rescan_changes",
    _rescan,
    f"""{_AGAIN}, removed AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM held WHERE path NOT IN (SELECT path FROM again))
    SELECT CASE WHEN h.path IS NULL THEN 'create' ELSE 'modify' END AS kind, a.path, a.is_dir, a.size FROM again a LEFT JOIN held h ON a.path = h.path WHERE h.path IS NULL OR a.size <> h.size
    UNION ALL SELECT 'remove', path, false, 0 FROM removed WHERE folder NOT IN (SELECT path FROM removed)""",
)


def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    """A catalog that is built, found to be fresh, then found to be stale and refreshed."""
    import uuid

    folder, held = f"{shared_folder(spark)}/open-{uuid.uuid4().hex}", cat.checkpointed(_sized(spark, d))
    how = [open_or_build(spark, folder, ["/"], lambda rows=rows: rows, now)[1] for rows, now in ((held, 10), (held, 20), (_rescanned(held), 100_000))]
    if how != ["built", "loaded", "refreshed"]:
        raise AssertionError(how)
    return ChangeLog(spark, folder).live().select("path", "is_dir", "size")


add("rescan_refreshed", _refreshed, f"{_AGAIN} SELECT path, is_dir, size FROM again")

# The first scan --------------------------------------------------------------------------------------------------------


def _first_scan(spark: SparkSession, d: str) -> DataFrame:
    """The tree as a stream of batches, searched after each of them; what the scan gives in the end."""
    import uuid

    from shelfmark.streaming.scan import node_scan

    scan, seen = node_scan(cat.tree(spark, d), f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}", 4_096, growing=True), []

    def look(progress: dict) -> None:
        totals = search(scan.catalog(), parse("a type:folder")).totals.first()
        seen.append((progress["batch"], progress["rows"], totals["total"]))

    whole = scan.run(look)
    if [s[1:] for s in seen] != sorted(s[1:] for s in seen):
        raise AssertionError("a later search saw less")
    return whole.select("entry_id", "path", "is_dir")


add("first_scan", _first_scan, f"WITH {_TREE} SELECT entry_id, path, hops < 3 AS is_dir FROM tree")

FLAGSHIP = "name_ranked_topk"
