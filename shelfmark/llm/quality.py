r"""Quality rules: distribution divergence from language references.

Two histograms describe a document: its code points by character class, and its words by the common words of a
language (one bin each, one more for the rest). The references are the same histograms summed over all documents of
that language in the corpus. A document is compared with every reference, and its distance is the least over the
languages of the larger of the two Jensen-Shannon distances (base 2, so 0 to 1). Documents under ``MIN_WORDS`` words
have a wider limit, ``SHORT_DISTANCE``, as thin histograms stray further; the base rule guards those under 50.

Base rules come first: fewer than 50 words, or more than half of the words in repeated 3-word windows, fail.

Main path: SQL functions only. The references are one row per language of ``COMMON_WORDS`` at most, which bounds the
broadcast. Nothing else is shuffled.

Defined results: a null text has no words and fails; so does an empty one. The base rules alone decide where no language
has a reference, and for a document in a language without one: ``COMMON_WORDS`` is what a further language is added to.
A document whose ``lang`` is null is judged by the nearest reference. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import let, table, words

#: Common words of each language, in natural order.
COMMON_WORDS = {
    "de": "als auf das der die ein ist mit und von zu für",
    "en": "a and as for in is of that the this to with",
    "es": "de del el en la las los por que se una y",
    "fr": "dans de des en est et la le les que sur un",
}
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "lower", "upper", "digit", "symbol", "mark", "other")
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~"
MIN_WORDS = 100
#: A document further than this from every reference is rejected.
MAX_DISTANCE = 0.25
#: The same for documents of fewer than MIN_WORDS words.
SHORT_DISTANCE = 0.28


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _class_counts(text: Column) -> Column:
    """Code points by class, in the order of CLASSES. One pass takes the bulk away, the rest is short."""
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def counts(x: Column) -> Column:
        solid, rest = x["solid"], x["rest"]
        known = [_count(rest, c) for c in (upper, digits, SYMBOLS, MARKS)]
        other = F.length(rest) - sum(known[1:], known[0])
        return F.array(*(c.cast("long") for c in (F.length(text) - solid, solid - F.length(rest), *known, other)))

    solid = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")
    return let(solid, lambda s: let(F.struct(F.length(s).alias("solid"), F.regexp_replace(s, "[a-z]+", "").alias("rest")), counts))


def _common_counts(lowered: Column) -> Column:
    """For each language the counts of its common words: array of arrays, languages in order of name."""
    lists = [COMMON_WORDS[k].split() for k in sorted(COMMON_WORDS)]
    every = sorted({w for ws in lists for w in ws})
    hits = F.filter(lowered, lambda w: w.isin(every))
    size = lambda found, word: (F.size(found) - F.size(F.array_remove(found, word))).cast("long")
    return let(hits, lambda found: F.array(*(F.array(*(size(found, w) for w in ws)) for ws in lists)))


def histograms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``classes`` (counts by class) and ``common`` (counts of common words by language)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("classes", _class_counts(t)).withColumn("common", _common_counts(words(F.lower(t))))


def repeated_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more."""

    def positions(pairs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(pairs) - 1)
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twin = F.filter(at, lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.array_sort(F.transform(twin, lambda i: pairs[i]["i"]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda p: let(positions(p), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(windows, counted))


def measures(text: Column) -> Column:
    """Struct of the base measures of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return let(
        words(t),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.concat_ws("", ws)).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )


def references(docs: DataFrame) -> DataFrame:
    """One row per known language that has documents: its name and the two reference distributions."""
    hist = histograms(docs.where(F.col("lang").isin(sorted(COMMON_WORDS))).select("lang", "text"))
    languages = sorted(COMMON_WORDS)
    own = F.get("common", F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1)
    n_words = F.size(words(F.col("text"))).cast("long")
    flat = hist.select("lang", "classes", own.alias("own"), n_words.alias("n"))
    longest = max(len(v.split()) for v in COMMON_WORDS.values())
    sums = flat.groupBy("lang").agg(
        F.array(*(F.sum(F.get("classes", F.lit(k))) for k in range(len(CLASSES)))).alias("classes"),
        F.array(*(F.sum(F.coalesce(F.get("own", F.lit(k)), F.lit(0))) for k in range(longest))).alias("own"),
        F.sum("n").alias("n"),
    )
    share = lambda counts: let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: x / n))
    rest = F.array(F.col("n") - F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x))
    return sums.where("n > 0").select("lang", share(F.col("classes")).alias("classes"), share(F.concat("own", rest)).alias("words"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions given as arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``docs`` with struct ``quality``: the base measures, base_failed, distance (null if not judged) and kept."""
    refs = references(docs) if refs is None else refs
    one = refs.agg(F.array_sort(F.collect_list(F.struct("lang", "classes", "words"))).alias("__refs"))  # a row of four entries at most
    languages = sorted(COMMON_WORDS)

    def nearest(classes: Column, common: Column, n: Column) -> Column:
        shares = F.transform(classes, lambda x: x / F.greatest(F.aggregate(classes, F.lit(0).cast("long"), lambda a, c: a + c), F.lit(1)))

        def to_one(ref: Column) -> Column:
            own = F.get(common, F.array_position(F.array(*map(F.lit, languages)), ref["lang"]).cast("int") - 1)
            rest = n - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
            word_shares = F.transform(F.concat(own, F.array(rest)), lambda x: x / F.greatest(n, F.lit(1)))
            return F.greatest(js_distance(shares, ref["classes"]), js_distance(word_shares, ref["words"]))

        return F.array_min(F.transform(F.col("__refs"), to_one))

    known = F.col("lang").isNull() | F.exists("__refs", lambda r: r["lang"] == F.col("lang"))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        t = F.coalesce(F.col("text"), F.lit(""))
        far = F.when(
            known & ~failed,
            let(F.struct(_class_counts(t).alias("a"), _common_counts(words(F.lower(t))).alias("b")), lambda h: nearest(h["a"], h["b"], m["n_words"])),
        )
        limit = F.when(m["n_words"] < MIN_WORDS, SHORT_DISTANCE).otherwise(MAX_DISTANCE)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return let(
            far,
            lambda d: F.struct(
                *(m[k].alias(k) for k in names), failed.alias("base_failed"), d.alias("distance"), (~failed & (F.coalesce(d, F.lit(0.0)) <= limit)).alias("kept")
            ),
        )

    out = docs.drop("quality").join(F.broadcast(one))  # one row on the right
    return out.withColumn("quality", let(measures(F.col("text")), verdict)).drop("__refs")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged."""
    return judge(docs).where("quality.kept").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "quality.*").withColumn("distance", F.round("distance", 6))


def _sql() -> str:
    """The same rules in DuckDB's SQL, one row per bin where the columns above hold arrays."""
    blank = r"[ \t\n\v\f\r]"
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    commons = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, v in COMMON_WORDS.items() for w in v.split())
    known = ", ".join(map(quoted, COMMON_WORDS))
    count = lambda c: f"length(solid) - length(translate(solid, {quoted(c)}, ''))"
    bins = {
        "space": "n_chars - length(solid)",
        "lower": "length(solid) - length(regexp_replace(solid, '[a-z]', '', 'g'))",
        "upper": "length(solid) - length(regexp_replace(solid, '[A-Z]', '', 'g'))",
        "digit": "length(solid) - length(regexp_replace(solid, '[0-9]', '', 'g'))",
        "symbol": count(SYMBOLS),
        "mark": count(MARKS),
    }
    bins["other"] = "length(solid) - (" + " + ".join(f"({v})" for k, v in bins.items() if k != "space") + ")"
    classes = " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS bin, {v} AS c FROM d" for k, v in bins.items())
    distance = lambda own, ref: f"""SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
        FROM (SELECT o.doc_id, r.lang, o.c / o.total AS p, r.c / r.total AS q FROM {own} o JOIN {ref} r ON o.bin = r.bin AND o.{"lang" if own == "own_words" else "same"} = r.{"lang" if own == "own_words" else "same"}) GROUP BY ALL"""  # noqa: E731
    return f"""
    WITH t0 AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    d AS (SELECT doc_id, lang, t, length(t) AS n_chars, regexp_replace(t, '{blank}', '', 'g') AS solid, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS ls FROM t0),
    grams AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM d, unnest(range(1, len(ws) - 1)) AS u(i)),
    twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
    m AS (SELECT d.doc_id, d.lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count(SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
          coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN covered c USING (doc_id)),
    cls AS (SELECT *, 1 AS same, greatest(sum(c) OVER (PARTITION BY doc_id), 1)::DOUBLE AS total FROM ({classes})),
    lowered AS (SELECT doc_id, unnest(regexp_split_to_array(lower(t), '{blank}+')) AS w FROM d),
    common AS (SELECT * FROM (VALUES {commons}) AS v(lang, w)),
    hit AS (SELECT doc_id, w, count(*) AS c FROM lowered WHERE w IN (SELECT w FROM common) GROUP BY ALL),
    listed AS (SELECT m.doc_id, m.lang AS doc_lang, k.lang, k.w AS bin, coalesce(h.c, 0) AS c, m.n_words FROM m CROSS JOIN common k LEFT JOIN hit h ON h.doc_id = m.doc_id AND h.w = k.w),
    own_words AS (SELECT doc_id, doc_lang, lang, bin, c, greatest(n_words, 1)::DOUBLE AS total FROM listed
        UNION ALL SELECT doc_id, doc_lang, lang, chr(1), n_words - sum(c), greatest(n_words, 1)::DOUBLE FROM listed GROUP BY doc_id, doc_lang, lang, n_words),
    ref_words AS (SELECT lang, bin, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang)::DOUBLE AS total FROM own_words WHERE doc_lang = lang GROUP BY lang, bin),
    ref_cls AS (SELECT lang, 1 AS same, bin, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang)::DOUBLE AS total FROM cls WHERE lang IN ({known}) GROUP BY lang, bin),
    far AS (SELECT a.doc_id, min(greatest(a.js, b.js)) AS distance FROM ({distance("cls", "ref_cls")}) a JOIN ({distance("own_words", "ref_words")}) b USING (doc_id, lang)
            WHERE a.lang IN (SELECT lang FROM ref_words WHERE total > 0) GROUP BY a.doc_id),
    v AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          CASE WHEN m.lang IS NULL OR m.lang IN (SELECT lang FROM ref_words WHERE total > 0) THEN f.distance END AS js FROM m LEFT JOIN far f USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(CASE WHEN NOT base_failed THEN js END, 6) AS distance,
           NOT base_failed AND coalesce(js, 0) <= CASE WHEN n_words < {MIN_WORDS} THEN {SHORT_DISTANCE} ELSE {MAX_DISTANCE} END AS kept FROM v"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": _sql()}
