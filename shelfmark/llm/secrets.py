r"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base findings are the leftmost non-overlapping matches of three patterns, kept if long enough. The method adds spans
of kind ``entropy``: every run of characters of a class (hexadecimal digits, or the base64 alphabet) that is long
enough to be a key is a candidate. A window of fixed length slides over it. The counts of the characters in the window
and the sum of ``c * log2(c)`` over them are updated by the character that leaves and the one that enters, so each step
gives the Shannon entropy ``log2(w) - sum / w`` without recounting. Windows at or above the threshold of the class are
merged to spans. A candidate that is a UUID adds nothing, nor does a span that holds a documentation example or a filler, or
has one within ``MARGIN`` characters of the candidate, nor a span inside a base finding.

Main path: SQL functions only; there is no shuffle and the work of a row depends on that row alone.

Defined results: a null or empty text has no finding (``base_sha256`` is that of the empty string, ``spans`` is empty).
Offsets are code points, the end exclusive. Repeated rows give repeated results, an empty table an empty one. Columns
that the scan adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import let, table

#: Fixed patterns: kind, pattern, group to measure, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a maximal run either has 24 characters or fails as a whole
)
KINDS = ("assign", "access", "hex", "entropy")
#: Matches whose offsets are summed up together.
PART = 128


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidate strings. ``needs``: patterns that all must be found in a candidate."""

    name: str
    run: str
    window: int
    threshold: float
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("hexadecimal", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", 20, 2.75, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.65, ("[0-9]", "[A-Za-z]", "[G-Zg-z+/_=-]")),
)
#: Candidates that are no secrets as a whole, and what no span may hold or stand beside.
ALLOW_WHOLE = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
MARGIN = 12
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(.)\1{7}",
    r"(?i)0123456789abcdef|abcdefghijklmnop",
)


def occurrences(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches; ``value`` is the text of ``group``.

    ``gate`` is a cheap condition that every text with a match meets.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    places = "array<struct<start:int,end:int>>"

    def place(pieces: Column, found: Column, values: Column) -> Column:
        """Offsets are sums of lengths: first within parts of PART matches, then over the parts, so that no list is copied for every match."""

        def within(part: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(pieces, i))
                m = F.struct(start.alias("start"), (start + F.length(F.get(found, i))).alias("end"))
                return let(m, lambda m: F.struct(m["end"].alias("at"), F.concat(acc["out"], F.array(m)).alias("out")))

            last = F.least((part + 1) * PART, F.size(found)) - 1
            return F.aggregate(F.sequence(part * PART, last), F.struct(F.lit(0).alias("at"), F.array().cast(places).alias("out")), step)

        def over(parts: Column) -> Column:
            begins = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))

            def moved(begins: Column) -> Column:
                shift = lambda p, k: F.transform(p["out"], lambda m: F.struct((m["start"] + F.get(begins, k)).alias("start"), (m["end"] + F.get(begins, k)).alias("end")))
                return F.flatten(F.transform(parts, shift))

            return F.zip_with(let(begins, moved), values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), v.alias("value")))

        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int")), within), over)

    def all_of(t: Column) -> Column:
        p = F.lit(pattern)
        parts = F.struct(
            F.split(t, pattern, -1).alias("pieces"),
            F.regexp_extract_all(t, p, F.lit(0)).alias("found"),
            F.regexp_extract_all(t, p, F.lit(group)).alias("values"),
        )
        return let(parts, lambda x: place(x["pieces"], x["found"], x["values"]))

    return F.when(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), all_of(text)).otherwise(nothing)


def _gate(kind: str, text: Column) -> Column | None:
    """What a text must hold to have a finding of a base kind."""
    return {"assign": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), "access": F.contains(text, F.lit("AKIA"))}.get(kind)


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def entropy_spans(candidate: Column, window: int, threshold: float) -> Column:
    """Array of (start, end) within an ASCII string: merged windows whose entropy reaches the threshold."""
    spans = "array<struct<start:int,end:int>>"
    nothing = F.array().cast(spans)

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = codes[i]
            leaves = F.when(i >= window, codes[F.greatest(i - window, F.lit(0))]).otherwise(F.lit(-1))

            def moved(x: Column) -> Column:
                a, r = x["enters"], x["leaves"]
                up, down = acc["counts"][a], F.when(r >= 0, acc["counts"][F.greatest(r, F.lit(0))]).otherwise(F.lit(0))
                total = acc["total"] + F.when(
                    a == r, F.lit(0.0)
                ).otherwise(_nlogn(up + 1) - _nlogn(up) + F.when(r >= 0, _nlogn(down - 1) - _nlogn(down)).otherwise(F.lit(0.0)))
                counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == a, 1).otherwise(0) - F.when(k == r, 1).otherwise(0))
                return let(F.struct(total.alias("total"), counts.alias("counts")), lambda y: judged(y["total"], y["counts"]))

            def judged(total: Column, counts: Column) -> Column:
                high = (i >= window - 1) & (F.log2(F.lit(float(window))) - total / window >= threshold - 1e-9)
                start = i - (window - 1)
                opens = high & ((acc["end"] < start) | (acc["start"] < 0))
                return F.struct(
                    counts.alias("counts"),
                    total.alias("total"),
                    F.when(opens, start).otherwise(acc["start"]).alias("start"),
                    F.when(high, i + 1).otherwise(acc["end"]).alias("end"),
                    F.when(opens & (acc["start"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
                    .otherwise(acc["out"])
                    .alias("out"),
                )

            return let(F.struct(enters.alias("enters"), leaves.alias("leaves")), moved)

        first = F.struct(
            F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), nothing.alias("out")
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            first,
            step,
            lambda acc: F.when(acc["start"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]),
        )

    return F.when(F.length(candidate) >= window, let(F.transform(F.split(candidate, ""), F.ascii), scan)).otherwise(nothing)


def _candidates(text: Column, cls: CharacterClass) -> Column:
    def wanted(m: Column) -> Column:
        ok = F.lit(True)
        for need in cls.needs:
            ok = ok & m["value"].rlike(need)
        return ok & ~m["value"].rlike(ALLOW_WHOLE)

    return F.filter(occurrences(text, cls.run, gate=text.rlike("[0-9]")), wanted)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["value"]) >= least)


def _high(text: Column, cls: CharacterClass) -> Column:
    """The spans of high entropy of one class, in offsets of the text."""

    def placed(m: Column) -> Column:
        moved = lambda s: F.struct((m["start"] + s["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + s["end"]).alias("end"))
        near = lambda s: F.substring(m["value"], F.greatest(s["start"] - MARGIN, F.lit(0)) + 1, s["end"] - F.greatest(s["start"] - MARGIN, F.lit(0)) + MARGIN)
        allowed = lambda s: let(near(s), lambda v: F.array(*(v.rlike(p) for p in ALLOW)))
        return F.transform(F.filter(entropy_spans(m["value"], cls.window, cls.threshold), lambda s: ~F.array_contains(allowed(s), True)), moved)

    return F.flatten(F.transform(_candidates(text, cls), placed))


def findings(text: Column) -> tuple[list[Column], Callable[[Column], Column]]:
    """Arrays of (start, kind, end) of the base kinds, and of the entropy spans beside given base spans."""
    base = [_spans(_long_enough(occurrences(text, pattern, group, _gate(kind, text)), least), k) for k, (kind, pattern, group, least) in enumerate(BASE)]
    high = [_high(text, cls) for cls in CLASSES]
    within = lambda s, x: (x["start"] <= s["start"]) & (x["end"] >= s["end"])
    return base, lambda found: let(found, lambda b: F.array_distinct(F.filter(F.concat(*high), lambda s: ~F.exists(b, lambda x: within(s, x)))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with array columns ``assign``, ``access``, ``hex`` and ``entropy`` of (start, kind, end)."""
    base, entropy = findings(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns(dict(zip(KINDS, base, strict=False))).withColumn("entropy", entropy(F.concat(*KINDS[:3])))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark. No other column changes."""
    t = F.coalesce(F.col(text), F.lit(""))
    base, entropy = findings(t)
    found = docs.withColumn("__base", F.concat(*base)).withColumn("__spans", F.array_sort(F.concat("__base", entropy(F.col("__base")))))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.col(text).isNull(), F.lit(None).cast("string")).otherwise(clean)).drop("__base", "__spans")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, as counts, a digest of the base spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


QUERIES = {"op3_secret_scans": op3_secret_scans}
ORACLE_SQL: dict[str, str] = {}
