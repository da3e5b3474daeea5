"""Scalar functions as Column expressions; all stay on the JVM.

Case is folded for A to Z only, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.plans.parser import fold
from shelfmark.plans.spec import DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS, MEDIA_EXTENSIONS, TEXT_EXTENSIONS, Category

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def position(text: Column, needle: str, case_sensitive: bool = False) -> Column:
    """1-based position of the first occurrence, 0 if there is none; an empty needle is found at 1."""
    return F.locate(needle, text) if case_sensitive else F.locate(fold(needle), folded(text))


def holds(text: Column, needle: str, case_sensitive: bool = False) -> Column:
    return F.contains(text, F.lit(needle)) if case_sensitive else F.contains(folded(text), F.lit(fold(needle)))


def extension(name: Column) -> Column:
    """What follows the last dot; null if there is no dot, or it comes first or last."""
    found = F.regexp_extract(name, r"(?s)^.+[.]([^.]+)$", 1)
    return F.when(found != "", found)


def stem_length(name: Column) -> Column:
    """Code points of the name before its extension."""
    return F.length(name) - F.coalesce(F.length(extension(name)) + 1, F.lit(0))


def in_category(name: Column, is_dir: Column, category: Category) -> Column:
    if category is Category.ALL:
        return F.lit(True)
    if category is Category.FOLDERS:
        return is_dir
    if category is Category.FILES:
        return ~is_dir
    return ~is_dir & F.coalesce(folded(extension(name)).isin(*category.extensions), F.lit(False))


def category_label(name: Column) -> Column:
    """The first category of a file name, in the order icons are chosen; Files if none."""
    order = (Category.IMAGES, Category.AUDIO, Category.VIDEO, Category.ARCHIVES, Category.CODE, Category.EXECUTABLES, Category.DOCUMENTS)
    out = F.lit(Category.FILES.label)
    for category in reversed(order):
        out = F.when(in_category(name, F.lit(False), category), F.lit(category.label)).otherwise(out)
    return out


def _has_extension(name: Column, known: tuple[str, ...]) -> Column:
    return F.coalesce(folded(extension(name)).isin(*known), F.lit(False))


def is_texty(name: Column) -> Column:
    """Whether a file counts as text; a name without an extension does."""
    return extension(name).isNull() | _has_extension(name, Category.CODE.extensions + TEXT_EXTENSIONS)


def is_image(name: Column) -> Column:
    return _has_extension(name, IMAGE_EXTENSIONS)


def is_document(name: Column) -> Column:
    return _has_extension(name, DOCUMENT_EXTENSIONS)


def is_media(name: Column) -> Column:
    return _has_extension(name, MEDIA_EXTENSIONS)


def human_size(size: Column) -> Column:
    """``1.2 MB``: no decimals from 100 on, else one; ties go to even."""
    out = None
    for k in range(5, 0, -1):
        value = size.cast("double") / float(1024**k)
        unit = ("KB", "MB", "GB", "TB", "PB")[k - 1]
        text = F.when(value >= 100, F.format_string(f"%.0f {unit}", F.bround(value, 0))).otherwise(F.format_string(f"%.1f {unit}", F.bround(value, 1)))
        out = F.when(size >= 1024**k, text) if out is None else out.when(size >= 1024**k, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def human_date(seconds: Column) -> Column:
    """``2024-01-31 09:30`` in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone; 0 for null or what lies before 1970."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("long")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """The folder of a path; ``/`` for what stands below the root, empty for a bare name."""
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit("")).when(cut == "", F.lit("/")).otherwise(cut)


def selection_summary(count: Column, first_path: Column) -> Column:
    """What a selection is called: nothing, the name of the one item, or a number of items."""
    return F.when(count == 0, F.lit("nothing")).when(count == 1, base_name(first_path)).otherwise(F.concat(count.cast("string"), F.lit(" items")))


def media_summary(info: Column) -> Column:
    """``3:42  •  1920×1080  •  MP4`` from a struct of duration_secs, width, height, format; missing parts are left out."""
    total = F.floor(info["duration_secs"] + 0.5).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    clock = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.concat_ws("  •  ", F.when(total.isNotNull(), clock), F.concat(info["width"].cast("string"), F.lit("×"), info["height"].cast("string")), info["format"])


def strip_markup(markup: Column, paragraph: str) -> Column:
    """The text of XML or HTML: a closing paragraph tag ends a line, tags go, five entities are decoded, lines are trimmed.

    The ampersand is decoded first, so ``&amp;lt;`` becomes ``<``. An unclosed ``<`` swallows the rest; a stray ``>`` goes.
    """
    text = F.replace(F.regexp_replace(F.replace(markup, F.lit(paragraph), F.lit("\n")), r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    lines = F.transform(F.split(text, r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: x != "")
    return F.concat_ws("", F.transform(kept, lambda x: F.concat(x, F.lit("\n"))))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded: by a whole component, or by a segment that ends at a separator or the end."""
    low = folded(path)
    components = [fold(p.strip()) for p in patterns if p.strip() and "/" not in p and "\\" not in p]
    segments = [fold(p.strip()).replace("\\", "/") for p in patterns if "/" in p or "\\" in p]
    out = F.lit(False)
    if components:
        parts = F.split(low, "/", -1)
        out = out | F.exists(parts, lambda x: x.isin(*components) & ~x.isin("", ".", ".."))
    alike = F.translate(low, "\\", "/")
    for s in segments:
        # A segment that ends in a separator needs another one, or the end, right after it.
        closing = F.concat(alike, F.lit("/"))
        out = out | (F.contains(closing, F.lit(s + "/")) if not s.endswith("/") else F.contains(alike, F.lit(s + "/")) | F.endswith(alike, F.lit(s)))
    return out
