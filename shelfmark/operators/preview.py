"""Previews: what kind a row shows, and its text head or description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalars as x

IMAGE_MAX = 30 * 1024 * 1024
DOCUMENT_MAX = 8 * 1024 * 1024
TEXT_BYTES = 128 * 1024
NUL_WINDOW = 4096


def preview_kind(name: Column, is_dir: Column, size: Column) -> Column:
    """folder, image, media, document, text or info: the first that applies."""
    return (
        F.when(is_dir, "folder")
        .when(x.is_image(name) & (size <= IMAGE_MAX), "image")
        .when(x.is_media(name), "media")
        .when(x.is_document(name) & (size <= DOCUMENT_MAX), "document")
        .when(x.is_texty(name), "text")
        .otherwise("info")
    )


def text_head(data: Column) -> Column:
    """Struct (text, truncated) of the first bytes of a file; null if they look binary. Broken characters are replaced."""
    head = F.substring(data, 1, TEXT_BYTES)
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring(data, 1, NUL_WINDOW)), "(..)", "$1 ")) > 0
    shown = F.coalesce(F.try_validate_utf8(head.cast("string")), F.make_valid_utf8(head.cast("string")))
    return F.when(~binary, F.struct(shown.alias("text"), (F.octet_length(data) > TEXT_BYTES).alias("truncated")))


def describe(path: Column, is_dir: Column, size: Column, modified: Column) -> Column:
    """The description of a row that has no preview of its own."""
    folder = F.concat(F.lit("Folder\n\n"), path, F.lit("\nModified: "), x.human_date(modified))
    file = F.concat(path, F.lit("\n\nSize: "), x.human_size(size), F.lit("\nModified: "), x.human_date(modified), F.lit("\n\nNo preview available for this file type."))
    return F.when(is_dir, folder).otherwise(file)


def previews(hits: DataFrame) -> DataFrame:
    """``hits`` with ``kind`` and ``info``."""
    c = F.col
    return hits.withColumn("kind", preview_kind(c("name"), c("is_dir"), c("size"))).withColumn("info", describe(c("path"), c("is_dir"), c("size"), c("modified")))
