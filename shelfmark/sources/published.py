"""Small files that are replaced at once: readers find the old one or the new one, never a part."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path as an object, its class) of a path that Spark reads."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = kind(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, kind


def publish(spark: SparkSession, path: str, value: dict) -> None:
    """Write ``value`` as JSON beside ``path`` and rename it over it."""
    fs, at, kind = _fs(spark, path)
    fresh = kind(f"{path}-{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, at, over)


def published(spark: SparkSession, path: str) -> dict | None:
    """The value last published at ``path``; None if there is none or it is no JSON object."""
    fs, at, _ = _fs(spark, path)
    if not fs.exists(at):
        return None
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the target must not exist."""
    fs, at, kind = _fs(spark, source)
    to = kind(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"cannot rename {source} to {target}")
