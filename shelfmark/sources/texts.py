"""Texts of files on disk, a row for each range of bytes, so that a long file is read by several tasks.

A line belongs to the range in which it begins; the task of that range reads on to its end. So the rows of a file put together
are the file, and none begins or ends within a line. Paths must be visible to the executors. A file that cannot be read, or
shrinks meanwhile, has no rows there. Bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 8 * 1024 * 1024
SCHEMA = "entry_id bigint, part bigint, n_lines bigint, text string"


def lines_from(path: str, start: int, end: int, block: int = 1 << 20) -> bytes | None:
    """The bytes of the lines that begin at ``start`` or later and before ``end``; None if the file cannot be read."""
    try:
        with open(path, "rb") as f:
            if start:
                f.seek(start - 1)
                while True:  # on to the first line that begins here
                    piece = f.readline(block)
                    if not piece or piece.endswith(b"\n"):
                        break
                if f.tell() >= end:
                    return b""
            out = [f.read(max(0, end - f.tell()))]
            while out[-1] and not out[-1].endswith(b"\n"):
                out.append(f.readline(block))
            return b"".join(out)
    except OSError:
        return None


def file_texts(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(entry_id, part, n_lines, text) of ``files`` (entry_id, path, size); ``n_lines`` counts line feeds. Empty ranges have no row."""
    ranges = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / size), F.lit(0)).cast("long"))
    parts = files.where("size > 0").select("entry_id", "path", F.col("size").alias("__end"), F.explode(ranges).alias("part"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, path, whole, part in zip(*(batch.column(c).to_pylist() for c in ("entry_id", "path", "__end", "part")), strict=True):
                data = lines_from(path, part * size, min(whole, (part + 1) * size))
                if data:
                    row = [pa.array([entry], pa.int64()), pa.array([part], pa.int64()), pa.array([data.count(b"\n")], pa.int64()), pa.array([data.decode("utf-8", "replace")])]
                    yield pa.RecordBatch.from_arrays(row, ["entry_id", "part", "n_lines", "text"])

    return parts.repartition(n, "entry_id", "part").mapInArrow(read, SCHEMA)
