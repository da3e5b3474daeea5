"""The name index against plain searches, and what it reads."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import names
from shelfmark.operators.search import matches
from shelfmark.plans.parser import parse
from shelfmark.plans.settings import default_exclusions
from shelfmark.plans.spec import MatchMode
from tests.test_search import catalog


def test_lists():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, rng.integers(1, names.RANGE), rng.integers(0, 400))) for _ in range(rng.integers(1, 4))]
        assert all((names.unpacked(names.packed(x)) == x).all() for x in lists)
        assert set(names.intersected(lists)) == set.intersection(*(set(x.tolist()) for x in lists))
    assert names.unpacked(names.packed(np.array([0, 1, names.RANGE - 1]))).tolist() == [0, 1, names.RANGE - 1]


def test_indexed_search(spark, tmp_path):
    random.seed(3)
    words = ["report", "REPORT", "old", "été", "日本語名", "a", "re", "port", "x.y"]
    made = catalog(spark, *((f"/r/{' '.join(random.choices(words, k=random.randint(1, 4)))}{k}.txt", k % 11 == 0, k, 0, k % 13 == 0) for k in range(400)))
    rows = made.withColumn("entry_id", F.col("entry_id") * 997)  # several ranges
    index = names.NameIndex(spark, f"file://{tmp_path}/n")
    index.add(rows)
    later = rows.where("entry_id % 5 = 0").withColumn("name", F.concat(F.lit("new "), "name")).withColumn("is_deleted", F.col("entry_id") % 2 == 0)
    index.add(later)
    now = rows.join(later, "entry_id", "left_anti").select(*rows.columns).union(later)
    plain = lambda df: sorted((r["entry_id"], r["score"], r["name"]) for r in df.collect())
    for text, mode, case in (("report", None, False), ("report", None, True), ("port re type:file", None, False), ("new old size:>100", None, False), ("日本語", None, False), ("re", None, False), ("zzz", None, False), ("", None, False), ("rpt", MatchMode.FUZZY, False)):
        spec = parse(text, mode or MatchMode.SUBSTRING, case)
        assert plain(index.matches(spec)) == plain(matches(now, spec)), text


def test_reads_a_part(spark, tmp_path):
    """The postings of a term are in few row groups; the others are not read."""
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(60_000).select((F.col("id") * 3).alias("entry_id"), F.lit(None).cast("long").alias("parent_id"), F.concat(F.hex(F.xxhash64("id")), F.hex(F.xxhash64("id", F.lit(1)))).alias("name"), F.lit("/x").alias("path"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified"), F.lit(False).alias("is_deleted"))
    index = names.NameIndex(spark, f"file://{tmp_path}/n")
    index.add(rows)
    groups = [(g.column(0).statistics.min, g.column(0).statistics.max) for f in glob.glob(f"{tmp_path}/n/part-*/postings/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
    wanted = names.trigrams("ABC")
    assert sum(any(low <= t <= high for t in wanted) for low, high in groups) <= len(groups) / 3
    found = index.candidates(("ABC",))
    assert "trigram" in str(found._jdf.queryExecution().executedPlan()).split("PushedFilters")[1][:80]
    assert found.count() == rows.where(F.contains("name", F.lit("ABC"))).count()


def test_exclusions_by_system():
    assert "/proc" in default_exclusions("posix") and "\\Windows\\WinSxS" in default_exclusions("nt") and "/proc" not in default_exclusions("nt")
