"""Rescans as differences, on random trees and on disk."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog as cat
from shelfmark.operators.changes import shown
from shelfmark.operators.rescan import changed_folders, differences, open_or_build, rescan_due
from shelfmark.sources.files import scan


def tree(spark, seed, keep=1.0):
    """A random tree; other seeds give other facts below the same names."""
    random.seed(1)
    folders = ["/r"]
    for k in range(30):
        folders.append(f"{random.choice(folders)}/d{k}")
    files = [f"{random.choice(folders)}/f{k}" for k in range(120)]
    random.seed(seed)
    gone = [f for f in folders[1:] if random.random() > keep]
    left = [p for p in folders + files if not any(p == g or p.startswith(g + "/") for g in gone) and (p in folders or random.random() < keep)]
    rows = [(k, None, p.rsplit("/", 1)[-1], p, p in folders, 0 if p in folders else random.choice([1, 1, 1, seed]), 0, False) for k, p in enumerate(left)]
    return spark.createDataFrame(rows, cat.SCHEMA)


def facts(df):
    return sorted(df.where("NOT is_deleted").select("path", "is_dir", "size", "modified").collect())


def test_differences_lead_to_the_scan(spark, tmp_path):
    trees = [tree(spark, 2, 0.9), tree(spark, 3, 0.8), tree(spark, 4), tree(spark, 3, 0.8)]
    for k, rows in enumerate(trees):
        log, how = open_or_build(spark, f"file://{tmp_path}/c", ["/r"], lambda rows=rows: rows, 1 + 50_000 * k)
        assert how == ("refreshed" if k else "built") and facts(log.read()) == facts(rows)
    assert facts(shown(log.merged())) == facts(trees[-1])
    again, how = open_or_build(spark, f"file://{tmp_path}/c", ["/r"], lambda: pytest.fail("not stale"), 150_002)
    assert how == "loaded" and again.state()["scanned_at"] == 150_001
    assert open_or_build(spark, f"file://{tmp_path}/c", ["/other"], lambda: trees[0], 150_003)[1] == "built"


def test_only_what_differs(spark):
    held = tree(spark, 2)
    assert differences(held, held, 1).count() == 0 and changed_folders(held, held).count() == 0
    one = held.withColumn("size", F.when(F.endswith("path", F.lit("/f7")), 99).otherwise(F.col("size")))
    assert changed_folders(held, one).count() == 1
    assert [(r["kind"], r["path"].rsplit("/", 1)[-1], r["size"]) for r in differences(held, one, 5).collect()] == [("modify", "f7", 99)]
    deep = [r["path"] for r in held.collect() if r["is_dir"] and r["path"].count("/") == 2][0]
    less = held.where((F.col("path") != deep) & ~F.startswith("path", F.lit(deep + "/")))
    assert [(r["kind"], r["path"]) for r in differences(held, less, 5).collect()] == [("remove", deep)]
    assert differences(held.limit(0), held, 1).where("kind = 'create'").count() == held.count()


def test_folders_on_disk(spark, tmp_path):
    top = tmp_path / "top"
    for k in range(5):
        (top / f"d{k}").mkdir(parents=True)
        (top / f"d{k}" / "f").write_text("x" * k)
    look = lambda: scan(spark, [str(top)])
    log, _ = open_or_build(spark, f"file://{tmp_path}/c", [str(top)], look, 10)
    ids = {r["path"]: r["entry_id"] for r in log.live().collect()}
    shutil.rmtree(top / "d1")
    (top / "d2" / "new").write_text("yes")
    log, how = open_or_build(spark, f"file://{tmp_path}/c", [str(top)], look, 10 + 13 * 3600)
    now = {r["path"]: r["entry_id"] for r in log.live().collect()}
    assert how == "refreshed" and facts(log.read()) == facts(look())
    assert all(now[p] == i for p, i in ids.items() if p in now) and f"{top}/d1/f" not in now


def test_daily_rescan():
    day = 86_400
    assert rescan_due("4:00", day + 4 * 3600, day) and rescan_due("04:00", day + 5 * 3600, day + 3600)
    assert not rescan_due("04:00", day + 5 * 3600, day + 4 * 3600) and not rescan_due("04:00", day + 3 * 3600, 5 * 3600)
    assert rescan_due("04:00", day + 3 * 3600, 3 * 3600)  # yesterday's was missed
    assert not rescan_due("25:00", 10 * day, 0) and not rescan_due("", 10 * day, 0)
    assert rescan_due("00:30", 1_700_000_000, 1_699_900_000, "Europe/Berlin")
