"""The first scan as a stream: batches, searches between them, restarts."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog as cat
from shelfmark.operators.search import search
from shelfmark.plans.parser import parse
from shelfmark.sources.files import scan
from shelfmark.streaming.scan import folder_scan, node_scan


def test_batches_of_nodes(spark, sf, tmp_path):
    nodes = cat.tree(spark, sf)
    walk, seen = node_scan(nodes, f"file://{tmp_path}/s", 300), []

    def look(progress):
        rows = walk.catalog()
        seen.append((progress["rows"], rows.count(), search(rows, parse("customer type:folder")).totals.first()["total"]))

    whole = walk.run(look)
    want = cat.resolve_paths(nodes).select("entry_id", "path").orderBy("entry_id").collect()
    assert whole.select("entry_id", "path").orderBy("entry_id").collect() == want
    assert len(seen) > 6 and all(a == b for a, b, _ in seen) and [s[2] for s in seen] == sorted(s[2] for s in seen)
    steps = [b[0] - a[0] for a, b in zip(seen, seen[1:], strict=False)]
    largest = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").count().agg(F.max("count")).first()[0]
    assert max(steps) <= 300 + largest
    done = walk.progress()
    assert sorted(done["completed"]) == sorted(done["roots"]) and len(done["roots"]) == 5


def test_few_batches(spark, sf, tmp_path):
    """Batches that find a few folders each make no units of their own, and growing ones are few; each finds what there is."""
    nodes = cat.tree(spark, sf)
    want, runs = nodes.count(), []
    for growing in (False, True):
        walk, seen = node_scan(nodes, f"file://{tmp_path}/{growing}", 150, growing), []
        whole = walk.run(lambda progress, seen=seen: seen.append(progress["rows"]))
        assert (whole.count(), whole.select("entry_id").distinct().count()) == (want, want)
        runs.append(seen)
    assert len(runs[0]) <= want / 150 + 4 and len(runs[1]) <= 12
    assert runs[1][-1] == want and runs[1][0] <= 30


def test_folders(spark, tmp_path):
    top = tmp_path / "top"
    for k in range(12):
        (top / f"d{k}" / "deep" / ".git").mkdir(parents=True)
        (top / f"d{k}" / "deep" / "f.txt").write_text("x" * k)
        (top / f"d{k}" / "deep" / ".git" / "no").write_text("x")
    (top / "link").symlink_to(top / "d0", target_is_directory=True)
    walk = folder_scan(spark, f"file://{tmp_path}/state", [str(top), str(tmp_path / "none")], [".git"], folders_each=2)
    assert walk.progress()["rows"] == 2 and walk.progress()["completed"] == []
    columns = ("path", "name", "is_dir", "size", "modified")
    whole = walk.run()
    assert sorted(whole.select(*columns).collect()) == sorted(scan(spark, [str(top), str(tmp_path / "none")], [".git"]).select(*columns).collect())
    rows = {r["entry_id"]: r for r in whole.collect()}
    assert sorted(rows) == list(range(len(rows)))
    assert all(r["parent_id"] is None or r["path"].rpartition("/")[0] == rows[r["parent_id"]]["path"] for r in rows.values())


def test_restart(spark, tmp_path):
    """A batch that fails before or after its commit is taken up again; nothing is lost or there twice."""
    nodes = spark.createDataFrame([(0, None, "/r", True), *((k, 0, f"d{k}", True) for k in range(1, 9)), *((100 + k, k % 8 + 1, f"f{k}", False) for k in range(40))], "entry_id bigint, parent_id bigint, name string, is_dir boolean")
    walk, calls = node_scan(nodes, f"file://{tmp_path}/s", 10), []

    def fail_after(progress):
        calls.append(progress["batch"])
        if len(calls) == 2:
            raise RuntimeError("lost after the commit")

    list_children = walk.children

    def fail_before(taken):
        if len(calls) == 3:
            calls.append(None)
            raise RuntimeError("lost before the commit")
        return list_children(taken)

    walk.children = fail_before
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            walk.run(fail_after)
    walk.start(spark.createDataFrame([], "entry_id bigint"))
    ids = [r["entry_id"] for r in walk.run(fail_after).collect()]
    assert sorted(ids) == sorted([0, *range(1, 9), *range(100, 140)])
    assert not any(walk.progress()["open"].values())
