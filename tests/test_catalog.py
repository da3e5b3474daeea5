"""Hierarchy, snapshots, scans, changes and the stream."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog as cat
from shelfmark.operators import changes as ch
from shelfmark.operators.intervals import labelled, removed_at
from shelfmark.operators.log import ChangeLog
from shelfmark.operators.preview import preview_kind, text_head
from shelfmark.sources.files import scan
from shelfmark.streaming.feed import changes_stream, follow

NODES = "entry_id bigint, parent_id bigint, name string, is_dir boolean"


def test_corrupt_parents(spark):
    nodes = spark.createDataFrame([(1, None, "C:\\", True), (2, 1, "video.mp4", False), (3, 2, "thing.png", False), (4, 99, "lost", False), (5, 6, "a", True), (6, 5, "b", True)], NODES)
    got = {r["entry_id"]: r["path"] for r in cat.resolve_paths(nodes).collect()}
    circle = lambda last: "/".join((["b", "a"] * 129)[-257 - (last == "b") : None if last == "a" else -1])
    assert got == {1: "C:\\", 2: "C:\\video.mp4", 3: "thing.png", 4: "lost", 5: circle("a"), 6: circle("b")}


def test_reachable(spark):
    nodes = spark.createDataFrame([(1, None, "/r", True), (2, 1, "a", True), (3, 2, "f", False), (4, 99, "lost", True), (5, 4, "below", False), (6, 1, ".git", True), (7, 6, "x", False)], NODES)
    assert {r["path"] for r in cat.reachable(nodes, [".git"]).collect()} == {"/r", "/r/a", "/r/a/f"}


@pytest.mark.parametrize("depth", [40, 256, 257, 300])
def test_deep_chains(spark, depth):
    nodes = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}", True) for k in range(depth + 1)], NODES)
    last = cat.resolve_paths(nodes).where(F.col("entry_id") == depth).first()
    assert last["path"] == "/".join(f"n{k}" for k in range(max(0, depth - 256), depth + 1)) and last["hops"] == min(depth, 256)
    assert cat.reachable(nodes).count() == depth + 1


@pytest.mark.parametrize("most", [1, 3, cat.MOST])
def test_random_forests(spark, most):
    """Circles, lost parents, files as parents, files at the top, folders with many files; keys dealt to several tasks or not."""
    rng = random.Random(most)
    rows = [(k, rng.choice([None, 777, 0, 1, *range(60)]), f"n{k}", rng.random() < 0.7) for k in range(60)]
    rows += [(100 + k, rng.choice([0, 0, 0, None, k % 60]), f"f{k}", False) for k in range(200)]
    held = {r[0]: r for r in rows}

    def walked(k):
        names, at = [held[k][2]], k
        while len(names) < 5 and held[at][1] in held and held[held[at][1]][3]:
            at = held[at][1]
            names.insert(0, held[at][2])
        return "/".join(names), len(names) - 1, at

    got = cat.resolve_paths(spark.createDataFrame(rows, NODES), 4, most)
    assert got.columns == ["entry_id", "parent_id", "name", "is_dir", "path", "hops", "root_id"]
    assert sorted(got.collect()) == sorted((*held[k], *walked(k)) for k in held)


def test_rows_without_parent_are_spread(spark):
    """Rows without a key, and rows of one key, are joined in all tasks alike."""
    rows = spark.range(4_000).selectExpr("id AS entry_id", "IF(id % 2 = 0, NULL, IF(id % 8 = 1, id, 5)) AS key")
    other = spark.createDataFrame([(5, "five"), (9, "nine")], "key bigint, value string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cat.joined_evenly(rows, other, "key", "entry_id", 50).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["entry_id"]: r["value"] for r in got} == {k: None if k % 2 == 0 else {9: "nine"}.get(k) if k % 8 == 1 else "five" for k in range(4_000)} and len(got) == 4_000
    for value, share in ((None, 0.4), ("five", 0.6)):
        tasks = [r["task"] for r in got if r["value"] == value]
        assert len(set(tasks)) == 4 and max(map(tasks.count, set(tasks))) < share * len(tasks)


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert cat.load_snapshot(spark, folder) is None
    rows = spark.createDataFrame([(1, None, "a\ufffd", "/a\ufffd", False, 1, 2, False)], cat.SCHEMA)
    cat.save_snapshot(rows, folder, ["/x"], 42)
    cat.save_snapshot(rows, folder, ["/y"], 43)
    held, roots, at = cat.load_snapshot(spark, folder)
    assert (held.first()["name"], roots, at) == ("a\ufffd", ["/y"], 43)
    assert cat.is_stale(0, ["/y"], ["/y"], 9) and cat.is_stale(43, ["/y"], ["/z"], 44) and not cat.is_stale(43, ["/y"], ["/y"], 44)
    with open(tmp_path / "s" / "POINTER", "w") as f:
        f.write('{"version": 1, "snapshot": "x", "roots": [], "scanned_at": 1}')
    for crc in tmp_path.glob("s/.POINTER.crc"):
        os.remove(crc)
    assert cat.load_snapshot(spark, folder) is None


def test_scan(spark, tmp_path):
    (tmp_path / "nested" / ".git").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "nested" / "b.txt").write_text("x")
    (tmp_path / "nested" / ".hidden").write_text("x")
    (tmp_path / "nested" / ".git" / "c").write_text("x")
    got = {r["path"]: r for r in scan(spark, [str(tmp_path)], [".git"]).collect()}
    root = str(tmp_path)
    assert set(got) == {root, f"{root}/a.txt", f"{root}/nested", f"{root}/nested/b.txt", f"{root}/nested/.hidden"}
    assert got[f"{root}/a.txt"]["size"] == 5 and got[root]["parent_id"] is None
    assert got[f"{root}/nested/b.txt"]["parent_id"] == got[f"{root}/nested"]["entry_id"]
    assert sorted(r["entry_id"] for r in got.values()) == list(range(5))


def event(seq, kind, path, exists=True, is_dir=False):
    return (seq, kind, path, exists, is_dir, 0 if is_dir else seq, seq)


def base(spark):
    rows = [(0, None, "r", "/r", True, 0, 0, False), (1, 0, "a.txt", "/r/a.txt", False, 1, 1, False)]
    return spark.createDataFrame(rows, cat.SCHEMA)


def merged(spark, *events):
    out = ch.merge(base(spark), spark.createDataFrame(list(events), ch.SCHEMA))
    return {r["path"]: r for r in out.collect()}


def alive(rows):
    return {p for p, r in rows.items() if not r["is_deleted"]}


def test_changes(spark):
    assert alive(merged(spark, event(1, "create", "/r/b.txt"))) == {"/r", "/r/a.txt", "/r/b.txt"}
    assert alive(merged(spark, event(1, "create", "/r/b.txt"), event(2, "remove", "/r/b.txt", False))) == {"/r", "/r/a.txt"}
    assert alive(merged(spark, event(1, "create", "/unknown/b.txt"))) == {"/r", "/r/a.txt"}
    assert alive(merged(spark, event(1, "access", "/r/b.txt"))) == {"/r", "/r/a.txt"}
    assert alive(merged(spark, event(1, "modify", "/r/a.txt", False))) == {"/r"}
    assert alive(merged(spark, event(1, "remove", "/r", False))) == set()
    again = merged(spark, event(1, "remove", "/r", False), event(2, "create", "/r", True, True), event(3, "create", "/r/new"))
    assert alive(again) == {"/r", "/r/new"}
    fresh = merged(spark, event(1, "create", "/r/z"), event(2, "create", "/r/y"))
    assert (fresh["/r/y"]["entry_id"], fresh["/r/z"]["entry_id"]) == (2, 3)


def test_late_events_and_kinds(spark):
    step = lambda held, *events: ch.merge(held, spark.createDataFrame(list(events), ch.SCHEMA))
    one = step(base(spark), event(9, "modify", "/r/a.txt"))
    again = {r["path"]: r for r in step(one, event(5, "modify", "/r/a.txt")).collect()}
    assert (again["/r/a.txt"]["size"], again["/r/a.txt"]["seq"]) == (9, 9)
    assert alive({r["path"]: r for r in step(one, event(8, "remove", "/r/a.txt", False)).collect()}) == {"/r", "/r/a.txt"}
    gone = step(one, event(12, "remove", "/r", False))
    assert alive({r["path"]: r for r in step(gone, event(11, "create", "/r/late.txt")).collect()}) == set()
    turned = {r["path"]: r for r in step(one, event(10, "create", "/r/a.txt", True, True)).collect()}["/r/a.txt"]
    assert (turned["is_dir"], turned["size"], turned["entry_id"]) == (True, 0, 1)
    back = {r["path"]: r for r in step(step(one, event(10, "create", "/r/a.txt", True, True)), event(11, "create", "/r/a.txt")).collect()}["/r/a.txt"]
    assert (back["is_dir"], back["size"], back["entry_id"]) == (False, 11, 1)


def test_replay_equals_sequential_fold(spark):
    random.seed(3)
    paths = [f"/r/d{i}" for i in range(3)] + [f"/r/d{i}/f{j}" for i in range(3) for j in range(3)]
    events, live = [], {"/r", "/r/a.txt"}
    for seq in range(1, 80):
        p = random.choice(paths)
        is_dir = p.count("/") == 2
        if random.random() < 0.6:
            if p.rpartition("/")[0] not in live:
                continue
            events.append(event(seq, "create", p, True, is_dir))
            live.add(p)
        else:
            events.append(event(seq, "remove", p, False))
            live = {q for q in live if q != p and not q.startswith(p + "/")}
    assert alive(merged(spark, *events)) == live


def test_stream_equals_batch(spark, tmp_path):
    changes = spark.createDataFrame([event(k, "create" if k % 3 else "remove", f"/r/f{k % 5}", bool(k % 3)) for k in range(1, 30)], ch.SCHEMA)
    log, seen = ChangeLog(spark, f"file://{tmp_path}/c"), []
    log.start(base(spark), ["/r"], 1)
    for k in range(3):
        changes.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow(changes_stream(spark, f"{tmp_path}/in", 1), log, f"{tmp_path}/state", on_commit=seen.append, once=True, compact_every=2).awaitTermination()
    want = ch.shown(ch.merge(base(spark), changes)).select(*cat.COLUMNS[3:]).orderBy("path").collect()
    assert seen == [0, 1, 2] and list(log.state()["batches"]) == ["2"]  # two batches are in the base
    assert log.read().select(*cat.COLUMNS[3:]).orderBy("path").collect() == want


def test_any_split_of_the_feed(spark, tmp_path):
    """Folders that come and go, unknown paths, late and repeated events: any split and order of batches gives the same rows."""
    random.seed(11)
    folders = ["/r", "/r/a", "/r/a/b", "/r/c", "/x"]
    paths = folders[1:] + [f"{f}/f{k}" for f in folders for k in range(2)]
    events = [event(s, *random.choice([("create", p := random.choice(paths), True, p in folders), ("modify", p, True, random.random() < 0.1), ("remove", p, False), ("access", p)])) for s in range(1, 120)]
    columns = [c for c in cat.COLUMNS if c != "entry_id"] + ["seq"]
    rows = lambda df: sorted(map(str, ch.shown(df).select(*columns).collect()))
    want = rows(ch.merge(base(spark), spark.createDataFrame(events, ch.SCHEMA)))
    for trial in range(3):
        given = random.sample(events, len(events)) + random.choices(events, k=20)
        cut = sorted(random.sample(range(1, len(given)), 3))
        parts = [given[a:b] for a, b in zip([0, *cut], [*cut, len(given)], strict=True)]
        held = base(spark)
        for part in parts:
            held = cat.checkpointed(ch.merge(held, spark.createDataFrame(part, ch.SCHEMA)))
        assert rows(held) == want
        log = ChangeLog(spark, f"file://{tmp_path}/{trial}")
        log.start(base(spark), ["/r"], 1)
        for k, part in enumerate(parts):
            log.append(spark.createDataFrame(part, ch.SCHEMA))
            if k == trial:
                log.compact()
        assert rows(log.merged()) == want


def test_batch_writes_what_it_names(spark, tmp_path):
    """A batch of two paths is two rows, however large the catalog and its subtree are."""
    many = spark.range(5_000).select(F.col("id").alias("entry_id"), F.lit(None).cast("long").alias("parent_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("modified"), F.lit(False).alias("is_deleted"))
    log = ChangeLog(spark, f"file://{tmp_path}/c")
    log.start(many, ["/r"], 1)
    log.append(spark.createDataFrame([event(1, "remove", "/r", False), event(2, "create", "/r/f7"), event(3, "modify", "/r/f7")], ch.SCHEMA))
    assert log.facts().count() == 2
    assert [r["path"] for r in log.live().collect()] == ["/r/f7"]  # all others went with the folder


def test_labels_and_removals(spark):
    """Labels against counting prefixes; a sweep over many ranges against trying every folder."""
    random.seed(4)
    paths = {"/"}
    while len(paths) < 300:
        at = random.choice(sorted(paths))
        paths.add(f"{at.rstrip('/')}/{random.choice(['a', 'a b', 'a.b', 'b', 'é', 'a0'])}{random.choice(['', '1'])}")
    rows = [(k, None, p.rsplit("/", 1)[-1], p, True, 0, 0, False) for k, p in enumerate(sorted(paths, key=lambda _: random.random()))]
    below = lambda p, f: p == f or p.startswith(f.rstrip("/") + "/")
    labels = {r["path"]: (r["pre"], r["last"]) for r in labelled(spark.createDataFrame(rows, cat.SCHEMA)).collect()}
    assert sorted(v[0] for v in labels.values()) == list(range(300))
    for f in random.sample(sorted(paths), 40):
        assert {p for p in paths if below(p, f)} == {p for p, (pre, _) in labels.items() if labels[f][0] <= pre <= labels[f][1]}
    gone = [(p, k) for k, p in enumerate(random.sample(sorted(paths), 60))] + [("/nowhere", 99)]
    want = {p: max(k for f, k in gone if below(p, f)) for p in paths if any(below(p, f) for f, _ in gone)}
    for few in (3, 100):
        got = removed_at(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(gone, "path string, seq bigint"), few)
        assert {r["path"]: r["removed_at"] for r in got.collect()} == want


def test_metadata_fill(spark):
    rows = spark.createDataFrame([(0, None, "d", "/d", True, 0, 0, False), (1, 0, "f", "/d/f", False, 0, 0, False), (2, 0, "g", "/d/g", False, 3, 9, False)], cat.SCHEMA)
    facts = spark.createDataFrame([(k, 7, 8) for k in range(3)], "entry_id bigint, size bigint, modified bigint")
    got = {r["entry_id"]: (r["size"], r["modified"]) for r in cat.fill_metadata(rows, facts).collect()}
    assert got == {0: (0, 8), 1: (7, 8), 2: (3, 9)}


def test_previews(spark):
    df = spark.createDataFrame([("a.png", False, 1), ("a.png", False, 31 << 20), ("x", True, 0), ("a.mp3", False, 1), ("a.pdf", False, 9 << 20), ("a.docx", False, 1), ("Makefile", False, 1)], "n string, d boolean, s bigint")
    assert [r[0] for r in df.select(preview_kind(F.col("n"), F.col("d"), F.col("s"))).collect()] == ["image", "info", "folder", "media", "info", "document", "text"]
    heads = spark.createDataFrame([(b"abc",), (b"a\0c",), (b"x" * 131073,), (b"\xff!",)], "b binary").select(text_head(F.col("b")).alias("h")).collect()
    assert heads[0]["h"]["text"] == "abc" and heads[1]["h"] is None and heads[2]["h"]["truncated"] and len(heads[2]["h"]["text"]) == 131072
    assert heads[3]["h"]["text"] == "\ufffd!"


def test_ranges_stay_apart(spark):
    """Labels and new ids are counted where the sorted ranges lie: no task gets several of them by the hash of their number."""
    rows = spark.range(3_000).selectExpr("id AS entry_id", "concat('/r/d', id % 7, '/f', lpad(id, 5, '0')) AS path")
    fresh = rows.withColumn("entry_id", F.when(F.col("entry_id") < 0, 0).cast("long"))
    for made in (labelled(rows), ch.with_new_ids(fresh)):
        assert not re.search(r"windowspecdefinition\(__p#\d+, ", made._jdf.queryExecution().executedPlan().toString())
    order = sorted(r["path"] for r in rows.collect())
    assert {r["path"]: (r["pre"], r["last"]) for r in labelled(rows).collect()} == {p: (k, k) for k, p in enumerate(order)}
    assert {r["path"]: r["entry_id"] for r in ch.with_new_ids(fresh).collect()} == {p: k for k, p in enumerate(order)}
