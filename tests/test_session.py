"""Coalescing, cancellation, accepted responses, figures in one pass."""

import threading
import time

from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from shelfmark.operators.search import matches, search
from shelfmark.operators.session import SearchSession, one_pass
from shelfmark.plans.parser import parse
from tests.test_search import catalog


def test_newest_search_wins(spark, tmp_path):
    """Ten requests while a slow one runs: it is interrupted, the last alone is answered, the others never start."""
    names = [f"/r/report{k}.txt" for k in range(200)] + [f"/r/note{k}.txt" for k in range(40)]
    rows = catalog(spark, *((n, False, 1) for n in names))

    @udf("boolean")
    def slow(n):
        with open(f"{tmp_path}/started", "a") as f:
            f.write("x")
        time.sleep(0.2)
        return True

    got, errors = [], []
    session = SearchSession(spark, got.append, lambda g, e: errors.append((g, str(e)[:300])))
    first = session.submit(catalog=rows.repartition(120).where(slow("name")), spec=parse("report"))
    limit = time.time() + 60
    while not (tmp_path / "started").exists() and time.time() < limit:
        time.sleep(0.05)
    began = time.time()
    last = [session.submit(catalog=rows, spec=parse("note"), k=10 + k) for k in range(10)][-1]
    answer = session.wait(60)
    assert not errors, errors
    assert time.time() - began < 8  # the slow search alone takes more than ten seconds
    assert (first, last, answer.generation, answer.total, answer.truncated, len(answer.rows)) == (1, 11, 11, 40, True, 19)
    assert [r.generation for r in got] == [11] and errors == []
    assert answer.status.startswith("19 of 40 shown in ") and answer.elapsed > 0
    session.submit(catalog=rows, spec=parse("(", ), k=5)
    assert session.wait(60).total == 0
    session.submit(catalog=rows, spec=parse("x content:y"))
    session.wait(60)
    assert [g for g, _ in errors] == [13]  # a failure of the newest search is told
    session.close()
    assert not any(t.name == f"search-{session.name}" for t in threading.enumerate())
    busy = spark.sparkContext.statusTracker()
    assert not busy.getActiveJobsIds()


def test_same_as_search(spark):
    rows = catalog(spark, *((f"/r/d{k % 3}/f{k}.txt", k % 10 == 0, k) for k in range(100)))
    session = SearchSession(spark)
    for text in ("", "f1", "type:folder", "path:d2 f"):
        session.submit(catalog=rows, spec=parse(text), k=7)
        answer, want = session.wait(60), search(rows, parse(text), k=7)
        assert answer.rows == want.hits.collect() and (answer.total, answer.truncated) == tuple(want.totals.first())
    session.close()


def test_one_scan(spark, tmp_path):
    catalog(spark, *((f"/f{k}.txt", False, k) for k in range(50))).write.parquet(f"{tmp_path}/c")
    rows, seen = one_pass(matches(spark.read.parquet(f"{tmp_path}/c"), parse("f1")), 3)
    assert [r["name"] for r in rows.select("name").collect()] == ["f1.txt", "f10.txt", "f11.txt"] and seen.get["total"] == 11
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    assert rows.select(F.count("*")).first()[0] == 3
