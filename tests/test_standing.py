"""Standing queries: after each batch the same as a full search."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import changes as ch
from shelfmark.operators.log import ChangeLog
from shelfmark.operators.search import matches
from shelfmark.plans.parser import parse
from shelfmark.streaming.feed import changes_stream
from shelfmark.streaming.standing import SHOWN, answer, standing
from tests.test_catalog import base, event


def test_equal_to_search_after_each_batch(spark, tmp_path):
    random.seed(9)
    spec = parse("re type:file size:<90")
    folders = ["/r/a", "/r/a/b", "/r/c"]
    paths = [f"{f}/{n}{k}.txt" for f in folders for n in ("re", "report", "x", "some re") for k in range(3)]
    first = [event(k, "create", p, True, True) for k, p in enumerate(["/r", *folders], 1)]
    events = [event(s, *random.choice([("create", p := random.choice(paths)), ("modify", p), ("remove", p, False), ("create", p, True, random.random() < 0.1)])) for s in range(10, 150)]
    events += [event(s, "remove", random.choice(folders), False) for s in (60, 100)]
    back = [event(200 + k, "create", p, True, True) for k, p in enumerate(folders)]
    random.shuffle(events)
    batches = [first, events[:40], events[40:80] + events[:5], events[80:] + back]
    log, k, seen = ChangeLog(spark, f"file://{tmp_path}/log"), 4, []
    log.start(base(spark), ["/r"], 0)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, ch.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def look(number, n=n):
            hits, totals = answer(spark, f"{tmp_path}/out", k)
            seen.append((n, [tuple(r) for r in hits.collect()], tuple(totals.first())))

        standing(changes_stream(spark, f"{tmp_path}/in"), spec, f"{tmp_path}/out", f"{tmp_path}/state", k, slack=1, buckets=3, on_commit=look, once=True).awaitTermination()
        log.append(spark.createDataFrame(batch, ch.SCHEMA))
        found = matches(log.live(), spec)
        want = [tuple(r) for r in found.orderBy(F.desc("score"), "path").limit(k).select(*SHOWN).collect()]
        total = found.count()
        assert seen[-1] == (n, want, (total, total > k))
    assert len({str(s[1]) for s in seen}) == 4
