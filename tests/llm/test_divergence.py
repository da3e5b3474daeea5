"""Source divergence: whole tables against plain Python and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from shelfmark.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, min_docs=3, ranks=200):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= min_docs]
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if held[t] >= min_docs)
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        whole = sum(count.values(), Counter())
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in count:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in count if o != s]
            terms = [(-f(share[s][t], q[t]), t.encode()) for t in kept if count[s][t] and share[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def collected(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def made(n=150, sources=12, seed=2):
    random.seed(seed)
    words = ["the", "THE", "été", "Straße", "日本", "x1y", "a_b", "q", "zz", "_", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    rows = [(k, " ".join(random.choices(words, [1 / (i + 1) for i in range(len(words))], k=random.randint(0, 60))), random.choice(["en", "de", None]), f"s{int(random.random() ** 2 * sources)}", 0) for k in range(n)]
    return rows + [(900, None, None, None, None), (901, "", "fr", "", 0), (902, "seul", "fr", "s1", 0), (903, "the\0the\x7fthe" * 3000, "en", "s1", 0), rows[0], rows[0]]


def test_whole_table(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(dv.audit(df)) == brute(rows)
    assert collected(dv.audit(df, 1, 3)) == brute(rows, 1, 3)


def test_many_sources_in_tiles(spark, monkeypatch):
    """Several blocks of sources, small batches: the same rows."""
    monkeypatch.setattr(dv, "BLOCK", 4)
    monkeypatch.setattr(dv, "SPREAD", 3)
    rows = made(200, 30, 3)
    assert collected(dv.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_task_side(monkeypatch):
    """Tables that are full are emitted; sums do not depend on where batches end."""
    import pyarrow as pa

    monkeypatch.setattr(dv, "HELD", 10)
    text = [b"a b c d e f g", b"a a b", "é É".encode(), b""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["x", "x", "y", "z"]), pa.array(text)], ["lang", "source", "text"])
    found = Counter()
    for out in dv._counted(iter([batch] * 5)):
        for r in out.to_pylist():
            found[r["source"], r["term"].decode()] += r["n"]
    assert found["x", "a"] == 15 and len([k for k in found if k[0] == "z"]) == 0 and found["x", "g"] == 5 and found["y", "é"] == 5 and found["y", "É"] == 5


def test_no_documents(spark, none, odd):
    assert dv.audit(none).count() == 0
    assert collected(dv.audit(odd)) == brute([tuple(r) for r in odd.collect()])


@pytest.mark.parametrize("name", ["op13_divergence"])
def test_query(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(dv.ORACLE_SQL[name]).fetchall()
    assert sorted(want) == collected(dv.QUERIES[name](spark, sf))
