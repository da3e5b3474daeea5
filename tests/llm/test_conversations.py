"""Conversation repair: signatures against shortest paths, whole tables against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_solve(letters):
    """The cheapest (cost, audit) by trying edits in the order of cost and audit; prefixes of legal roles only."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        state = (at, roles[-1:] or "-")
        if at == len(letters) and LEGAL.fullmatch(roles):
            return cost, audit
        if (state, cost, audit) in seen or len(audit) > 2 * len(letters) + 4:
            continue
        seen.add((state, cost, audit))
        may = lambda r: re.fullmatch(r"s?(ua)*u?", roles + r)
        for r in "ua":
            if may(r):
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + r))
        if at < len(letters):
            x = letters[at]
            more = x.isupper()
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles))
            if x != "x":
                if may(x.lower()):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + x.lower()))
                for r in "ua":
                    if may(r):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + r))
    raise AssertionError(letters)


def test_solutions():
    random.seed(5)
    for n in range(7):
        for _ in range(60):
            letters = "".join(random.choice("suaoSUAOxuaua") for _ in range(n))
            assert cv.solve(letters) == brute_solve(letters), letters
    long = "ua" * 40_000 + "x"
    assert cv.solve(long) == (3, "K" * 80_000 + "D")


def brute_audit(rows, damage=True):
    """What the query returns, by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if f == 0:
                continue
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            role = "user" if f == 4 else role
            held += [(turn, role, text)] * (2 if f == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in held:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cv.solve(letters)
        initials = [r[1][:1] or " " for r in held]
        turns = [r[0] for r in held if r[0] is not None]
        lines, left = [], iter(held)
        for k, edit in enumerate(audit):
            row = next(left) if edit != "I" else None
            after = sum(e != "D" for e in audit[k + 1 :])
            if edit != "D":
                lines.append((row[1] if edit == "K" else "assistant" if after % 2 == 0 else "user") + ":" + (row[2] if row else ""))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_damaged_conversations(spark):
    random.seed(6)
    texts = ["Hello.", "yes", "  ", "", "What?\n", "A longer answer!", None, "日本語。", "no end \x1c"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    rows = [(c, t, random.choice(roles), random.choice(texts)) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (100, None, "system", "Be kind."), (100, None, "user", "x.")]
    rows += [(101, t % 7, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3_000)] + rows[:9]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("signature", F.lit("x"))
    got = cv.audited(df.repartition(5)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == brute_audit(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (2, 0, "user", ""), (3, 0, "assistant", "Yes.")]
    repaired, audits = cv.repair(cv.rows_of(spark.createDataFrame(rows, SCHEMA)))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (2, "KKR"), 2: (3, "D"), 3: (2, "IK")}
    got = sorted((r["conv_id"], r["position"], r["role"], r["text"], r["edit"]) for r in repaired.collect())
    assert got == [(1, 1, "system", "Be kind.", "K"), (1, 2, "user", "Hi.", "K"), (1, 3, "assistant", "Hello?", "R"), (3, 1, "user", "", "I"), (3, 2, "assistant", "Yes.", "K")]


def test_no_conversations(spark):
    assert cv.audited(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, sf, size):
    import duckdb

    con, sf = duckdb.connect(), sf.replace("sf0.001", size)
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(cv.ORACLE_SQL["op12_conversations"]).fetchall()
    got = cv.op12_conversations(spark, sf).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == brute_audit(rows)
