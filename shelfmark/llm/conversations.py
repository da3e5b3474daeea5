"""Conversation structure repair by signature deduplication.

A conversation's rows, in the order of their turns, become a compact string, one letter a row: the initial of its role (s, u,
a; o for any other), upper case if its text is truncated, x if it is blank or a duplicate and must go. Each distinct
signature is solved once: the cheapest edits after which the initials of the roles match ``(s?(ua)+)?``. The audits are
joined back to the conversations and replayed on their rows.

Edits, by initial, and their costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty row of user or assistant
2; a truncated row that stays adds 1. Of equally cheap audits the least in ASCII order is taken. A signature is solved by
memoised recursion over its halves: the best audit from each state to each state (nothing yet, after s, after u, after a) is
the best concatenation of one for either half. No audit of one cost between two states is the beginning of another, so the
least parts make the least whole; the recursion is as deep as the logarithm of the length.

Scale: rows travel twice, once without their texts (for the signatures) and once with them (for the replay). Both passes
stream sorted rows: a conversation of any length costs a task its signature and audit, a letter a row, never its texts.
Conversations with a common signature meet the solution in salted groups.

Defined results: null roles and texts are one space, a null turn sorts first, a null ``conv_id`` is a conversation like any
other. Rows of one turn are in the order of role and MD5 of the text. An empty role has an initial of its own that fits
nowhere. A conversation without rows (all dropped) has an empty audit and no repaired rows; an empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. Where an initial leads from each; -1 is nowhere.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The role that may follow in a state, s aside.
WANTED = ("u", "u", "a", "u")
FINAL = (0, 3)
SALTS = 8
#: Signatures up to this length are remembered within a task.
REMEMBERED = 64

Plan = dict[tuple[int, int], tuple[int, str]]  # (from state, to state): cost, audit


def _better(plan: Plan, key: tuple[int, int], cost: int, audit: str) -> None:
    if key not in plan or (cost, audit) < plan[key]:
        plan[key] = cost, audit


def _then(one: Plan, two: Plan) -> Plan:
    out: Plan = {}
    for (a, m), (cost, audit) in one.items():
        for (n, b), (more, rest) in two.items():
            if m == n:
                _better(out, (a, b), cost + more, audit + rest)
    return out


def _inserts() -> Plan:
    """Up to two inserts: a third would lead back."""
    plan: Plan = {(s, s): (0, "") for s in range(4)}
    for s in range(4):
        at, cost, audit = s, 0, ""
        for _ in range(2):
            at, cost, audit = NEXT[WANTED[at]][at], cost + INSERT, audit + "I"
            _better(plan, (s, at), cost, audit)
    return plan


INSERTS = _inserts()


@lru_cache(maxsize=64)
def _row(letter: str) -> Plan:
    """Inserts, then the edit of one row."""
    edits: Plan = {}
    role, extra = letter.lower(), TRUNCATED * letter.isupper()
    for s in range(4):
        _better(edits, (s, s), DELETE, "D")
        if letter != "x":
            if NEXT.get(role, (-1,) * 4)[s] >= 0:
                _better(edits, (s, NEXT[role][s]), KEEP + extra, "K")
            _better(edits, (s, NEXT[WANTED[s]][s]), REROLE + extra, "R")
    return _then(INSERTS, edits)


def _plan(signature: str) -> Plan:
    if len(signature) == 1:
        return _row(signature)
    half = len(signature) // 2
    solve = _remembered if len(signature) <= 2 * REMEMBERED else _plan
    return _then(solve(signature[:half]), solve(signature[half:]))


_remembered = lru_cache(maxsize=20_000)(_plan)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a signature."""
    whole = _then(_plan(signature), INSERTS) if signature else INSERTS
    return min(whole[0, s] for s in FINAL if (0, s) in whole)


# Rows ----------------------------------------------------------------------------------------------------------------


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows_of`` with faults: crc32 of ``conv_id:turn`` modulo 20 is 0: a dropped row, 1: an emptied text, 2: a text without
    its full stops, exclamation and question marks, 3: the row twice, 4: the role user. A dropped row keeps its place as one
    without ``role``, so that its conversation is not lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("fault")
    given = rows.select("*", fault)
    f = F.col("fault")
    changed = F.when(f == 1, "").when(f == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(f == 4, "user").when(f != 0, F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(f == 3, 2).otherwise(1))
    return given.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows with the MD5 of their texts, and the order within a conversation."""
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary"))), [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc("digest")]


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, signature, and the longs gaps, blank, duplicate, truncated, illegal."""
    given, order = _ordered(rows)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    light = given.select(
        "conv_id", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.coalesce(F.nullif(F.left("role", F.lit(1)), F.lit("")), F.lit(" ")).alias("initial")
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("role").isNull(), "").when(F.col("blank"), "x").when(F.col("seen") > 1, "y").when(F.col("truncated"), F.upper(role)).otherwise(role)
    marked = light.repartition("conv_id").withColumn("seen", seen).select("conv_id", "turn", "role", "digest", "seen", "initial", letter.alias("letter"))
    shape = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    # Of rows that are alike in all else the first is the one that is no duplicate.
    return marked.sortWithinPartitions("conv_id", *order, "seen").select("conv_id", "turn", "initial", "letter").mapInArrow(_signatures, shape)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, streamed; a blank row is x, a duplicate one y until it is counted."""
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5]

    def record(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    def close() -> tuple:
        s = "".join(letters)
        upper = sum(map(s.count, "SUAO"))
        return key, s.replace("y", "x"), last - first + 1 - distinct if distinct else 0, s.count("x"), s.count("y"), upper, illegal

    key, started, done, held = None, False, [], 0
    letters: list[str] = []
    first = last = distinct = illegal = 0
    before = ""
    for batch in batches:
        for conv, turn, initial, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "letter")), strict=True):
            if not started or conv != key:
                if started:
                    done.append(close())
                    held += len(letters) + 1
                    if held > 1_000_000:
                        yield record(done)
                        done, held = [], 0
                key, started, letters, distinct, illegal, before = conv, True, [], 0, 0, ""
            if not letter:
                continue
            letters.append(letter)
            if before and before + initial not in ("su", "ua", "au"):
                illegal += 1
            before = initial
            if turn is not None:
                if not distinct:
                    first = last = turn
                    distinct = 1
                elif turn != last:
                    last, distinct = turn, distinct + 1
    if started:
        done.append(close())
    if done:
        yield record(done)


def solved(found: DataFrame) -> DataFrame:
    """``signatures`` with ``cost`` and ``audit``: every distinct signature is solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1_000):
                part = batch.column("signature").slice(s, 1_000)
                cost, audit = zip(*map(solve, part.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part, pa.array(cost, pa.int64()), pa.array(audit)], ["signature", "cost", "audit"])

    answers = found.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")
    salted = answers.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("__s", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["signature", "__s"]).drop("__s")


HEADER = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_STREAM = "conv_id long, position long, role string, text string, edit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in _STREAM.split(", ")]


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's header (position 0, with its counts, cost and audit), then its repaired rows, in one partition.

    A repaired row has the position from 1, role, text and the initial of its edit; a deleted row is not there.
    """
    given, order = _ordered(rows.where("role IS NOT NULL"))
    nothing = {c: F.lit(None).cast("long") for c in HEADER[1:-1]}
    body = given.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", *(v.alias(c) for c, v in nothing.items()), F.lit(None).cast("string").alias("audit"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    head = audits.select("conv_id", F.lit(0).alias("kind"), none("turn", "long"), none("role", "string"), none("text", "string"), none("digest", "string"), *HEADER[1:])
    together = body.union(head).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order).drop("turn", "digest")
    return together.mapInArrow(_replay, _STREAM)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = at = position = state = 0
    audit, key = "", None

    def put(role: str, text: str, edit: str) -> None:
        nonlocal position, state, size
        position += 1
        state = NEXT[role[:1]][state]
        size += len(text) + 40
        out.append((key, position, role, text, edit, *[None] * 7))

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put({"u": "user", "a": "assistant"}[WANTED[state]], "", "I")
            at += 1

    for batch in batches:
        columns = batch.to_pydict()
        for conv, kind, role, text, *header in zip(*(columns[c] for c in ("conv_id", "kind", "role", "text", *HEADER[1:])), strict=True):
            if kind == 0:
                inserts()  # the last ones of the conversation before
                key, audit, at, position, state = conv, header[-1], 0, 0, 0
                out.append((key, 0, None, None, None, *header))
                size += 40 + len(audit)
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(role, text, edit)
            elif edit == "R":
                put({"u": "user", "a": "assistant"}[WANTED[state]], text, edit)
            if size > 4_000_000:
                yield _record(out)
                out, size = [], 0
    inserts()
    if out:
        yield _record(out)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired, audits) of ``rows_of`` rows: (conv_id, position, role, text, edit), and a row of counts, cost and audit for
    each conversation."""
    audits = stored(solved(stored(signatures(rows), "signatures")).select(*HEADER), "audits")
    return replayed(rows, audits).where("position > 0").select("conv_id", "position", "role", "text", "edit"), audits


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``replayed`` to a row for each conversation, with the SHA-256 of its ``role:text`` lines."""
    header, sha, done = None, None, []
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], [*HEADER, "repaired_sha256"])

    for batch in batches:
        columns = batch.to_pydict()
        for position, role, text, *head in zip(*(columns[c] for c in ("position", "role", "text", *HEADER)), strict=True):
            if position == 0:
                if header is not None:
                    done.append((*header, sha.hexdigest()))
                header, sha = head, hashlib.sha256()
            else:
                sha.update(f"{chr(10) * (position > 1)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(done) > 10_000:
            yield record()
            done = []
    if header is not None:
        done.append((*header, sha.hexdigest()))
        yield record()


def audited(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """Counts, cost, audit and digest of the repaired rows for each conversation of (conv_id, turn, role, text)."""
    rows = damage(rows_of(conversations))
    found = stored(signatures(rows), "signatures")
    stream = replayed(rows, solved(found))
    # The rows of a conversation come one after the other in one partition: no shuffle between these two.
    return stream.mapInArrow(_digests, f"conv_id long, {', '.join(c + ' long' for c in HEADER[1:-1])}, audit string, repaired_sha256 string")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    return audited(table(spark, sf_dir, "conversations"))


# SQL: the same faults, and the edits by dynamic programming over the rows; a state's best is '<cost, 12 digits><audit>' -----

_BLANK = "[\\x20\\x09-\\x0D]"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"


def _plus(best: str, cost: str, initial: str) -> str:
    """The best of a state, dearer and longer; null stays null."""
    return f"lpad(CAST(CAST(left({best}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({best}, 13) || '{initial}'"


def _inserted(acc: str) -> list[str]:
    """The best of the four states after inserts."""
    s = [f"{acc}[{i}]" for i in (1, 2, 3, 4)]
    u = f"least({s[2]}, {_plus(s[0], '2', 'I')}, {_plus(s[1], '2', 'I')}, {_plus(s[3], '2', 'I')})"
    a = f"least({s[3]}, {_plus(s[2], '2', 'I')}, {_plus(s[0], '4', 'II')}, {_plus(s[1], '4', 'II')})"
    return [s[0], s[1], u, a]


_EXTRA = "(CASE WHEN x <> lower(x) THEN 1 ELSE 0 END)"


def _stepped() -> str:
    """The states after a row x, a letter; ``i`` holds the states after inserts."""
    gone = lambda s: _plus(f"i[{s}]", "3", "D")
    kept = lambda role, states: f"CASE WHEN lower(x) = '{role}' THEN least({', '.join(_plus(f'i[{s}]', _EXTRA, 'K') for s in states)}) END"
    fresh = lambda states: f"CASE WHEN x <> 'x' THEN least({', '.join(_plus(f'i[{s}]', f'2 + {_EXTRA}', 'R') for s in states)}) END"
    return f"[{gone(1)}, least({gone(2)}, {kept('s', (1,))}), least({gone(3)}, {kept('u', (1, 2, 4))}, {fresh((1, 2, 4))}), least({gone(4)}, {kept('a', (3,))}, {fresh((3,))})]"


_SQL = f"""
    WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    faults AS (SELECT *, {_CRC} % 20 AS f FROM given),
    changed AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
            CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faults),
    placed AS (SELECT *, row_number() OVER w AS i,
            coalesce(nullif(left(role, 1), ''), ' ') AS initial, right(regexp_replace(text, '{_BLANK}+$', ''), 1) AS ending
        FROM changed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
    repeated AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
    marked AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM repeated),
    letters AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(l) ELSE l END AS x
        FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS l FROM marked)),
    convs AS (SELECT DISTINCT conv_id FROM conversations),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM letters GROUP BY conv_id),
    walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, ['000000000000', NULL, NULL, NULL]::VARCHAR[] AS states FROM convs
        UNION ALL SELECT conv_id, place, {_stepped()} FROM (
            SELECT w.conv_id, l.i AS place, l.x, [{', '.join(_inserted('w.states'))}] AS i FROM walk w JOIN letters l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.place + 1)),
    ends AS (SELECT w.conv_id, [{', '.join(_inserted('w.states'))}] AS states FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.place = coalesce(f.n, 0)),
    best AS (SELECT conv_id, least(states[1], states[4]) AS b FROM ends),
    audits AS (SELECT conv_id, CAST(left(b, 12) AS BIGINT) AS cost, substr(b, 13) AS audit FROM best),
    edits AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS p FROM audits WHERE audit <> ''),
    numbered AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
            row_number() OVER (PARTITION BY conv_id, edit = 'D' ORDER BY p) AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS total FROM edits),
    lines AS (SELECT e.conv_id, e.place, CASE WHEN e.edit = 'K' THEN l.role WHEN (e.total - e.place) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE l.text END AS line
        FROM numbered e LEFT JOIN letters l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.i = e.i WHERE e.edit <> 'D'),
    joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS whole FROM lines GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM audits a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM a.conv_id"""

QUERIES = {"op12_conversations": op12_conversations}
ORACLE_SQL = {"op12_conversations": _SQL}
