"""The stages of the pipeline on odd rows, and the whole on the smallest tables."""

import hashlib
import math
import string
import struct
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from shelfmark.llm import bpe, lines, mixing, quality
from tests.llm.test_relational import brute_groups, plain_mixture
from tests.llm.test_rowwise import WORD, plain_measures


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == list(pipeline.COLUMNS), name
            assert out.count() <= 2 * docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_short_lines_are_deduplicated(spark):
    """An exact copy with short lines leaves no stub; blank lines stay; short lines are not compared by edits."""
    long = "a line that is long enough to be compared by edits"
    own = "own words, more of them than are lost, so that it is no version of the others at all"
    rows = [(1, f"{long}\nshort\n\nshort\nshork", "en", "a", 1), (2, f"{long}\nshort\n\nshort\nshork", "en", "a", 1), (3, f"{own}\n \n{long}!\nshort\n", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: f"{long}\nshort\n\nshork", 3: f"{own}\n \n"}


def test_near_copies_reach_their_stage_whole(spark):
    """A copy with one changed line is passed on by line dedup and dropped by the Jaccard stage."""
    lines_ = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(10)]
    rows = [(1, "\n".join(lines_), "en", "a", 1), (2, "\n".join([*lines_[:9], "some other words at the end of it"]), "en", "a", 1), (3, "\n".join([lines_[0], *(f"{x} y" for x in ("z" * k for k in range(30, 50)))]), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    passed = pipeline.line_dedup(spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in passed.collect()} | {3: ""} == {1: rows[0][1], 2: rows[1][1], 3: ""}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, passed, "").collect()} == {1, 3}


def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pipeline.run(spark, d).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(docs)
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    for r in rows[:50]:
        ids = list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))
        text = own.decode(__import__("numpy").array(ids))
        assert ids == theirs.encode_ordinary(text.decode()) and hashlib.sha256(text).hexdigest() == r["decoded_sha256"]


# The whole run in plain Python


def plain_distance(p, q):
    """Jensen-Shannon distance of two lists of counts."""
    p, q = ([x / max(1, sum(c)) for x in c] for c in (p, q))
    total = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(total / 2, 0))


def plain_quality(rows):
    """The rows that pass the base rules and are near the documents of a language."""
    kinds = [" \t\n\x0b\x0c\r", string.ascii_lowercase, string.ascii_uppercase, string.digits, quality.SYMBOLS, quality.MARKS]
    common = {k: v.split() for k, v in quality.COMMON_WORDS.items()}

    def classes(text):
        own = [sum(c in kind for c in text) for kind in kinds]
        return [*own, len(text) - sum(own)]

    def frequent(text, lang):
        ws = WORD.findall(text.lower())
        own = [ws.count(w) for w in common[lang]]
        return [*own, len(ws) - sum(own)]

    refs = {}
    for k in common:
        texts = [r["text"] for r in rows if r["lang"] == k and r["text"]]
        if any(map(WORD.search, texts)):
            refs[k] = [[sum(x) for x in zip(*(f(t) for t in texts), strict=True)] for f in (classes, lambda t, k=k: frequent(t, k))]
    kept = []
    for r in rows:
        text = r["text"] or ""
        n, *_, repeats = plain_measures(text)
        if n < 50 or 100 * repeats > 50 * n:
            continue
        if r["lang"] is None or r["lang"] in refs:
            far = min(max(plain_distance(classes(text), a), plain_distance(frequent(text, k), b)) for k, (a, b) in refs.items())
            if far > (quality.SHORT_DISTANCE if n < quality.MIN_WORDS else quality.MAX_DISTANCE):
                continue
        kept.append(r)
    return kept


def plain_lines(rows, spare=True):
    """The rows less the lines that earlier ones have, by the rules of the stages."""
    near = lambda x, y: edits(x, y) <= 1
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        stay = []
        for line in r["text"].split("\n"):
            if not line.strip(" \t\n\x0b\x0c\r") and len(line) < lines.MIN_CHARS:
                stay.append(line)
                continue
            others = [o for n in (len(line) - 1, len(line), len(line) + 1) for o in seen.get(n, ())] if len(line) >= lines.MIN_CHARS else []
            if line not in seen.get(len(line), ()) and not any(len(o) >= lines.MIN_CHARS and near(line, o) for o in others):
                stay.append(line)
            seen.setdefault(len(line), set()).add(line)
        text = "\n".join(stay)
        if spare and text != r["text"] and len(r["text"]) - len(text) >= len(r["text"]) / 2 and WORD.search(text):
            text = r["text"]
        if text == r["text"] or WORD.search(text):
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def edits(x, y):
    """0, 1, or 2 for more: what is left between the common beginning and the common end."""
    a = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    x, y = x[a:], y[a:]
    b = next((k for k, (c, d) in enumerate(zip(x[::-1], y[::-1], strict=False)) if c != d), min(len(x), len(y)))
    return min(2, max(len(x), len(y)) - b)


def test_run_equals_a_plain_one(spark, tmp_path):
    """The rows of run() over documents with copies, near copies, shared lines, junk and short texts."""
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*pipeline.COLUMNS).collect()]
    good = [r for r in sorted(plain_quality(rows), key=lambda r: r["doc_id"]) if len(WORD.findall(r["text"])) > 150][:12]
    top = max(r["doc_id"] for r in rows) + 1
    more = [r["text"] for r in good[:3]]  # copies
    more += [r["text"].replace(WORD.findall(r["text"])[70], "altered", 1) for r in good[3:6]]  # near copies
    more += ["\n".join([*good[6]["text"].split("\n"), *(x[::-1] for x in good[6]["text"].split("\n"))]), good[8]["text"] + "\nok\nok\n\n", good[9]["text"] + "\nok"]
    more += ["too short", "", None, " ".join(f"{i}$$$#{i * 7}" for i in range(200)), "same words " * 100]
    rows += [{"doc_id": top + k, "text": t, "lang": good[0]["lang"], "source": "added", "n_chars": len(t or "")} for k, t in enumerate(more)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = lambda part: spark.createDataFrame([tuple(r[c] for c in pipeline.COLUMNS) for r in part], schema)
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")

    judged = plain_quality(rows)
    cut = plain_lines(judged)
    label = {i: own for (i, _, own) in brute_groups([(r["doc_id"], r["text"]) for r in cut], 5, 80)}
    firsts = [r for r in cut if label[r["doc_id"]] == r["doc_id"]]
    left = plain_lines(firsts, spare=False)
    assert len(rows) > len(judged) > len(cut) > len(firsts)
    assert sum(len(r["text"]) for r in left) < sum(len(r["text"]) for r in firsts)  # some were passed on whole
    docs = frame(left)
    keyed = mixing._placed(docs.withColumn("__s", mixing._source()).withColumn("__doc", F.xxhash64("doc_id", "text")).join(mixing.plan(docs)[0], "__s"))
    hashed = keyed.select("doc_id", F.col("__s").alias("s"), mixing.token_count(F.col("text")).alias("t"), F.struct("__turn", "__block").alias("turn"), F.col("__order").alias("order")).collect()
    times = Counter(i for i, _ in plain_mixture(hashed).elements())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(public_tokenizers.path(bpe.VOCABULARY)).rank, special_tokens={})
    want = Counter()
    for r in left:
        ids = theirs.encode_ordinary(r["text"])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[r["doc_id"], r["source"], len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += times[r["doc_id"]]
    got = Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert {k[:3]: v for k, v in got.items()} == {k[:3]: v for k, v in want.items()}
    assert got == want
