"""Operators that relate rows: against brute force over small tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import components, jaccard, lines, mixing, tokenfile

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Components


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(random.randint(100, 160), random.randint(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    want = {}
    for a, b in edges:
        want.setdefault(a, a)
        want.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if k not in loops}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# N-gram Jaccard join


def brute_groups(rows, n, percent):
    sets = []
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return Counter((i, len(s), None if i is None else label[i]) for i, s in sets)


def groups(df, n, percent):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(df, n, percent).collect())


@pytest.mark.parametrize(("block", "few", "pivots"), [(128, 32, 2), (3, 1 << 24, 1), (3, 0, 0)])
def test_jaccard(spark, odd, monkeypatch, block, few, pivots):
    """With small blocks, frequent n-grams go through pivots, then pairs or the blocked product."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    random.seed(block)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    stem = [f"t{i}" for i in range(60)]
    for k in range(40):
        words = list(stem)
        for _ in range(random.randint(0, 3)):
            words[random.randrange(60)] = f"v{random.randrange(1000)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, " ".join(random.choice("abc") for _ in range(random.randint(1, 12)))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert groups(df, 3, 90) == brute_groups(rows, 3, 90)
    if block == 128:
        assert groups(df, 5, 80) == brute_groups(rows, 5, 80)


def test_counters_reach_the_driver_as_columns(spark):
    """Of all counters the driver makes no object for each."""
    import tracemalloc

    n = jaccard.SKETCH + jaccard.WORDS
    counts = spark.range(n).select(F.col("id").cast("int").alias("g"), (F.col("id") * 3).alias("c"))
    tracemalloc.start()
    order = jaccard.Order(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000 and order.counters.tolist() == list(range(0, 3 * jaccard.SKETCH, 3))


def test_jaccard_of_nothing(spark, none):
    assert jaccard.near_groups(none).count() == 0 and jaccard.keep_first(none).count() == 0


def test_sets_whose_first_hashes_clash(spark, odd, monkeypatch):
    """With a first hash of two bits nearly all sets clash; the second hash tells them apart."""
    plain = jaccard.identities
    monkeypatch.setattr(jaccard, "identities", lambda sets, clashes=frozenset(): (lambda a, b: (np.where(np.isin(a & 3, list(clashes)), b, a & 3), b))(*plain(sets)))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert groups(odd, 3, 90) == brute_groups(rows, 3, 90)


def test_keep_first(spark, odd):
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 8, 9])


def test_keep_first_of_repeated_ids(spark):
    """One of the rows with one id and text stays; a row that shares its id with a copy of another document stays."""
    one, two, three = ("the quick brown fox jumps over the lazy dog", "an unrelated text with words of its own here", "a third text that has nothing to do with others")
    rows = [(1, one, "b"), (2, two, "a"), (2, two, "a"), (3, one, "a"), (3, three, "a"), (4, three + " at", "a"), (5, three, "a"), (None, one, "a"), (None, one, "a"), (6, "", "a"), (6, "", "a")]
    got = jaccard.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    want = [(1, one, "b"), (2, two, "a"), (3, three, "a"), (None, one, "a"), (None, one, "a"), (6, "", "a"), (6, "", "a")]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert got.schema == spark.createDataFrame([], "doc_id bigint, text string, source string").schema


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = (" ".join(f"Word{i}" for i in range(5000)) + " " + "y" * 900).encode()
    whole = jaccard.shingle_sets([text], 3)[0][0]
    monkeypatch.setattr(jaccard, "PIECE", 501)
    assert (jaccard.shingle_sets([b"a b", text, b""], 3)[1][0] == whole).all() and len(whole) == 4999


# Line dedup


def brute_lines(rows):
    """Texts after dropping each line that an earlier one equals or nearly equals."""

    def near(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        x, y = sorted((x, y), key=len)
        return any(x == y[:k] + y[k + 1 :] for k in range(len(y)))

    seen, short, out = [], set(), {}
    for i, text in sorted(rows):
        stay = []
        for line in text.split("\n"):
            if len(line) < lines.MIN_CHARS:
                if line not in short or not WORD.search(line):
                    stay.append(line)
                short.add(line)
                continue
            if not any(near(line, s) for s in seen):
                stay.append(line)
            seen.append(line)
        out[i] = "\n".join(stay)
    return out


def test_line_dedup(spark):
    random.seed(4)
    stems = ["the house of the rising sun is far", "x" * 25, "é" * 30 + "a" * 100, "abc" * 60]
    rows = []
    for i in range(40):
        own = []
        for _ in range(random.randint(1, 5)):
            s = list(random.choice(stems))
            for _ in range(random.randint(0, 2)):
                k = random.randrange(len(s))
                change = random.choice("rid")
                if change == "r":
                    s[k] = random.choice("abéz")
                elif change == "i":
                    s.insert(k, random.choice("abéz"))
                else:
                    del s[k]
            own.append("".join(s))
        rows.append((i, "\n".join([*own, "short", f"n{i % 9}", " ", ""])))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash"))).collect()
    want = brute_lines(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_lines"] - r["n_dropped"] == want[r["doc_id"]].count("\n") + 1 for r in got)


def test_versions_are_spared(spark):
    """A document that would lose half of its text stays whole; one that loses less, or all, does not."""
    part = ["first line that is long enough", "second line that is long enough", "third line that is long enough"]
    own = "a line of its own, and a very long one at that, so that more than half of the text is left over"
    rows = [(1, "\n".join(part)), (2, "\n".join([*part, "and one more"])), (3, "\n".join([*part, own])), (4, "\n".join(part))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(docs, spare=0.5).collect()}
    assert got == {1: (rows[0][1], 0), 2: (rows[1][1], 0), 3: (own, 3), 4: ("", 3)}


def test_line_dedup_of_odd_rows(odd, none):
    got = lines.dedup_lines(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_dropped"] == 0 and by[6]["n_dropped"] == 1 and by[6]["text"] == "" and by[2]["text"] is None and by[None]["text"].startswith("a row") and by[5]["n_dropped"] == 0
    assert lines.dedup_lines(none).count() == 0


def test_long_lines(spark):
    a = "".join(chr(97 + i % 26) for i in range(20_000))
    b = a[:9000] + "!" + a[9000:]
    rows = [(1, a), (2, b), (3, b[:-1] + "?"), (4, a + "12")]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


# Mixing


def test_exponent():
    tokens = [100, 10, 10]
    natural = mixing.entropy(mixing.weights(tokens, 1.0))
    x = mixing.exponent(tokens, 0.9, 100.0)
    assert 0 < x < 1 and mixing.entropy(mixing.weights(tokens, x)) == pytest.approx(0.9 * np.log(3), rel=1e-6) and natural < 0.9 * np.log(3)
    y = mixing.exponent(tokens, 1.0, 2.0)
    assert max(mixing.repeats(tokens, mixing.weights(tokens, y))) == pytest.approx(2.0, rel=1e-6)
    assert mixing.exponent([5], 1.0, 1.0) == 1.0 and mixing.exponent([5, 5]) == 1.0


def test_mixing_meets_its_budgets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), "en", ("big" if i % 10 < 7 else f"s{i % 10}"), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mix(docs.withColumn("epoch", F.lit("clash")))
    pdf = got.select("doc_id", "source", "epoch", "weight", "mix_key", mixing.token_count(F.col("text")).alias("t")).toPandas()
    assert set(pdf["doc_id"]) == set(range(3000)) and not pdf.duplicated(["doc_id", "epoch"]).any()
    share = pdf.groupby("source")["t"].sum() / pdf["t"].sum()
    assert (share - pdf.groupby("source")["weight"].first()).abs().max() < 0.002
    passes = pdf.groupby("source")["t"].sum() / pdf[pdf["epoch"] == 0].groupby("source")["t"].sum()
    assert passes.max() <= mixing.REPEATS + 1e-6 and passes["big"] == 1.0
    again = mixing.mix(docs).select("doc_id", "epoch").toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "epoch"]].values.tolist()))
    assert key(again) == key(pdf)


def plain_mixture(rows):
    """(doc_id, epoch) by plain Python; rows have the hashes that Spark gives them."""
    tokens = Counter()
    for r in rows:
        tokens[r["s"]] += r["t"]
    x = mixing.exponent(sorted(tokens.values()))
    most, out = max(tokens.values()), Counter()
    for s, total in tokens.items():
        passes = (total / most) ** (x - 1)
        whole = int(passes + 1e-9)
        left = max(0, int((passes - whole) * total))
        blocks = {}
        for r in rows:
            if r["s"] == s:
                blocks.setdefault(r["turn"], []).append(r)
                out.update((r["doc_id"], e) for e in range(whole))
        room = left
        for _, own in sorted(blocks.items()):
            size = sum(r["t"] for r in own)
            if size <= room:
                out.update((r["doc_id"], whole) for r in own)
                room -= size
                continue
            for order in sorted({r["order"] for r in own}):
                peers = [r for r in own if r["order"] == order]
                room -= sum(r["t"] for r in peers)
                if room < 0:
                    break
                out.update((r["doc_id"], whole) for r in peers)
            break
    return out


@pytest.mark.parametrize("most", [10_000, 3])
def test_mixing_equals_a_plain_one(spark, monkeypatch, most):
    """Every reading of every row, with the plan on the driver and as a table."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 400)
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["big"] * 6 + ["s1", "s2", "s3", None])) for i in range(600)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    decided, few = mixing.plan(docs)
    assert few == (most > 3)
    keyed = mixing._placed(docs.withColumn("__s", mixing._source()).withColumn("__doc", F.xxhash64("doc_id", "text")).join(decided, "__s"))
    hashed = keyed.select("doc_id", F.col("__s").alias("s"), mixing.token_count(F.col("text")).alias("t"), F.struct("__turn", "__block").alias("turn"), F.col("__order").alias("order")).collect()
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(docs).collect())
    assert got == plain_mixture(hashed)


def test_op6_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.op6_mixing_sources(spark, sf).toPandas()
    assert set(got["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert got.groupby("source")["weight"].first().sum() == pytest.approx(1.0, abs=1e-6) and got["mix_key"].between(0, 2).all()


def test_mixing_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert mixing.mix(none).count() == 0


# Token files


@pytest.mark.parametrize("kind", ["random", "repeats", "one", "none", "ramp", "large", "ends"])
def test_coder_round_trip(kind, monkeypatch):
    rng = np.random.default_rng(1)
    ids = {"random": rng.integers(0, 1 << 16, 700), "repeats": np.tile(rng.integers(0, 50_000, 40), 60), "one": np.array([65_535]), "none": np.zeros(0, np.int64), "ramp": np.arange(300), "large": rng.integers(0, 1 << 32, 700), "ends": np.tile([0, (1 << 32) - 1, 1 << 31, 7, 8, 1 << 17, 1 << 16], 90)}[kind].astype(np.int64)
    blob = tokenfile.compress(ids, block=256)
    assert (tokenfile.expand(blob) == ids).all()
    monkeypatch.setattr(tokenfile, "LANES", 2)
    assert tokenfile.compress(ids, block=256) == blob  # a block does not depend on those beside it
    assert (tokenfile.expand(blob) == ids).all()
    if kind == "repeats":
        assert len(blob) < 2 * len(ids) * 0.75
    if kind == "random":
        bad = bytearray(blob)
        bad[-20] ^= 0x55
        with pytest.raises(ValueError):
            tokenfile.expand(bytes(bad))
    with pytest.raises(ValueError):
        tokenfile.compress(np.array([1 << 32]))


def test_buckets():
    ids = np.unique(np.concatenate([np.arange(5000), 2 ** np.arange(32), 2 ** np.arange(1, 33) - 1]))
    b = tokenfile.bucket_of(ids)
    assert (np.diff(b) >= 0).all() and (tokenfile.LEAST[b] <= ids).all() and (ids - tokenfile.LEAST[b] < 1 << tokenfile.OPEN[b]).all() and tokenfile.bucket_of(np.array([65_535]))[0] == 59


ODD_TEXTS = [
    "<|endoftext|>", "a <|endoftext|> b", "a\0b", "\0", " ", "\n", "  x", "x  y", "a\n\nb", "a \n b", "a\n", "\na", "a\tb\r\nc", "it's we'll x's. (y's) 'z", "1.5,a-b_c e\u0301\u00e9.", "\u00a0x\u2028y \x1cz",
    "\u0120word a\u0120 b", "a\u3000b", "x.\n.y ... !?", "end. end, end; 'end' end's", "  a  b  ", "\n\n\n", "a\x85b", "\ufeffx",
]


def test_pieces_equal_whole_texts(monkeypatch):
    """Against the tokenizer as it comes; a second pass finds every piece known, a third forgets in between."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.VOCABULARY)
    plain, own = Tokenizer.from_file(path), tokenfile.Tokens(path, 2)
    rng = random.Random(8)
    mixed = ["".join(rng.choice(["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "7", "***", "日"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts = [*ODD_TEXTS, *mixed, " ".join(f"w{i % 977}x{i}." for i in range(60_000)), "x" * 30_000, ""]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for limit in (1 << 30, 1 << 30, 0):
        monkeypatch.setattr(tokenfile, "REMEMBERED", limit)
        ids, sizes = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert own.encode([])[0].tolist() == []


def test_pieces_are_learned_once():
    """Words are looked up without what stands around them, so their number does not multiply with punctuation and digits."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.VOCABULARY)
    plain, own = Tokenizer.from_file(path), tokenfile.Tokens(path, 2)
    words = ["".join(p) for p in itertools.product(["er", "ß", "On", "ж"], repeat=3)]
    texts = [f"x {w}{end} y" for w in words for end in (".", ",", "!!", "...", ";", "7", ".)", "?\n")]
    ids, sizes = own.encode(pa.array(["left out", *texts, None]).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]
    assert len(own.known) < len(words) + 20


def test_cuts_at_odd_characters():
    """Characters that a piece may or may not end at: white space beyond ASCII, signs among letters, marks, contractions."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.VOCABULARY)
    plain, own = Tokenizer.from_file(path), tokenfile.Tokens(path, 2)
    parts = ["a", "Bc", "\u00e9", "\u00df", "\u00d7", "\u00f7", " ", " ", " ", "\n", "\t", "\r\n", "\x0b", ".", "!?", "'", "'s", "'re", "7", "\u00b2", "\u65e5", "\u3000", "\u00a0", "\x85", "\u200b", "\u2003", "\u2028", "\u180e", "\x1c", "\0", "\u0301", "\u0436", "\u0482", "\U0001f600", "\u2014", "\u0663", "\ufeff", "<|endoftext|>"]
    rng = random.Random(5)
    texts = [a + b + c for a in parts for b in parts for c in parts[:8]] + ["".join(rng.choices(parts, k=rng.randint(3, 14))) for _ in range(3000)]
    ids, sizes = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("kind", ["digits", "prefix", "lower"])
def test_other_patterns(kind, tmp_path):
    """A tokenizer that splits texts in another way gets them whole."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    if kind == "lower":
        plain.normalizer = normalizers.Lowercase()
    else:
        level = pre_tokenizers.ByteLevel(add_prefix_space=kind == "prefix")
        plain.pre_tokenizer = level if kind == "prefix" else pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), level])
    plain.save(path := str(tmp_path / "other.json"))
    texts = ["one 1999 (Two) it's 12,5", "1234", "", "A\n\nb 77"]
    ids, sizes = tokenfile.Tokens(path, 2).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.VOCABULARY)
    plain = Tokenizer.from_file(path)
    more = [(100, x) for x in ODD_TEXTS] + [(100, f"tie {k}") for k in range(100)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = tokenfile.read(tokenfile.write(docs.withColumn("start", F.lit("clash")).withColumn("part", F.lit("clash")), path)).toPandas()
    start, want = 0, []
    rows = docs.withColumn("h", F.xxhash64("text")).collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "")):
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, tokenfile.END], "<u4")
        want.append((None if r["doc_id"] is None else r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = [(None if pd.isna(a) else int(a), int(b), int(c), int(d)) for a, b, c, d in got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=lambda x: x[1]) == want
    assert tokenfile.read(tokenfile.write(none, path)).count() == 0


def test_op5_query(spark, sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfile.op5_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
