"""Filters, ranking, sorting and content over small catalogs."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.catalog import SCHEMA
from shelfmark.operators.content import EXCERPT, MAX_FILE, InvalidPattern, first_lines
from shelfmark.operators.fuzzy import align
from shelfmark.operators.search import matches, numbered, search, substring_score
from shelfmark.plans.parser import parse
from shelfmark.plans.spec import Category, MatchMode, SortKey


def catalog(spark, *rows):
    """Rows (path, is_dir, size, modified, is_deleted), the last three optional."""
    full = []
    for k, (path, is_dir, *rest) in enumerate(rows):
        size, modified, deleted = (*rest, 0, 0, False)[:3] if len(rest) == 0 else (*rest, *(0, 0, False)[len(rest) :])
        full.append((k, None, path.rsplit("/", 1)[-1], path, is_dir, size, modified, deleted))
    return spark.createDataFrame(full, SCHEMA)


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    return catalog(spark, ("/r", True), ("/r/docs", True), ("/r/report_2024.pdf", False, 100), ("/r/notes.txt", False, 5), ("/r/docs/summary_report.txt", False, 1), ("/r/gone report", False, 1, 0, True))


def test_small_tree(small):
    def count(q, mode=MatchMode.SUBSTRING):
        return matches(small, parse(q, mode)).count()

    assert count("report") == 2 and count("report ext:pdf") == 1 and count("report path:docs") == 1
    assert count(r"^notes\.(txt|md)$", MatchMode.REGEX) == 1 and count("(", MatchMode.REGEX) == 0
    assert "report_2024.pdf" in names(matches(small, parse("rpt2024", MatchMode.FUZZY)))
    assert all(r["is_dir"] for r in matches(small, parse("docs type:folder")).collect())
    assert count("size:<1gb") == 3  # no folder has a size
    assert matches(small, parse(""), Category.FOLDERS).count() == 2


def test_empty_query_shows_live_rows_by_id(small):
    out = search(small, parse(""), k=2)
    assert [r["entry_id"] for r in out.hits.collect()] == [0, 1]
    assert out.totals.first().asDict() == {"total": 5, "truncated": True}


def test_scores_of_awkward_names(spark):
    want = {
        "dog": 5197, "DOG": 5197, "dog.png": 4193, "dog.": 1696, "dogé": 1695, "dog.tar.gz": 1690, "dog park.jpg": 1688, ".dog": 896, "édog.txt": 891,
        "my dog photos.png": 883, "dogecoin_whitepaper.pdf": 577, "hotdog dog.txt": 286, "hotdog_recipes.txt": 282, "x" * 224 + "dog": 100, "cat": None, "": None,
    }
    df = spark.createDataFrame([(n,) for n in want], "name string")
    got = {r["name"]: r["s"] for r in df.select("name", substring_score(F.col("name"), ("dog",), False).alias("s")).collect()}
    assert got == want


def test_truncation(spark):
    c = catalog(spark, *((f"/a_hotdog_{i}.txt", False) for i in range(30)), ("/dog run.txt", False), ("/dog.txt", False))
    out = search(c, parse("dog"), k=2)
    assert names(out.hits) == ["dog.txt", "dog run.txt"]
    assert out.totals.first().asDict() == {"total": 32, "truncated": True}


def test_thresholds_equal_a_top_k(spark):
    """Any k, ties across it, ids with gaps; no limit but that of the last slice."""
    import random

    from shelfmark.operators.search import above_threshold, ranked

    random.seed(2)
    ids = random.sample(range(-(10**15), 10**15), 700) + list(range(300))
    rows = spark.createDataFrame([(i, random.choice([5, 5, 5, 5, 9, 1])) for i in ids], "entry_id bigint, score bigint")
    order = sorted(rows.collect(), key=lambda r: (-r["score"], r["entry_id"]))
    for k in (1, 2, 150, 400, 600, 601, 999, 1_000, 5_000):
        assert ranked(rows, k, few=0).collect() == order[:k]
        assert sorted(above_threshold(rows, k, 3).collect()) == sorted(order[:k])
    assert ranked(rows.limit(0), 10, few=0).count() == 0


def test_dates_and_unknown_times(spark):
    c = catalog(spark, ("/a", False, 1, 0), ("/b", True, 0, 86400), ("/c", False, 1, 2 * 86400))
    assert names(matches(c, parse("date:<1970-01-02"))) == ["a"]
    assert names(matches(c, parse("date:1970-01-02"))) == ["b"]


def test_case_is_ascii_only(spark):
    c = catalog(spark, ("/Écran", False), ("/ABC", False))
    assert names(matches(c, parse("écran"))) == [] and names(matches(c, parse("abc"))) == ["ABC"]
    assert names(matches(c, parse("abc", case_sensitive=True))) == []
    assert names(matches(c, parse("écran", MatchMode.REGEX))) == ["Écran"]


def test_sorting_flips_ties(spark):
    c = catalog(spark, ("/x/b", False, 1), ("/y/a", False, 1), ("/z/A", False, 2))
    hits = search(c, parse("type:file")).hits

    def order(key, down):
        return [r["path"] for r in numbered(hits, key, down).orderBy("row_number").collect()]

    assert order(SortKey.NAME, False) == ["/y/a", "/z/A", "/x/b"]
    assert order(SortKey.NAME, True) == ["/x/b", "/z/A", "/y/a"]
    assert order(SortKey.SIZE, True) == ["/z/A", "/x/b", "/y/a"]
    assert order(SortKey.SIZE, False) == ["/y/a", "/x/b", "/z/A"]


def test_fuzzy_alignment():
    assert align("report_2024.pdf", "rpt2024") is not None and align("abc", "acb") is None and align("", "a") is None
    assert align("foo bar", "b") > align("foobar", "b")
    assert align("abc", "abc") > align("axbxc", "abc")


def test_fuzzy_atoms(spark):
    """Kinds of atoms, signs taken as they stand, marks and case; the native test holds where there is a score."""
    from shelfmark.operators.fuzzy import align_all, atoms, fuzzy_prefilter

    assert [(a.text, a.kind, a.negative) for a in atoms("ab ^cd ef$ 'gh ^ij$ !kl !^mn !op$ \\^q \\!r s\\$ t\\ u  ! ^")] == [
        ("ab", "fuzzy", False), ("cd", "prefix", False), ("ef", "suffix", False), ("gh", "substring", False), ("ij", "exact", False), ("kl", "substring", True),
        ("mn", "prefix", True), ("op", "suffix", True), ("^q", "fuzzy", False), ("!r", "fuzzy", False), ("s$", "fuzzy", False), ("t u", "fuzzy", False),
    ]
    names = ["Résumé.PDF", "resume.pdf", "RESUME", "my résumé", "ré", "", "pdf.resume", "Straße", "a^b$", "日本語.txt", "x" * 300 + "resume"]
    cases = {"resume": 6, "résumé": 2, "^res": 3, "pdf$": 2, "!pdf": 8, "^resume$": 1, "'sume pdf": 3, "ß": 1, "\\^b": 1, "本語": 1, "": 11, "RÉ": 3}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for text, n in cases.items():
        held = [r["name"] for r in df.where(fuzzy_prefilter(F.col("name"), text, False)).collect()]
        assert len(held) == n and held == [x for x in names if align(x, text) is not None], text
    assert [align(x, "RESUME", True) is not None for x in names].count(True) == 1
    assert [r["name"] for r in df.where(fuzzy_prefilter(F.col("name"), "RE", True)).collect()] == ["RESUME"]
    some = [x for x in names if x]
    for atom in atoms("resume 'sum ^r e$"):
        assert align_all(some, atom).tolist() == [int(align_all([x], atom)[0]) for x in some]


def grep(spark, text, pattern, size=10, **how):
    hits = catalog(spark, ("/f", False, size)).withColumn("score", F.lit(1))
    found = first_lines(hits, spark.createDataFrame([(0, text)], "entry_id bigint, text string"), pattern, **how).collect()
    return (found[0]["line_no"], found[0]["line"]) if found else None


def test_content(spark):
    assert grep(spark, "hello world\nTODO: fix this  \t", "todo") == (2, "TODO: fix this")
    assert grep(spark, "nothing here", "todo") is None and grep(spark, None, "todo") is None and grep(spark, "", "x") is None
    assert grep(spark, "a\r\nb x\r\n", "x") == (2, "b x")
    assert grep(spark, "  x  ", "x") == (1, "  x") and grep(spark, "  x  ", "x", document=True) == (1, "x")
    assert grep(spark, "y" * 301, "y") == (1, "y" * EXCERPT)
    assert grep(spark, "a\0b\nx", "x") is None and grep(spark, "x\n\0", "x") == (1, "x")
    assert grep(spark, "x", "x", size=MAX_FILE) == (1, "x") and grep(spark, "x", "x", size=MAX_FILE + 1) is None
    assert grep(spark, "aXb", "x", case_sensitive=True) is None and grep(spark, "a.b", ".", as_regex=False) == (1, "a.b")
    assert grep(spark, "ab\na1", r"\d", as_regex=True) == (2, "a1")
    with pytest.raises(InvalidPattern):
        grep(spark, "x", "(", as_regex=True)


def test_content_of_crlf_and_binary(spark):
    """A NUL before the end of the matching line makes a text binary, whatever ends the lines above."""
    for end in ("\n", "\r\n"):
        above = f"line{end}" * 100
        assert grep(spark, f"{above}a\0b{end}needle", "needle") is None
        assert grep(spark, f"{above}needle{end}a\0b", "needle") == (101, "needle")
        assert grep(spark, f"{above}needle\0{end}", "needle") is None
        assert grep(spark, f"{above}x needle{end}", "needle$", as_regex=True) == (101, "x needle")


def test_content_of_files(spark, tmp_path):
    """Files in ranges of any size are searched as their texts are; a long one by several tasks."""
    import random

    from shelfmark.operators.content import first_lines_of_files
    from shelfmark.sources.texts import file_texts

    random.seed(8)
    texts = ["".join(random.choice(["x", "é", "needle", " ", "\n", "\r\n", "\n\n", "a b", "\0" if k % 9 == 0 else "y"]) for _ in range(random.randint(0, 60))) for k in range(40)]
    texts += ["", "\n", "needle", "no end", "x\n" * 5_000 + "needle\n", "x" * 3_000 + "needle", "\n" * 50 + "\0" + "\n" * 50 + "needle"]
    rows = []
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
        rows.append((f"{tmp_path}/{k}.txt", False, len(text.encode())))
    c = catalog(spark, *rows, (f"{tmp_path}/gone.txt", False, 100), (str(tmp_path), True, 0)).withColumn("score", F.lit(1))
    found = lambda df: {r["entry_id"]: (r["line_no"], r["line"]) for r in df.collect()}
    held = spark.createDataFrame(list(enumerate(texts)), "entry_id bigint, text string")
    want = found(first_lines(c, held, "NEEDLE"))
    assert 10 < len(want) < 45
    for size in (1, 7, 100, 1 << 20):
        assert found(first_lines_of_files(c, "NEEDLE", size=size)) == want
    assert found(search(c.drop("score"), parse("content:needle"), files=True).hits) == want
    long = file_texts(c.where("size > 9000"), 1_000)
    assert long.count() > 9 and "".join(r["text"] for r in long.orderBy("part").collect()) == texts[-3]


def test_empty_catalog(spark):
    c = spark.createDataFrame([], SCHEMA)
    for mode in MatchMode:
        assert search(c, parse("a", mode)).hits.count() == 0
    assert search(c, parse("")).totals.first()["total"] == 0


def test_fuzzy_reads_a_long_name_once(spark):
    """No backtracking: a name that nearly matches costs no more than its length."""
    import time

    from shelfmark.operators.fuzzy import fuzzy_prefilter

    names = spark.createDataFrame([("a" * 255,), ("a" * 254 + "b",), ("x.y[z]^-é",)], "name string")
    began = time.time()
    assert [r[0] for r in names.where(fuzzy_prefilter(F.col("name"), "aaaaaaaaaab", False)).collect()] == ["a" * 254 + "b"]
    assert time.time() - began < 5
    assert names.where(fuzzy_prefilter(F.col("name"), ".[]^-É", True)).count() == 0
    assert names.where(fuzzy_prefilter(F.col("name"), ".[]^-é", True)).count() == 1


def test_content_of_documents(spark):
    """Documents are searched in what their bytes hold; both limits can be lifted."""
    from tests.test_extract import DOCX

    c = catalog(spark, ("/a.DOCX", False, 10), ("/b.txt", False, 10), ("/c.pdf", False, 10), ("/d.docx", False, 10), ("/e.txt", False, MAX_FILE + 1), ("/f.docx", True, 0))
    texts = spark.createDataFrame([(0, "needle"), (1, "a\nneedle  "), (2, "needle"), (3, "needle"), (4, "needle")], "entry_id bigint, text string")
    data = spark.createDataFrame([(0, DOCX), (2, b"%PDF needle"), (3, None)], "entry_id bigint, data binary")
    spec = parse("content:NEEDLE")
    found = {r["name"]: (r["line_no"], r["line"]) for r in search(c, spec, texts=texts, documents=data).hits.collect()}
    assert found == {"a.DOCX": (1, "needle & thread"), "b.txt": (2, "needle")}
    assert search(c, spec, texts=texts, documents=data, max_file=None).totals.first()["total"] == 3
    assert search(c, spec, texts=texts, documents=data, candidates=1).totals.first()["total"] == 1
    assert search(c, spec, texts=texts, documents=data, candidates=None, max_file=None).totals.first()["total"] == 3
