"""Scalar columns against plain Python."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scalars as x
from shelfmark.operators.extract import strip_markup
from shelfmark.plans.settings import DEFAULT_EXCLUSIONS
from shelfmark.sources.files import is_excluded


def run(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_extensions(spark):
    assert run(spark, ["foo.txt", "foo", ".hidden", "a.tar.gz", "a.", "a\n.b"], x.extension) == ["txt", None, None, "gz", None, "b"]


def test_human_sizes(spark):
    values = [0, 1023, 1024, 1280, 1536, 102400, 10 << 20, 5 << 40, 3 << 50]
    assert run(spark, values, x.human_size, "bigint") == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "100 KB", "10.0 MB", "5.0 TB", "3.0 PB"]


def test_thousands_and_paths(spark):
    assert run(spark, [1234567, 12], x.thousands, "bigint") == ["1,234,567", "12"]
    assert run(spark, ["/a/b", "/a", "a"], x.parent_path) == ["/a", "/", ""]
    assert run(spark, ["/a/b", "/a/.", "a"], x.base_name) == ["b", ".", "a"]


@pytest.mark.parametrize("patterns", [[".git", "node_modules", "/proc"], ["a/b", "\\c", "d/"], [" ", "X"], list(DEFAULT_EXCLUSIONS)])
def test_exclusions(spark, patterns):
    paths = ["/r/.git/config", "/r/.github/x", "/r/.gitignore", "/r/node_modules/a", "/proc/1", "/process.txt", "/x/proc", "/a/b", "/a/bc", "/ca/b/c", "/r/c", "/d", "/d/", "/d//", "/x/d/e", "/X", "/home/me/dev", "", "/"]
    assert run(spark, paths, lambda c: x.excluded(c, patterns)) == [is_excluded(p, patterns) for p in paths]


def test_exclusion_facts():
    rules = [".git", "node_modules", "/proc"]
    assert [is_excluded(p, rules) for p in ("/r/.git/config", "/r/node_modules", "/proc/cpuinfo", "/proc", "/r/.github", "/r/.gitignore", "/process.txt")] == [True] * 4 + [False] * 3


def test_markup(spark):
    values = ["<p>a &amp; b</p><p> c </p>", "&amp;lt;", "a<b", "a > b", "", "x</p>\n\n</p>y\r\nz", "&quot;&apos;"]
    assert run(spark, values, lambda c: x.strip_markup(c, "</p>")) == [strip_markup(v.replace("\r\n", "\n"), "</p>") for v in values]
    assert strip_markup("<p>a &amp; b</p><p> c </p>", "</p>") == "a & b\nc\n" and strip_markup("&amp;lt;", "</p>") == "<\n"


def test_media_summary(spark):
    schema = "i struct<duration_secs:double,width:int,height:int,format:string>"
    df = spark.createDataFrame([((222.0, 1920, 1080, "MP4"),), ((3725.0, None, None, None),), ((None, None, None, None),)], schema)
    assert [r[0] for r in df.select(x.media_summary(F.col("i"))).collect()] == ["3:42  •  1920×1080  •  MP4", "1:02:05", ""]


def test_selection(spark):
    df = spark.createDataFrame([(0, None), (1, "/a/b.txt"), (3, "/x")], "n int, p string")
    assert [r[0] for r in df.select(x.selection_summary(F.col("n"), F.col("p"))).collect()] == ["nothing", "b.txt", "3 items"]
