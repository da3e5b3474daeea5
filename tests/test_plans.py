"""The query language and what else runs on the driver."""

import pytest

from shelfmark.plans.parser import normalize_hhmm, parse, parse_date, parse_size, tokenize, within_folder
from shelfmark.plans.regexes import literal, translate
from shelfmark.plans.settings import Settings
from shelfmark.plans.spec import SortKey, SortState, TypeFilter


def test_tokens():
    assert tokenize('a  "b c"d e"f') == ["a", "b cd", "ef"]
    assert tokenize(' "" \t') == []


@pytest.mark.parametrize(
    ("text", "value"),
    [("10mb", 10 << 20), ("1.5kb", 1536), ("100", 100), ("2g", 2 << 30), ("abc", None), ("", None), ("1_0", None), ("-5k", 0), (" 1 tb ", 1 << 40), ("9999999999t", (1 << 63) - 1), ("5x", None), (".5k", 512)],
)
def test_sizes(text, value):
    assert parse_size(text) == value


@pytest.mark.parametrize(("text", "value"), [("1970", 0), ("1970-02", 31 * 86400), ("1970-1-2", 86400), ("1970-13", None), ("x", None), ("1970-01-01-01", None), ("2024-02-30", None)])
def test_dates(text, value):
    assert parse_date(text) == value


def test_dates_in_zones():
    assert parse_date("2024-01-01", "Europe/Berlin") == 1704063600
    assert parse_date("2018-11-04", "America/Sao_Paulo") is None  # this midnight was skipped


def test_filters_combine():
    s = parse('report ext:.PDF,docx, e:txt path:Work size:>1mb size:<5mb date:2024-01-01..2024-01-02 type:dirs content:"two words"')
    assert (s.terms, s.extensions, s.paths, s.content) == (("report",), ("pdf", "docx", "txt"), ("Work",), "two words")
    assert (s.size_min, s.size_max, s.type) == (1 << 20, 5 << 20, TypeFilter.FOLDER)
    assert s.date_max - s.date_min == 2 * 86400


def test_quirks_of_the_language():
    assert parse(r"C:\x").content == r"\x"
    assert parse("PATH:Ab").paths == ("Ab",)
    assert parse("size:>1kb size:>zz").size_min is None  # what cannot be read clears the bound
    assert parse("size:>1kb size:zz").size_min == 1024  # a bare one leaves it
    assert parse("date:<=2024-01-02").date_max == parse_date("2024-01-02")
    assert parse("date:>2024-01-02").date_min == parse_date("2024-01-02")
    assert parse("size:10b").size_min == 9 and parse("size:10b").size_max == 11
    assert parse("type:nonsense").is_empty and parse("").is_empty and not parse("path:x").is_empty
    assert parse("path:x").needs_path


def test_within_folder():
    assert within_folder("a path:b p:c", "/x y") == 'a p:c path:"/x y"'
    assert within_folder("", "/x") == 'path:"/x"'


def test_regexes():
    assert translate("(?=a)", True) is None and translate(r"(a)\1", True) is None and translate("(a", True) is None and translate("a++", True) is None
    assert translate("a$", True).endswith(r"a\z") and translate("[$]", False).endswith("[$]")
    assert literal("a.b") == r"a\.b"


def test_sort_clicks():
    s = SortState().click(SortKey.NAME)
    assert s == SortState(SortKey.NAME, True)
    s = s.click(SortKey.NAME)
    assert s == SortState(SortKey.NAME, False)
    assert s.click(SortKey.NAME) == SortState()


def test_settings(tmp_path):
    path = tmp_path / "a" / "settings.json"
    assert Settings.load(path) == Settings()
    Settings(max_results=7, roots=["/x"]).save(path)
    assert Settings.load(path).max_results == 7 and Settings.load(path).checked().max_results == 100
    path.write_text("{")
    assert Settings.load(path) == Settings()


def test_times_of_day():
    assert [normalize_hhmm(x) for x in ("4:00", "23:59", "24:00", "4", "", "a:b")] == ["04:00", "23:59", None, None, None, None]
