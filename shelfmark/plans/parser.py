"""The query language: text to SearchSpec. Everything here runs on the driver."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime
from zoneinfo import ZoneInfo

from shelfmark.plans.spec import MatchMode, SearchSpec, TypeFilter

DAY = 86_400
LARGEST = (1 << 63) - 1
#: The prefixes of each filter, in the order they are tried.
PREFIXES = {
    "ext": ("ext:", "e:"),
    "path": ("path:", "p:", "in:"),
    "size": ("size:", "s:"),
    "date": ("date:", "dm:", "modified:"),
    "type": ("type:", "t:"),
    "content": ("content:", "c:", "grep:"),
}
_FILES = {"file", "files", "f"}
_FOLDERS = {"folder", "folders", "dir", "dirs", "d"}
_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4}
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(text: str) -> str:
    """Lower case for A to Z only."""
    return text.translate(_FOLD)


def tokenize(text: str) -> list[str]:
    """Split at white space outside double quotes; the quotes go, wherever they stand."""
    out, now, quoted = [], [], False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
    out.append("".join(now))
    return [t for t in out if t]


def parse_size(text: str) -> int | None:
    """Bytes of a size such as ``1.5kb``; None if it is none. Fractions are cut, negatives become 0."""
    low = fold(text.strip())
    at = next((k for k, c in enumerate(low) if "a" <= c <= "z"), len(low))
    number, unit = low[:at].strip(), low[at:].strip()
    if unit not in _UNITS or not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", number, re.ASCII):
        return None
    return max(0, min(LARGEST, int(float(number) * 1024 ** _UNITS[unit])))


def parse_date(text: str, zone: str = "UTC") -> int | None:
    """Epoch seconds of midnight in a zone; a missing month or day is the first. None for no date, or a skipped midnight."""
    parts = text.split("-")
    if len(parts) > 3 or not all(re.fullmatch(r"\+?\d+", p, re.ASCII) for p in parts):
        return None
    try:
        day = date(*(int(p) for p in [*parts, 1, 1][:3])) if len(parts) < 3 else date(*map(int, parts))
    except (ValueError, OverflowError):
        return None
    local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone))
    seconds = int(local.timestamp())
    return seconds if datetime.fromtimestamp(seconds, ZoneInfo(zone)).replace(tzinfo=None) == local.replace(tzinfo=None) else None


def _bounded(value: str, spec: SearchSpec, names: tuple[str, str], read, bare) -> SearchSpec:  # noqa: ANN001
    """Bounds from ``a..b``, ``>a``, ``<b`` or a bare value. What cannot be read clears its bound."""
    low, high = names
    if ".." in value:
        a, b = value.split("..", 1)
        return replace(spec, **{low: read(a, False), high: read(b, True)})
    for sign, name in ((">=", low), ("<=", high), (">", low), ("<", high)):
        if value.startswith(sign):
            return replace(spec, **{name: read(value[len(sign) :], False)})
    return bare(value, spec)


def _size(value: str, spec: SearchSpec) -> SearchSpec:
    def bare(v: str, s: SearchSpec) -> SearchSpec:
        n = parse_size(v)
        return s if n is None else replace(s, size_min=n - n // 10, size_max=min(LARGEST, n + n // 10))

    return _bounded(value, spec, ("size_min", "size_max"), lambda v, _: parse_size(v), bare)


def _date(value: str, spec: SearchSpec, zone: str) -> SearchSpec:
    def read(v: str, closes: bool) -> int | None:
        n = parse_date(v, zone)
        return n if n is None or not closes else n + DAY

    def bare(v: str, s: SearchSpec) -> SearchSpec:
        n = parse_date(v, zone)
        return s if n is None else replace(s, date_min=n, date_max=n + DAY)

    return _bounded(value, spec, ("date_min", "date_max"), read, bare)


def parse(text: str, mode: MatchMode = MatchMode.SUBSTRING, case_sensitive: bool = False, zone: str = "UTC") -> SearchSpec:
    """The plan of a query. For each token the first matching group of prefixes wins; other tokens are name terms."""
    spec = SearchSpec(mode=mode, case_sensitive=case_sensitive)
    for token in tokenize(text):
        low = fold(token)
        kind, value = next(((k, token[len(p) :]) for k, ps in PREFIXES.items() for p in ps if low.startswith(p)), ("term", token))
        if kind == "ext":
            found = (fold(v.strip().lstrip(".")) for v in value.split(","))
            spec = replace(spec, extensions=spec.extensions + tuple(v for v in found if v))
        elif kind == "path":
            spec = replace(spec, paths=spec.paths + (value,)) if value else spec
        elif kind == "size":
            spec = _size(value, spec)
        elif kind == "date":
            spec = _date(value, spec, zone)
        elif kind == "type":
            low = fold(value)
            spec = replace(spec, type=TypeFilter.FILE if low in _FILES else TypeFilter.FOLDER) if low in _FILES | _FOLDERS else spec
        elif kind == "content":
            spec = replace(spec, content=value) if value else spec
        else:
            spec = replace(spec, terms=spec.terms + (value,))
    return spec


def within_folder(query: str, folder: str) -> str:
    """The query restricted to a folder: tokens that start with ``path:`` make way for the new one."""
    rest = [t for t in query.split() if not fold(t).startswith("path:")]
    return f'{" ".join(rest)} path:"{folder}"'.strip()


def normalize_hhmm(text: str) -> str | None:
    """``4:00`` to ``04:00``; None if it is no time of day."""
    h, colon, m = text.partition(":")
    if not colon or not all(re.fullmatch(r"\+?\d+", x.strip(), re.ASCII) for x in (h, m)):
        return None
    hour, minute = int(h), int(m)
    return f"{hour:02}:{minute:02}" if hour < 24 and minute < 60 else None
