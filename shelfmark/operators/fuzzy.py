"""Fuzzy matching of names: a pattern's atoms, which names match them, and an alignment that scores.

Atoms are separated by spaces; ``\\`` before a space keeps it in the atom. An atom is a subsequence of the name, or with ``'`` before
it a substring, with ``^`` before it a beginning, with ``$`` after it an end, with both the whole name; ``!`` before it turns it
round, and then it is a substring where it would be a subsequence. ``\\`` before one of these signs takes it as it stands.

Unless case counts, letters are compared in lower case. A letter of an atom that has no mark matches the same letter with any
mark: marks are taken off the name unless the atom itself has one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MATCH, BOUNDARY, CONSECUTIVE, GAP_OPEN, GAP_EXTEND = 16, 8, 4, 3, 1
#: Code points whose marks are taken off: Latin letters beyond ASCII.
MARKED = (range(0xC0, 0x250), range(0x1E00, 0x1F00))
#: Names that are aligned together, at most.
TOGETHER = 4_096


@lru_cache
def _unmarked() -> dict[int, str]:
    """Letters with marks to the ASCII letters they consist of besides."""
    out = {}
    for c in (c for part in MARKED for c in part):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii() and base.isalpha():
            out[c] = base
    return out


@lru_cache
def _lowered() -> dict[int, str]:
    """Upper-case letters that have one lower-case letter, of one code unit each."""
    return {c: low for c in range(0x10000) if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and low != chr(c) and ord(low) < 0x10000}


@dataclass(frozen=True)
class Atom:
    """``kind``: fuzzy, substring, prefix, suffix or exact; ``text`` as it is compared; ``marks``: whether marks count."""

    text: str
    kind: str
    negative: bool
    marks: bool


def atoms(pattern: str, case_sensitive: bool = False) -> list[Atom]:
    """The atoms of a pattern; empty ones are left out."""
    parts, now, k = [], "", 0
    while k < len(pattern):
        if pattern[k] == "\\" and k + 1 < len(pattern) and pattern[k + 1] == " ":
            now, k = now + " ", k + 2
            continue
        if pattern[k] == " ":
            parts.append(now)
            now = ""
        else:
            now += pattern[k]
        k += 1
    out = []
    for part in [*parts, now]:
        negative = part.startswith("!")
        text = part[negative:]
        kind = "substring" if negative else "fuzzy"
        if text[:1] in ("^", "'"):
            kind, text = ("prefix" if text[0] == "^" else "substring"), text[1:]
        elif text[:2] in ("\\^", "\\'") or (not negative and text[:2] == "\\!"):
            text = text[1:]
        if text.endswith("\\$"):
            text = text[:-2] + "$"
        elif text.endswith("$"):
            kind, text = ("exact" if kind == "prefix" else "suffix"), text[:-1]
        if text:
            text = text if case_sensitive else text.translate(_lowered())
            out.append(Atom(text, kind, negative, any(ord(c) in _unmarked() for c in text)))
    return out


def compared(name: str, atom: Atom, case_sensitive: bool) -> str:
    """A name as an atom sees it, letter by letter."""
    name = name if atom.marks else name.translate(_unmarked())
    return name if case_sensitive else name.translate(_lowered())


def _compared(name: Column, atom: Atom, case_sensitive: bool) -> Column:
    tables = ([] if atom.marks else [_unmarked()]) + ([] if case_sensitive else [_lowered()])
    for table in tables:
        name = F.translate(name, "".join(map(chr, table)), "".join(table.values()))
    return name


def _in_class(c: str) -> str:
    """A character as a member of a class of a Java pattern."""
    return "\\" + c if c.isascii() and not c.isalnum() else c


def fuzzy_prefilter(name: Column, text: str, case_sensitive: bool) -> Column:
    """A native test that holds exactly for the names that all atoms match.

    What stands before each character is matched possessively, so a name is read once, whatever it holds.
    """
    keep = F.lit(True)
    for atom in atoms(text, case_sensitive):
        subject, t = _compared(name, atom, case_sensitive), F.lit(atom.text)
        if atom.kind == "fuzzy":
            test = subject.rlike("(?s)^" + "".join(f"[^{_in_class(c)}]*+[{_in_class(c)}]" for c in atom.text))
        else:
            test = {"substring": F.contains, "prefix": F.startswith, "suffix": F.endswith}.get(atom.kind, lambda a, b: a == b)(subject, t)
        keep = keep & (~test if atom.negative else test)
    return keep


def _matrix(names: list[str], width: int) -> np.ndarray:
    """Code points of names, a row each, padded with -1."""
    out = np.full((len(names), width), -1, np.int64)
    for row, n in zip(out, names, strict=True):
        row[: len(n)] = np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _bonus(names: list[str], width: int) -> np.ndarray:
    """BOUNDARY where a character begins a word: at the start, after no letter or digit, or upper case after lower case."""
    out = np.zeros((len(names), width), np.int64)
    for row, n in zip(out, names, strict=True):
        row[: len(n)] = [BOUNDARY if k == 0 or not n[k - 1].isalnum() or (c.isupper() and n[k - 1].islower()) else 0 for k, c in enumerate(n)]
    return out


def align_all(names: list[str], atom: Atom, case_sensitive: bool = False) -> np.ndarray:
    """The best score of an atom in each name; -1 where it does not match.

    Each matched character scores; more so at the beginning of a word or right after another match; gaps between matches cost
    an opening and an extension (Gotoh 1982), what stands before the first match and after the last is free. All names are
    aligned at once, a character of the atom at a time.
    """
    width = max(map(len, names), default=0) + 1
    subject, bonus = _matrix([compared(n, atom, case_sensitive) for n in names], width), _bonus(names, width)
    low, ramp = -(1 << 40), np.arange(width) * GAP_EXTEND
    end = None
    for c in atom.text:
        score = MATCH + bonus
        if end is not None:
            near = np.full_like(end, low)
            near[:, 1:] = end[:, :-1] + CONSECUTIVE
            if atom.kind == "fuzzy":
                far = np.full_like(end, low)
                far[:, 2:] = np.maximum.accumulate(end + ramp, axis=1)[:, :-2] - ramp[2:] - GAP_OPEN + GAP_EXTEND
                near = np.maximum(near, far)
            score = score + near
        end = np.where(subject == ord(c), score, low)
    lengths = np.array([len(n) for n in names], np.int64)
    size = len(atom.text)
    if atom.kind in ("prefix", "exact"):
        end[:, size:] = low
        end[:, : size - 1] = low
    if atom.kind in ("suffix", "exact"):
        last = np.arange(width)[None, :] == lengths[:, None] - 1
        end = np.where(last, end, low)
    best = end.max(axis=1)
    return np.where(best > low // 2, best, -1)


def align(name: str, text: str, case_sensitive: bool = False) -> int | None:
    """The score of a pattern in one name, None if it does not match."""
    found = _scored([name], text, case_sensitive)[0]
    return None if found < 0 else int(found)


def _scored(names: list[str], text: str, case_sensitive: bool) -> np.ndarray:
    """The sum of the scores of all atoms, -1 where one does not match. Atoms that are turned round add nothing."""
    total, missing = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    for atom in atoms(text, case_sensitive):
        score = align_all(names, atom, case_sensitive)
        missing |= (score < 0) != atom.negative
        if not atom.negative:
            total += score
    return np.where(missing, -1, total)


def _batches(names: list[str]) -> Iterator[np.ndarray]:
    """Places of names of like lengths, so that little is padded."""
    order = np.argsort([len(n) for n in names], kind="stable")
    for s in range(0, len(order), TOGETHER):
        yield order[s : s + TOGETHER]


def fuzzy_score(name: Column, text: str, case_sensitive: bool) -> Column:
    """The score of a pattern as an Arrow batch function, 1 at least; null if an atom does not match."""

    @pandas_udf("long")
    def score(names: pd.Series) -> pd.Series:
        given, out = names.fillna("").tolist(), np.zeros(len(names), np.int64)
        for places in _batches(given):
            out[places] = _scored([given[p] for p in places], text, case_sensitive)
        return pd.Series(np.maximum(out, 1), dtype="Int64").mask(out < 0)

    return score(name)
