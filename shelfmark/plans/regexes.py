"""The regular-expression dialect: linear-time syntax, Unicode aware, run by the JVM's engine."""

from __future__ import annotations

import re

#: What the dialect lacks: look-around, back-references, possessive quantifiers and atomic groups.
_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\(?:[1-9]|k<|G|Z|R|X|Q|E)")
_POSSESSIVE = re.compile(r"(?<!\\)(?:\\\\)*[*+?}]\+")


def translate(pattern: str, case_sensitive: bool) -> str | None:
    """The pattern for the JVM, or None if the dialect does not have it or it cannot be parsed."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: m[0] if m[0][0] == "\\" else "x", pattern)
    if _FOREIGN.search(bare) or _POSSESSIVE.search(bare):
        return None
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[pP][A-Z]|\\z", "x", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)))
    except re.error:
        return None
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        k += 1
    return ("(?dU)" if case_sensitive else "(?diuU)") + "".join(out)


def literal(text: str) -> str:
    """A pattern that matches the text as it stands."""
    return re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff])", r"\\\1", text)
