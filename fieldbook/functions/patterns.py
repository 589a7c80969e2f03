"""Helpers for patterns that both Spark (Java) and the SQL oracles (RE2) understand."""

from __future__ import annotations

import re

#: White space as browsers define it; the escapes are valid in both dialects.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters, to be taken off the ends of a text.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: White space that folding changes: all but a single blank.  The look-aheads pass over plain letters by one comparison.
FOLDED = rf"(?=[^!-~])(?: (?=[^!-~]){SPACE}|(?! ){SPACE.replace(chr(92) + 'r ', chr(92) + 'r')}){SPACE}*"
#: A word boundary that takes only ASCII letters, digits and _ for word characters.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _spaces(pattern: str) -> str:
    """``\\s``, also first in a bracket, as the white space above."""
    return pattern.replace(r"[\s", "[" + SPACE[1:-1]).replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\s", SPACE)


def java(pattern: str, first: str = "") -> str:
    r"""The pattern for Spark: ``\b`` is ASCII there too, and ``\s`` is the white space above.

    `first`, characters that any match begins with, as in a bracket, passes over all others by one comparison: sets of
    many ranges, alternatives and look-behinds are then tried at a few places only.
    """
    pattern = re.sub(r"\\b(?=\\d|\((?:\?:)?[A-Za-z]|[a-z])", r"(?<!\\w)", _spaces(pattern))  # before what is certainly a word character
    pattern = re.sub(r"(?<=[a-z)])\\b$", r"(?!\\w)", pattern)
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern).group()
    return flags + (f"(?=[{first}])" if first else "") + pattern.removeprefix(flags).replace(r"\b", EDGE)


def re2(pattern: str) -> str:
    r"""The pattern for DuckDB, inside a quoted SQL string."""
    return _spaces(pattern).replace("'", "''")
