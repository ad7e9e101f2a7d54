"""Pieces shared by the Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a browser counts as whitespace (body of a character class).
# Java's \s covers ASCII only.
SPACE_SET = (
    r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_SET}]"
SPACES = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# ASCII word boundary. JDK 17's own \b is Unicode-aware while its \w is ASCII.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside a higher-order function Catalyst does not share repeated sub-expressions, so a
    helper that mentions its input several times would otherwise grow exponentially when nested.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(text: Column) -> Column:
    """Strip browser whitespace (not only blanks) from both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(~text.rlike(rf"[^{SPACE_SET}]"), F.lit(True))
