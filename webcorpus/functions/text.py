"""Text cleaning and phrase masking."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.common import SPACE, SPACE_SET, WORD_EDGE, trim_space

# Phrase patterns that are masked, in the order they are applied.
MASKED_PHRASES = [
    rf"{WORD_EDGE}(?:p[o0]rn(?:ography)?|xxx){WORD_EDGE}",
    rf"{WORD_EDGE}(?:18\+{SPACE}*(?:explicit|content|only)){WORD_EDGE}",
    rf"{WORD_EDGE}(?:escort{SPACE}*service|cam{SPACE}*(?:girl|model|show)){WORD_EDGE}",
]


def clean_text(text: Column) -> Column:
    """Trim, drop non-ASCII (emoji included), then collapse whitespace to single blanks.

    The trim comes first, so a blank can lead or trail afterwards, and a no-break space inside
    the text is deleted rather than turned into a blank.
    """
    ascii_only = F.regexp_replace(trim_space(text), r"[^\x00-\x7F]+", "")
    # Single blanks, by far the most common whitespace, are not touched.
    return F.regexp_replace(ascii_only, r"[\t\n\x0B\f\r][\s\x0B]*| [\s\x0B]+", " ")


# Each masked phrase contains one of these, so other texts skip the patterns altogether.
_MASK_HINTS = ["porn", "p0rn", "xxx", "18+", "escort", "cam"]


def mask_phrases(text: Column, first_only: bool = True) -> Column:
    """Replace restricted phrases by one blank; by default only the first hit of each pattern.

    A replacement never joins letters, so it cannot create a hint that was not there before.
    """
    masked = text
    for phrase in MASKED_PHRASES:
        if first_only:
            masked = F.regexp_replace(masked, rf"(?is)^(.*?)(?:{phrase})", "$1 ")
        else:
            masked = F.regexp_replace(masked, rf"(?i)(?:{phrase})", " ")
    lowered = F.lower(text)
    hinted = reduce(or_, (lowered.contains(hint) for hint in _MASK_HINTS))
    return F.when(hinted, masked).otherwise(text)


def heading_line(line: Column) -> Column:
    """A line of three or more letters, digits and blanks that starts with a capital."""
    # One character class, not an alternation: Java would recurse once per character.
    return line.rlike(rf"^[A-Z][A-Za-z0-9{SPACE_SET}]{{2,}}\z")
