"""English stems by Porter's suffix stripping (1980), as a column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.common import let

# The suffixes of steps 2 and 3 with what takes their place, and those of step 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

# A word is a run of consonants, then pairs of vowels and consonants; y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONE = f"^(?:{_C})?{_V}{_C}"  # at least one pair
TWO = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
JUST_ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
VOWEL = f"^(?:{_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # as in hop, so that hoping came from hope
DOUBLE = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"


def _stripped(word: Column, suffixes: list[str], body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of what is before the longest suffix and the suffix; the word itself if it has none."""
    pattern = f"^(.+?)({'|'.join(suffixes)})$"
    stem, suffix = F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)
    return F.when(word.rlike(pattern), let(F.struct(stem.alias("stem"), suffix.alias("suffix")), lambda p: body(p["stem"], p["suffix"]))).otherwise(word)


def _mapped(word: Column, table: dict[str, str]) -> Column:
    new = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return let(word, lambda w: _stripped(w, list(table), lambda stem, suffix: F.when(stem.rlike(ONE), F.concat(stem, F.get(F.map_values(F.map_filter(new, lambda k, v: k == suffix)), F.lit(0)))).otherwise(w)))


def _plural(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "^(.+?)(ss|i)es$", "$1$2"), "^(.+?[^s])s$", "$1")


def _past(word: Column) -> Column:
    def mended(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(DOUBLE), F.substring(stem, F.lit(1), F.length(stem) - 1))
            .when(stem.rlike(SHORT), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def eed(stem: Column, _: Column) -> Column:
        return F.concat(stem, F.when(stem.rlike(ONE), "ee").otherwise("eed"))

    def other(stem: Column, suffix: Column) -> Column:
        return F.when(stem.rlike(VOWEL), mended(stem)).otherwise(F.concat(stem, suffix))

    return F.when(word.rlike("^.+eed$"), _stripped(word, ["eed"], eed)).otherwise(_stripped(word, ["ed", "ing"], other))


def _final_y(word: Column) -> Column:
    return _stripped(word, ["y"], lambda stem, y: F.concat(stem, F.when(stem.rlike(VOWEL), "i").otherwise("y")))


def _long_suffix(word: Column) -> Column:
    def ion(w: Column) -> Column:
        return _stripped(w, ["(?<=[st])ion"], lambda stem, _: F.when(stem.rlike(TWO), stem).otherwise(w))

    def other(stem: Column, suffix: Column) -> Column:
        return F.when(stem.rlike(TWO), stem).otherwise(F.concat(stem, suffix))

    plain = f"^.+?(?:{'|'.join(STEP_4)})$"
    return F.when(word.rlike(plain), _stripped(word, STEP_4, other)).otherwise(ion(word))


def _final_e(word: Column) -> Column:
    def keep(stem: Column, _: Column) -> Column:
        goes = stem.rlike(TWO) | (stem.rlike(JUST_ONE) & ~stem.rlike(SHORT))
        return F.concat(stem, F.when(goes, "").otherwise("e"))

    return _stripped(word, ["e"], keep)


def _final_ll(word: Column) -> Column:
    return F.when(word.rlike("ll$") & word.rlike(TWO), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def porter_stem(word: Column) -> Column:
    """The stem of a lower-case word of a to z; words of one or two letters and all others stay."""
    steps = [
        lambda w: F.regexp_replace(w, "^y", "Y"),  # a consonant there
        _plural,
        _past,
        _final_y,
        lambda w: _mapped(w, STEP_2),
        lambda w: _mapped(w, STEP_3),
        _long_suffix,
        _final_e,
        _final_ll,
        F.lower,
    ]
    stem = reduce(lambda w, step: let(w, step), steps, word)
    return F.when(word.rlike("^[a-z]{3,}$"), stem).otherwise(word)
