"""Normalisation of short technical texts: an ordered list of Column -> Column steps.

The order matters and is kept: compatibility decomposition runs before the fraction step, so a vulgar fraction glues
to a digit before it. Null counts as empty. All steps run in the JVM: decomposition and case folding by the Unicode
library that Spark ships for its collations.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.stopwords import PORTUGUESE

Step = Callable[[Column], Column]

#: Every mark that combines with the character before it.
COMBINING = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))
# Vulgar fractions.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
#: What separates words: blanks of every script.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _unicode(c: Column, place: str, name: str) -> Column:
    """A text through a static method of the Unicode library; `c` is named once, so that chained steps don't multiply."""
    return F.reflect(F.lit(place), F.lit(name), F.coalesce(c, F.lit("")), F.lit(True))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without the marks that combine, for every script."""
    return F.translate(_unicode(c, "com.ibm.icu.text.Normalizer", "decompose"), COMBINING, "")


def fold_case(c: Column) -> Column:
    """Full case folding: stronger than lower case (`ß` becomes `ss`, a final sigma an ordinary one)."""
    return _unicode(c, "com.ibm.icu.lang.UCharacter", "foldCase")


def unify_symbols(c: Column) -> Column:
    return F.translate(c, "×X–—", "xx--")


def unify_fractions(c: Column) -> Column:
    """Vulgar fractions written out, and blanks around a stroke between digits removed."""
    out = c
    for symbol, fraction in FRACTIONS.items():
        out = F.replace(out, F.lit(symbol), F.lit(fraction))
    # The stroke, and the pattern.
    return F.regexp_replace(F.replace(out, F.lit("⁄"), F.lit("/")), rf"(?<=\d)[{BLANK}]*/[{BLANK}]*(?=\d)", "/")


def decimal_point(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d)", ".")  # fixed value


def drop_noise(c: Column) -> Column:
    return F.regexp_replace(c, r'(?U)[^\w\s./"-]+', " ")  # fixed value


def join_measures(c: Column) -> Column:
    """`2 x 3` becomes `2x3`, `10 mm` becomes `10mm`, `dn 50` becomes `dn50`; matches do not overlap."""
    # The patterns and their units.
    out = F.regexp_replace(c, r"(?i)(\d)\s*x\s*(\d)", "$1x$2")
    out = F.regexp_replace(out, r"(?i)(\d)\s*(mm|cm|m|v|w|kw|kva|hp)\b", "$1$2")
    return F.regexp_replace(out, r"(?i)\b(dn)\s*(\d)", "$1$2")


def words(c: Column) -> Column:
    """Tokens between blanks. Matching words is many times faster than splitting at blanks, and a class of all that isn't blank
    by its property many times faster than by a list of blanks: with the four separators it is the same set as BLANK."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0)


def drop_stopwords(c: Column, stopwords: Sequence[str] = PORTUGUESE) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*stopwords)), " ")  # a hash set, not a scan of the list


def single_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


# Names and order of the steps.
STEPS: tuple[tuple[str, Step], ...] = (
    ("strip_accents", strip_accents),
    ("normalize_case", fold_case),
    ("normalize_symbols", unify_symbols),
    ("normalize_fractions", unify_fractions),
    ("normalize_decimal_comma", decimal_point),
    ("remove_noise_punct", drop_noise),
    ("normalize_technical_spacing", join_measures),
    ("remove_stopwords", drop_stopwords),
    ("normalize_whitespace", single_blanks),
)


def normalize(c: Column, steps: Sequence[tuple[str, Step]] = STEPS) -> Column:
    """A text after all steps, in their order."""
    out = F.coalesce(c, F.lit(""))
    for _, step in steps:
        out = step(out)
    return out


def _appended(step: Step) -> Step:
    return lambda s: F.concat(s, F.array(step(F.element_at(s, -1))))


def normalize_report(c: Column, steps: Sequence[tuple[str, Step]] = STEPS) -> Column:
    """struct(raw, normalized, changes): each change with its step, the text before and after."""
    # Stages are array elements made once each, so that an expression isn't repeated for every later step.
    state = F.array(F.coalesce(c, F.lit("")))
    for _, step in steps:
        state = F.transform(F.array(state), _appended(step))[0]
    names = F.array(*[F.lit(name) for name, _ in steps])

    def reported(s: Column) -> Column:
        changes = F.transform(F.sequence(F.lit(1), F.lit(len(steps))), lambda i: F.struct(F.element_at(names, i).alias("step"), F.element_at(s, i).alias("before"), F.element_at(s, i + 1).alias("after")))
        return F.struct(c.alias("raw"), F.element_at(s, -1).alias("normalized"), F.filter(changes, lambda x: x["before"] != x["after"]).alias("changes"))

    return F.transform(F.array(state), reported)[0]


def removed_tokens(before: Column, after: Column) -> Column:
    """Tokens of `before` that `after` lacks, as a multiset, in order: of n copies the last are the removed ones."""
    b, a = words(before), words(after)
    occurrence = lambda i, w: F.size(F.filter(F.slice(b, 1, i + 1), lambda x: x == w))
    kept = F.transform(b, lambda w, i: F.struct(w.alias("w"), (occurrence(i, w) > F.size(F.filter(a, lambda x: x == w))).alias("gone")))
    return F.transform(F.filter(kept, lambda x: x["gone"]), lambda x: x["w"])


def clean_upper(c: Column) -> Column:
    """Trimmed, upper case, single blanks: the key that matches equal texts of two corpora."""
    return F.upper(single_blanks(F.coalesce(c, F.lit(""))))
