"""Column functions over names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col



def _plain_letters() -> tuple[str, str]:
    """Letters that decompose into a letter and combining marks (U+0300 to U+036F), and the letters without the marks."""
    accented, plain = [], []
    for c in map(chr, range(0xC0, 0x3000)):
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        if len(rest) == 1 and rest != c:
            accented.append(c)
            plain.append(rest)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _plain_letters()
#: Upstream area above which a match of a minor water is a stray.
MINOR_MOST_UP = 20000.0
# Generic first words, minor waters, creeks.
GENERIC = r"^(rio|river|riozinho|igarape|corrego|ribeirao|cano|quebrada|arroyo|arroio|parana|furo|braco|riacho|corixo|grota)\s+"
MINOR = r"(?i)^(igarap[eé]|furo|paran[aáã]|canal|bra[cç]o|quebrada|ca[nñ]o|lago|lagoa|entrada|sacado|riacho|c[oó]rrego|arroyo|arroio|ribeir[aã]o|corixo|grot[aã]o?|demarca)"
CREEK = r"(?i)^(canal|igarap[eé]|quebrada|c[oó]rrego|arroyo|arroio|riacho|grot[aã]o?|furo)"


def strip_accents(name) -> Column:
    """Letters without the marks that canonical decomposition parts from them; combining marks go too."""
    return F.regexp_replace(F.translate(col(name), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def label_key(name) -> Column:
    """The key by which labels compare: no accents, case, punctuation, generic first word or spaces."""
    s = F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9 ]+", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.replace(F.regexp_replace(s, GENERIC, ""), F.lit(" "), F.lit(""))


def attribute_key(name) -> Column:
    """The key of attribute tables: no accents or case, without a leading rio or river; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(name)), r"^(rio|river)\s+", ""))


def alternatives(name) -> Column:
    """Label keys of a name's parts between slashes, bracketed remarks left out."""
    parts = F.transform(F.split(col(name), "/"), lambda p: label_key(F.regexp_replace(p, r"\([^)]*\)", " ")))
    return F.filter(parts, lambda p: p != "")


def tolerance(a, b) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n >= 9, 2).when(n >= 5, 1).otherwise(0)


def same_name(a, b) -> Column:
    """Equal, or within the edit distance that the shorter key's length allows."""
    a, b = col(a), col(b)
    return (a == b) | (F.levenshtein(a, b) <= tolerance(a, b))


def is_minor(name) -> Column:
    return col(name).rlike(MINOR)


def is_creek(name) -> Column:
    return col(name).rlike(CREEK)


def plausible(name, up, most: float = MINOR_MOST_UP) -> Column:
    """Whether a match of area `up` may be a water of that name: minor waters are not large."""
    return ~(is_minor(name) & (col(up) > most))


def attribute_of(markup, attribute: str) -> Column:
    """The first value of a quoted attribute in a text of markup; null where there is none."""
    return F.nullif(F.regexp_extract(col(markup), attribute + '="([^"]*)"', 1), F.lit(""))
