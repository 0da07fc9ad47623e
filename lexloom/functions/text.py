"""Column functions over text: folding, stripping, normal forms and front matter."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented letters folded in searches (ñ and vowels with circumflex or tilde are kept).
ACCENTED = "áéíóúàèìòùäëïöüçåæø"
FOLDED = "aeiouaeiouaeioucaao"
# Signs without a shape of their own, removed before scanning and serving.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\xad"
#: White space as Python's str.strip sees it, for Java patterns with (?U).
SPACE = r"[\s\x1c-\x1f]"
_LINE_SPACE = r"[\s\x1c-\x1f&&[^\n]]*"
_FRONT = rf"(?mUd)\A---{_LINE_SPACE}\n((?s:.*?))^---{_LINE_SPACE}(?:\n|\z)((?s:.*))\z"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def fold(c: Column) -> Column:
    """Lower case without the accents that searches ignore."""
    return F.translate(F.lower(c), ACCENTED, FOLDED)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+", "")


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


#: Signs that are their own NFKC form and compose with nothing before them: texts of these alone need no Python.
INERT = (
    "\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    "\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u200b-\u200f\u2010\u2012-\u2016\u2018-\u2022\u20ac\ufeff"
)
_NOT_INERT = "[^" + "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in INERT) + "]"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unicodedata.normalize("NFKC", v) for v in values], dtype=object)


def nfkc(c: Column) -> Column:
    """NFKC form. Texts of inert signs are their own form: those rows reach Python as nulls."""
    return F.coalesce(_nfkc(F.when(c.rlike(_NOT_INERT), c)), c)


def normalised(c: Column) -> Column:
    """What the scanner looks at: NFKC without invisible signs. Never served."""
    return strip_invisible(nfkc(c))


def decode(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 becomes U+FFFD, line ends become \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def front_matter(text: Column) -> Column:
    """The block between the two ``---`` lines; '' if the text does not begin with one or it is not closed."""
    return F.regexp_extract(text, _FRONT, 1)


def body(text: Column) -> Column:
    """The text after the front matter without leading white space: what is scanned and what is served."""
    return lstrip(F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 2)).otherwise(text))


def front_fields(text: Column) -> Column:
    """array<struct<k, v>> of the front matter's ``key: value`` lines, in order; quotes of one pair are taken off."""
    lines = F.filter(F.split(front_matter(text), _LINE_ENDS), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_extract(x, r"(?s)\A[^:]*:(.*)\z", 1)).alias("v")))
    quoted = r"(?s)\A(?:\"(.*)\"|'(.*)')\z"
    bare = lambda v: F.when((F.length(v) >= 2) & v.rlike(quoted), F.concat(F.regexp_extract(v, quoted, 1), F.regexp_extract(v, quoted, 2))).otherwise(v)
    return F.filter(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), bare(p["v"]).alias("v"))), lambda p: p["k"] != "")


def field(fields: Column, *names: str) -> Column:
    """The first non-empty value among the named keys (of a repeated key the last counts); null if all are empty."""
    last = lambda name: F.try_element_at(F.filter(fields, lambda p: p["k"] == name), F.lit(-1))["v"]
    return F.coalesce(*[F.nullif(last(n), F.lit("")) for n in names])
