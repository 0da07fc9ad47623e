"""Problem 2: one form for text that looks alike.

A transducer over grapheme clusters. Its mapping of single signs (widths, letter styles, joined signs,
canonical composition, spaces, hyphens, look-alike letters) and of clusters (a base with its
marks) is computed once per process, checked for conflicts as a whole, and compiled into one longest-match
pattern; each text is rewritten in one pass. Clusters no letter is composed of (marks stacked at will)
are composed when met. Case, accents and line breaks are kept.

Defined results: null gives null; '' gives ''; ASCII text is returned as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.session import cut

# Letters drawn alike, other script -> Latin.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
# Small letters whose capitals are drawn like Latin ones; folded in comparisons without case only.
SMALL = {"в": "b", "к": "k", "м": "m", "н": "h", "т": "t"}
LATIN = {"ɡ": "g", "ɑ": "a"}
ARMENIAN = {"օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Լ": "L"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Latin": LATIN, "Armenian": ARMENIAN, "Cherokee": CHEROKEE}
STYLED = "\U0001d400-\U0001d7ff"  # letters and digits in mathematical styles
HYPHENS = "\u2010\u2011\ufe63\uff0d"
INVISIBLE = "\xad\u034f\u061c\u115f\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
MARKS = "\u0300-\u034e\u0350-\u036f\u0483-\u0489\u1160-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f"


def _singles() -> dict[str, str]:
    """Every single code point that is rewritten, from rules and the letter tables."""
    out: dict[str, str] = {}
    for code in (*range(0xA0, 0x10000), *range(0x1D400, 0x1D800)):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        category = unicodedata.category(c)
        if category == "Zs":
            out[c] = " "
        elif c in HYPHENS:
            out[c] = "-"
        elif category == "Mn":
            continue
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            out[c] = unicodedata.normalize("NFKC", c)
        elif unicodedata.decomposition(c).startswith("<font>"):
            shown = unicodedata.normalize("NFKC", c)
            if shown.isalnum():
                out[c] = shown
        elif unicodedata.decomposition(c).startswith("<compat>"):
            shown = unicodedata.normalize("NFKC", c)
            if shown.isalpha() and (len(shown) > 1 or 0x2160 <= code <= 0x217F):
                out[c] = shown
        elif (composed := unicodedata.normalize("NFC", c)) != c:
            out[c] = composed
    letters = {c: t for table in SCRIPTS.values() for c, t in table.items()}
    for code in range(0x370, 0x2000):  # letters with accents, whose base is drawn alike
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in letters:
            out[chr(code)] = unicodedata.normalize("NFC", letters[parts[0]] + parts[1:])
    return out | letters


def check_conflicts(letters: dict[str, str], name: str) -> None:
    """Two letters of one script must never fall together, and case must be kept."""
    taken: dict[str, str] = {}
    for c, target in letters.items():
        if target in taken:
            raise ValueError(f"{name}: {c} and {taken[target]} both become {target}")
        if c.isupper() != target.isupper() and target.isalpha():
            raise ValueError(f"{name}: {c} changes case")
        taken[target] = c


def check_mapping(mapping: dict[str, str]) -> None:
    """The finished mapping: no plain sign is rewritten, a second pass changes nothing, and two letters of one
    script that are not one letter written twice never fall together.
    """
    taken: dict[tuple[str, str], str] = {}
    for c, target in mapping.items():
        if c.isascii():
            raise ValueError(f"{c} is rewritten")
        if "".join(mapping.get(x, x) for x in target) != target:
            raise ValueError(f"{c} becomes {target}, which is rewritten again")
        if len(c) == 1 and c.isalpha():
            same = unicodedata.normalize("NFKC", c)
            script = unicodedata.name(c, "").split(" ")[0]
            if same != c and same not in mapping:
                continue  # a width, style or joined form of what it becomes
            other = taken.setdefault((script, target), same)
            if other != same:
                raise ValueError(f"{c} and {other} both become {target}")


class Transducer:
    """The compiled mapping. ``apply`` rewrites one text in one pass."""

    def __init__(self) -> None:
        for name, letters in SCRIPTS.items():
            check_conflicts(letters, name)
        self.single = _singles()
        for c, target in self.single.items():  # a second pass must change nothing
            if any(x in self.single for x in target):
                self.single[c] = "".join(self.single.get(x, x) for x in target)
        check_mapping(self.single)
        self.clusters = self._clusters()
        special = "".join(re.escape(c) for c in sorted(self.single) if c < "\U00010000") + STYLED
        self.has_cluster = re.compile(f"[{MARKS}{INVISIBLE}]").search
        self.sub_single = re.compile(f"[{special}]").sub
        # Longest match: a base and all the marks and invisible signs that follow it.
        self.sub_cluster = re.compile(f"[{special}][{MARKS}{INVISIBLE}]*|[^{special}][{MARKS}{INVISIBLE}]+|[{MARKS}{INVISIBLE}]+").sub
        self.strip = re.compile(f"[{INVISIBLE}]+").sub
        self.cluster = lru_cache(1 << 16)(self._cluster)

    def _clusters(self) -> dict[str, str]:
        """Every letter with marks that has a sign of its own, written as a base and its marks, and its form."""
        out = {}
        for code in range(0xA0, 0x10000):
            if not 0xD800 <= code < 0xE000 and len(parts := unicodedata.normalize("NFD", chr(code))) > 1:
                whole = unicodedata.normalize("NFC", "".join(self.single.get(c, c) for c in parts))
                out[parts] = "".join(self.single.get(c, c) for c in whole)
        written: dict[str, str] = {}
        for parts, form in out.items():
            shown = "".join(self.single.get(c, c) for c in parts)
            if written.setdefault(form, shown) != shown and unicodedata.normalize("NFC", written[form]) != unicodedata.normalize("NFC", shown):
                raise ValueError(f"{parts} and {written[form]} both become {form}")
        return out

    def _cluster(self, text: str) -> str:
        if (known := self.clusters.get(text)) is not None:
            return known
        shown = self.strip("", text)
        base = "".join(self.single.get(c, c) for c in shown)
        composed = unicodedata.normalize("NFC", base)
        return "".join(self.single.get(c, c) for c in composed)

    def apply(self, text: str) -> str:
        if text.isascii():
            return text
        if self.has_cluster(text):
            return self.sub_cluster(lambda m: self.cluster(m.group()), text)
        single = self.single
        return self.sub_single(lambda m: single.get(m.group(), m.group()), text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


_SMALL = str.maketrans(SMALL)
_HAS_SMALL = re.compile(f"[{''.join(SMALL)}]").search


def folded(text: str) -> str:
    """The form without case: small letters whose capitals look alike are made equal too, whichever case came first."""
    lower = text.lower() if text.isascii() else transducer().apply(text).lower()
    return lower.translate(_SMALL) if _HAS_SMALL(lower) else lower


def canonical(text: str | None) -> str | None:
    """The form of one text."""
    return None if text is None else transducer().apply(text)


@F.pandas_udf(StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    apply = transducer().apply
    return pd.Series([None if t is None else apply(t) for t in texts], dtype=object)


def canonical_column(text: Column) -> Column:
    """The form of a text column. ASCII rows pass by Python as nulls and keep their value."""
    odd = F.when(text.rlike("[^\\x00-\\x7f]"), text)
    return F.coalesce(canonical_udf(odd), text)


def with_form(df: DataFrame, text: str, out: str = "forma") -> DataFrame:
    """``df`` with the column ``out`` holding the form of column ``text``; an existing ``out`` is replaced."""
    return df.withColumn(out, canonical_column(F.col(text)))


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of keys whose texts have one form but differ as stored.

    Only 128-bit digests are shuffled; they are written once, so that each text passes Python once. Rows are first reduced to distinct (key, stored) digests;
    forms with one stored value only, however many rows share it, are dropped before the join,
    so the join meets no pairs of exact copies. Null keys and null texts are in no pair.
    """
    digests = cut(
        df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).alias("k"), F.unhex(F.md5(canonical_column(F.col(text)))).alias("form"), F.unhex(F.md5(F.col(text))).alias("stored"))
        .distinct()
    )
    # Forms stored in at least two ways: a small aggregate, hot forms are combined map-side.
    varied = digests.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    rows = digests.join(varied, "form", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.form") == F.col("b.form")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.stored") != F.col("b.stored"))
    return a.join(b, on).select(F.col("a.k").alias("id_a"), F.col("b.k").alias("id_b")).distinct()
