"""Extraction of one article from the text of a law, in Spanish, Portuguese, French, Swedish and German forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.rules import java_source
from lexloom.functions.text import strip

MAX_CONTENT = 80_000
NOT_FOUND = "Artículo no encontrado"
# How an article is written, in order of preference (T stands for its number), and what begins the next section.
FORMS = (
    r"art[ií]culo\s+T\b",
    r"^\s*Art\.\s*T\b",
    r"\bArticle\s+T\b",
    r"^#{0,6}\s*T\s*§",
    r"^#{0,6}\s*§\s*T\b",
    r"^§\.\s*T\.",
    r"^T\s*$",
)
NEXT = (
    r"art[ií]culo\s+\d+|Article\s+[LRD]?\d+|^\d+\s*§|^#{1,6}\s*\d+\s+kap\b|^#{0,6}\s*§\s*\d+|^§\.\s*\d+\."
    r"|^TÍTULO\s+|^CAPÍTULO\s+|^LIVRE\s+|^#{1,3}\s*(?:Buch|Teil|Abschnitt|Titel|Kapitel|Avdelning|Kapitel)\s+"
)
_FLAGS = "(?imuUd)"


def patterns(article: str) -> list[tuple[str, str, str]]:
    """For each form: (does it occur, fragment up to the next section, text before it)."""
    term = re.escape(article.strip())
    out = []
    for form in FORMS:
        own = java_source(form).replace("T", term) if "Art" not in form else re.sub(r"T(?=\\b)", lambda _: term, java_source(form))
        out.append((_FLAGS + own, rf"{_FLAGS}((?:{own}))((?s:.*?))({java_source(NEXT)}|\z)", rf"{_FLAGS}\A((?s:.*?))(?:{own})"))
    return out


def article(text: Column, number: str, context: int = MAX_CONTENT) -> Column:
    """struct<texto, posicion>: the fragment and its 0-based place in code points; null if not found.

    The first form that occurs anywhere wins. A fragment ends where the next section begins, else
    ``context`` code points after the article's own words. An empty number is an error.
    """
    if not number.strip():
        raise ValueError("the article must not be empty")
    tried = []
    for there, whole, before in patterns(number):
        head, tail, end = (F.regexp_extract(text, whole, i) for i in (1, 2, 3))
        tail = F.when((end == "") & (F.length(tail) > context), F.substring(tail, 1, context)).otherwise(tail)
        pos = F.length(F.regexp_extract(text, before, 1))
        tried.append(F.when(text.rlike(there), F.struct(strip(F.concat(head, tail)).alias("texto"), pos.alias("posicion"))))
    return F.coalesce(*tried)
