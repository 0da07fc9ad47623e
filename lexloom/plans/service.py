"""The façade with the error contract: each call gives rows or an error, never an exception for bad requests."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.articles import MAX_CONTENT
from lexloom.functions.scan import sanitize_metadata
from lexloom.functions.text import body
from lexloom.plans import search as S
from lexloom.sources.corpus import load_files, path_allowed

# Texts of errors.
NO_INDEX = "No hay índices disponibles."
AMBIGUOUS = "ID ambiguo: coincide con más de una ley."


@dataclass(frozen=True)
class Config:
    """Settings with their environment variables."""

    default_limit: int = field(default_factory=lambda: int(os.environ.get("LEXLOOM_DEFAULT_LIMIT", "20")))
    max_limit: int = field(default_factory=lambda: int(os.environ.get("LEXLOOM_MAX_LIMIT", "100")))
    max_chars: int = field(default_factory=lambda: int(os.environ.get("LEXLOOM_MAX_CONTENT_CHARS", str(MAX_CONTENT))))
    indices: str = field(default_factory=lambda: os.environ.get("LEXLOOM_INDICES_DIR", "indices"))


@dataclass(frozen=True)
class Failure:
    error: str
    sugerencias: list[str] | None = None


class Service:
    """Queries over an index and, for texts, a corpus: a table with columns pais_idx, _ruta, text (best
    partitioned by country and sorted by path), or the folder of files of each country.
    """

    def __init__(self, index: DataFrame | None, corpus: DataFrame | Mapping[str, str] | None = None, config: Config | None = None) -> None:
        self.index = index if index is None or "titulo_norm" in index.columns else S.with_norms(index)
        self.corpus, self.config = corpus, config or Config()
        self._codes: list[str] | None = None

    def _countries(self) -> list[str]:
        """Codes in the order of loading: one per index file, a small list."""
        if self._codes is None:
            self._codes = [] if self.index is None else [r[0] for r in self.index.groupBy("pais_idx").agg(F.min("corpus_ord").alias("o")).orderBy("o").collect()]
        return self._codes

    def listar_paises(self) -> DataFrame | Failure:
        return S.countries(self.index) if self._countries() else Failure(NO_INDEX)

    def buscar_ley(self, consulta: str = "", pais: str = "", rango: str = "", estado: str = "", anno: str = "", jurisdiccion: str = "", fecha_desde: str = "", fecha_hasta: str = "", limite: int | None = None, offset: int = 0) -> DataFrame | Failure:
        if not self._countries():
            return Failure(NO_INDEX)
        if pais and pais not in self._countries():
            return Failure(f"País '{pais}' no reconocido.", list(self._countries()))
        limit = min(max(1, self.config.default_limit if limite is None else limite), self.config.max_limit)
        page = S.select_laws(self.index, text=consulta, country=pais, rank=rango, status=estado, year=anno, jurisdiction=jurisdiccion, since=fecha_desde, until=fecha_hasta)
        return S.summary(page.orderBy("corpus_ord", "ord").offset(max(0, offset)).limit(limit))

    def _law(self, law: str, country: str) -> DataFrame | Failure:
        if not self._countries():
            return Failure(NO_INDEX)
        one = country if country in self._countries() else ""
        met = S.resolve(self.index, law, one).first()
        if met is None:
            if one or len(self._countries()) == 1:
                several = [r.id for r in S.suggestions(self.index, law, one).collect()]
                if several:
                    return Failure(AMBIGUOUS, several)
            safe = self.index.sparkSession.range(1).select(sanitize_metadata(F.lit(S.wanted_id(law)), 100)).first()[0]
            return Failure(f"Ley no encontrada: {safe}")
        return self.index.where((F.col("pais_idx") == met.pais_idx) & (F.col("id") == met.id))

    def _with_text(self, rows: DataFrame) -> DataFrame:
        if self.corpus is None:
            return rows.withColumn("texto", F.lit(""))
        at = rows.select("pais_idx", "_ruta").first()  # one law: its country and path are looked up as literals
        if isinstance(self.corpus, Mapping):
            folder = self.corpus.get(at.pais_idx)
            one = rows.sparkSession.createDataFrame([(at._ruta,)], "rel string")
            texts = load_files(one, folder).select(F.col("rel").alias("_ruta"), F.col("text").alias("_t")) if folder else one.select(F.col("rel").alias("_ruta"), F.lit("").alias("_t"))
        else:
            texts = self.corpus.where((F.col("pais_idx") == at.pais_idx) & (F.col("_ruta") == at._ruta)).select("_ruta", F.col("text").alias("_t")).limit(1)
        allowed = F.when(path_allowed(F.col("_ruta")), body(F.col("_t")))
        return rows.join(texts, "_ruta", "left").withColumn("texto", F.coalesce(allowed, F.lit(""))).drop("_t")

    def obtener_ley(self, id_ley: str, pais: str = "", solo_metadata: bool = False, max_chars: int | None = None) -> DataFrame | Failure:
        rows = self._law(id_ley, pais)
        if isinstance(rows, Failure):
            return rows
        if solo_metadata:
            none = {"texto": "string", "texto_truncado": "boolean", "chars_totales": "int", "chars_devueltos": "int"}
            return S.summary(rows).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        texts = S.law_texts(self._with_text(rows), most=self.config.max_chars if max_chars is None else max_chars)
        return S.summary(rows).crossJoin(F.broadcast(texts.select("texto", "texto_truncado", "chars_totales", "chars_devueltos")))  # one row each

    def obtener_articulo(self, id_ley: str, articulo: str, pais: str = "", contexto_chars: int | None = None) -> DataFrame | Failure:
        rows = self._law(id_ley, pais)
        if isinstance(rows, Failure):
            return rows
        if not articulo.strip():
            return Failure("El artículo no puede estar vacío.")
        return S.law_articles(self._with_text(rows), articulo, context=self.config.max_chars if contexto_chars is None else max(0, contexto_chars))

    def listar_rangos(self, pais: str = "") -> DataFrame | Failure:
        if not self._countries():
            return Failure(NO_INDEX)
        return Failure(f"País '{pais}' desconocido") if pais and pais not in self._countries() else S.ranks(self.index, pais)

    def estadisticas(self, pais: str = "") -> dict[str, DataFrame] | Failure:
        """Totals, statuses, top ranks and top years; an unknown country means all."""
        if not self._countries():
            return Failure(NO_INDEX)
        rows = self.index.where(F.col("pais_idx") == pais) if pais in self._countries() else self.index
        return {"totales": S.totals(rows), "estados": S.statuses(rows), "rangos": S.top_ranks(rows), "annos": S.top_years(rows)}
