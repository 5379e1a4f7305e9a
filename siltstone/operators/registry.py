"""Registries: analyzers by language, and a vector store as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.vectors import neighbours


class Analyzers:
    """Analyzers by language: functions from files (path, content, language) to rows of one schema each, by kind of fact."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, *languages: str):
        def add(f: Callable[[DataFrame], DataFrame]):
            self.known.update({(kind, x): f for x in languages})
            return f

        return add

    def languages(self) -> list[str]:
        return sorted({x for _, x in self.known})

    def run(self, files: DataFrame, kind: str) -> DataFrame:
        """The rows of a kind of fact over all files whose language has an analyzer for it; each file is read once."""
        by: dict[Callable, list[str]] = {}
        for (k, language), f in self.known.items():
            if k == kind:
                by.setdefault(f, []).append(language)
        if not by:
            raise ValueError(f"no analyzer gives {kind}")
        parts = [f(files.where(F.col("language").isin(languages))) for f, languages in by.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class VectorStore:
    """Chunks with vectors (id, file_path, v ARRAY<DOUBLE>, any others) as a DataFrame: added to, filtered, searched."""

    def __init__(self, rows: DataFrame | None = None):
        self.rows = rows

    def add(self, rows: DataFrame) -> VectorStore:
        """A store that has these rows too; rows of an id that it has take that one's place."""
        if self.rows is None:
            return VectorStore(rows)
        return VectorStore(self.rows.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def chunks_for(self, where: Column) -> DataFrame:
        return self.rows.where(where)

    def search(self, queries: DataFrame, k: int, least: float = 0.0) -> DataFrame:
        """The k rows nearest to each query (id, v), as ``vectors.neighbours`` finds them."""
        return neighbours(self.rows.select("id", "v"), queries.select("id", "v"), k, least, "id", "v")
