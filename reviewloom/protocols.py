"""Seams for what the library doesn't do itself: each has an offline default elsewhere in the package."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class LanguageId(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Embedder(Protocol):
    def __call__(self, df: DataFrame, key: str, text: str, dim: int) -> DataFrame: ...


class Clusterer(Protocol):
    """(chunk_id, review_id, label) of VECTOR rows, -1 for outliers."""

    def __call__(self, vectors: DataFrame) -> DataFrame: ...


class TextGenerator(Protocol):
    """Called on the driver with aggregated prompts only; review text goes into ``user``, never into ``system``."""

    def __call__(self, system: str, user: str) -> str: ...


class Delivery(Protocol):
    def send(self, subject: str, html: str, recipients: list[str]) -> bool: ...
