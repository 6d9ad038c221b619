"""Extension points, and deterministic offline implementations of them.

A provider maps DataFrames or columns, never single rows: models behind it get Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding)"""


class EvidenceVerifier(Protocol):
    def verdict(self, claim: Column, cited: Column) -> Column:
        """supported, unsupported or unassessed"""


class HashEmbedding:
    """Signed hashing of words into a unit vector; the same text has the same vector everywhere."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def vector(self, text: str) -> np.ndarray:
        v = np.zeros(self.dimension)
        for w in text.lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            v[h % self.dimension] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({key: b[key], "embedding": [self.vector(t).astype("float32") for t in b[text]]})

        return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


class QuotedEvidence:
    """A claim that says something and cites something counts as supported; one that cites nothing is not assessed."""

    def verdict(self, claim: Column, cited: Column) -> Column:
        return F.when(claim == "", "unsupported").when(cited <= 0, "unassessed").otherwise("supported")


class MemoryAnalyzer(Protocol):
    def drafts(self, messages: DataFrame, text: str) -> DataFrame:
        """``messages`` with memory_type, content and confidence, a row a draft"""


class RuleAnalyzer:
    """Drafts from a few turns of speech: what someone prefers, plans or has promised. An offline stand-in for a model."""

    #: Memory type, confidence, and what leads to the content.
    RULES = (
        ("preference", 0.9, r"(?i)(?:would rather|prefiere|prefers?) ([^.!?。]+)"),
        ("plan", 0.8, r"(?i)(?:let's|want to|wollen|打算) ?([^.!?。]+)"),
        ("commitment", 0.7, r"(?i)(?:promised to|答应把) ?([^.!?。]+)"),
    )

    def drafts(self, messages: DataFrame, text: str) -> DataFrame:
        each = [F.struct(F.lit(kind).alias("memory_type"), F.nullif(F.regexp_extract(text, rule, 1), F.lit("")).alias("content"), F.lit(sure).alias("confidence")) for kind, sure, rule in self.RULES]
        return messages.select("*", F.explode(F.filter(F.array(*each), lambda x: x.content.isNotNull())).alias("_d")).select(*messages.columns, "_d.*")


class Reranker(Protocol):
    def order(self, df: DataFrame, query: str) -> list[Column]:
        """Sort columns by which the candidates of each ``query`` are put in order; the place they had comes last."""


class ByColumn:
    """Reranks by a column, the greatest first; what has none keeps its order behind the others."""

    def __init__(self, column: str):
        self.column = column

    def order(self, df: DataFrame, query: str) -> list[Column]:
        return [F.desc_nulls_last(self.column)]


def rerank(df: DataFrame, reranker: Reranker, query: str, rank: str = "rank") -> DataFrame:
    """``df`` with the position that ``reranker`` gives each candidate; ties keep the order of ``rank``."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*reranker.order(df, query), rank)))
