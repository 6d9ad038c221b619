"""Registration of queries with the SQL each is held against."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """``@registry.query(sql)`` registers a query under its name; without SQL only its rows are checked."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


#: Fixed value: white space at either end, in RE2's notation.
EDGE = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '{EDGE}', '', 'g')"


def sql_id(c: str) -> str:
    """Trimmed, null if blank."""
    return f"nullif({sql_trim(c)}, '')"


def sql_label(c: str) -> str:
    """Trimmed, lower case, '' if null."""
    return f"lower({sql_trim(f'coalesce({c}, chr(32))')})"


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane and their NFKC forms: one to one, and (common signs only) one to many."""
    one, many = [], []
    for i in range(0x80, 0x10000):
        c, n = chr(i), unicodedata.normalize("NFKC", chr(i))
        if n != c and not 0xD800 <= i < 0xE000:
            if len(n) == 1:
                one.append((c, n))
            elif c in "…‥ﬁﬂﬀﬃﬄ½¼¾№℃™ª":
                many.append((c, n))
    return "".join(c for c, _ in one), "".join(n for _, n in one), many


_FROM, _TO, _MANY = _compatible()


def sql_nfkc(c: str) -> str:
    """NFKC without composing of marks, for the characters that texts have."""
    for x, y in _MANY:
        c = f"replace({c}, '{x}', '{y}')"
    quoted = lambda t: t.replace("'", "''")
    return f"translate({c}, '{quoted(_FROM)}', '{quoted(_TO)}')"


def sql_normal(c: str) -> str:
    """NFKC, lower case, without white space and common punctuation; '' if null."""
    spaced = f"coalesce({c}, chr(32))"
    return rf"regexp_replace(lower({sql_trim(sql_nfkc(spaced))}), '[\s\p{{Z}}，。！？；：、,.!?;:]+', '', 'g')"
