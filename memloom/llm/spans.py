"""Splitting oversized texts at natural boundaries, with overlap.

Method: bounded-quantifier regular expressions. Each match takes up to the limit, from alternatives ordered by the
strength of the boundary they end at: the end of the text, a blank line, a line end, a sentence end, a clause end, white
space, a place between whole characters as a reader sees them, and at last any code point. A boundary that leaves a piece at
least half full comes before one that doesn't, and any boundary before a cut between characters. The matches follow each other without a hole; what consecutive pieces share is
supplied by starting each piece that many characters before its match.

All of it is built-in expressions: code points are counted as Spark and java.util.regex count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand right before a cut, strongest first.
BOUNDARIES = (
    r"(?<=\n[ \t]{0,8}\n)",
    r"(?<=\n)",
    r"(?<=[.!?…][\"'”’)\]]?\s)|(?<=[。！？；][”’」』）]?)(?![”’」』）。！？])",
    r"(?<=[,;:，、：—]\s)|(?<=[，、：])",
    r"(?<=\s)(?!\s)",
)
#: Fixed value: characters that belong to the one before them (marks, joiners, variation selectors, skin tones).
NO_BREAK_BEFORE = r"(?![\p{M}\x{200d}\x{fe00}-\x{fe0f}\x{1f3fb}-\x{1f3ff}])(?<!\x{200d})"


def pattern(fresh: int) -> str:
    """Matches the next stretch of 1 to ``fresh`` code points."""
    half = (fresh + 1) // 2
    late, early = ((rf".{{{half},{fresh}}}(?:{b})" for b in BOUNDARIES), (rf".{{1,{half - 1}}}(?:{b})" for b in BOUNDARIES if half > 1))
    ways = [rf".{{1,{fresh}}}\z", *late, *early, rf".{{{half},{fresh}}}{NO_BREAK_BEFORE}", rf".{{1,{fresh}}}"]
    return f"(?s)(?:{'|'.join(ways)})"


def pieces(text: Column, max_chars: int, overlap_chars: int) -> Column:
    """Array of structs (start, end, text) over code points of ``text``; null if the text is within ``max_chars``.

    Pieces have at most ``max_chars`` code points, cover the text in order, and each starts exactly ``overlap_chars``
    before the one before it ends (or at 0). Null and empty texts have no pieces.
    """
    if max_chars < 1 or not 0 <= overlap_chars < max_chars:
        raise ValueError(f"max_chars {max_chars}, overlap_chars {overlap_chars}: 0 <= overlap_chars < max_chars is required")
    matched = F.regexp_extract_all(text, F.lit(pattern(max_chars - overlap_chars)), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, piece: Column) -> Column:
        end = acc.at + F.length(piece)
        one = F.struct(F.greatest(F.lit(0), acc.at - overlap_chars).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc.found, F.array(one)).alias("found"))

    offsets = F.aggregate(matched, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda acc: acc.found)
    cut = F.transform(offsets, lambda o: F.struct(o.start.alias("start"), o.end.alias("end"), F.substring(text, o.start + 1, o.end - o.start).alias("text")))
    return F.when(F.length(text) > max_chars, cut)


def split_oversized(df: DataFrame, text: str, configs: list[tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """The pieces of every text that exceeds a configuration's limit.

    ``configs``: (config_id, max_chars, overlap_chars). Columns: config_id, ``keys``, pieces. One pass over the
    table serves all configurations; each pattern is a constant, compiled once a task. Null, empty and short texts have no
    rows; repeated rows each have theirs; columns that are not in ``keys`` are left out.
    """
    each = [F.struct(F.lit(c).alias("config_id"), pieces(F.col(text), m, o).alias("pieces")) for c, m, o in configs]
    found = df.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x.pieces.isNotNull())).alias("_x"))
    return found.select("_x.config_id", *keys, "_x.pieces")
