"""What a question asks for: search text, hints, times; and the expressions that score and order relation paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.times import CALENDAR
from memloom.functions.values import casefold, nfkc

#: Phrases that say nothing of what is searched, in this order.
STOP_PHRASES = (
    "我", "用户", "现在", "目前", "如今", "以前", "过去", "曾经", "计划", "打算", "一共", "多少次", "几次", "哪些", "哪里", "哪儿", "叫什么",
    "叫啥", "是什么", "为什么", "什么", "怎么", "为何", "多少", "的记忆", "相关记忆", "关于", "告诉", "回忆", "吗", "呢", "了", "的",
)


def search_text(c: Column | str) -> Column:
    """A question without calendar expressions, stop phrases, white space and punctuation; NFKC and lower case."""
    text = F.regexp_replace(F.lower(nfkc(c)), CALENDAR, "")
    for phrase in STOP_PHRASES:
        text = F.replace(text, F.lit(phrase))
    return F.regexp_replace(text, r"[\s，。！？；：、,.!?;:]+", "")


def hint_fragments(c: Column | str, limit: int = 64) -> Column:
    """A hint, unless it is a single Han character, and its Han fragments of two to four characters, shortest first, run by run."""
    value = casefold(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    whole = F.when((value != "") & ~value.rlike("^[㐀-鿿]$"), F.array(value)).otherwise(F.array().cast("array<string>"))

    def of_run(run: Column) -> Column:
        chars = F.regexp_extract_all(run, F.lit("."), F.lit(0))
        found = []
        last = chars
        for k in range(1, 4):
            last = F.filter(F.zip_with(last, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda x, y: F.concat(x, y)), lambda x: x.isNotNull())
            found.append(last)
        return F.concat(*found)

    runs = F.regexp_extract_all(value, F.lit("[㐀-鿿]{2,}"), F.lit(0))
    fragments = F.when(F.size(runs) > 0, F.flatten(F.transform(runs, of_run))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(whole, fragments)), 1, limit)


def relation_score(rank: Column, count: Column, *, hints: Column, hint_match: Column, reranked: Column, hard_type: Column, suggested: Column, suggested_match: Column) -> Column:
    """Rank score 1 - rank / (2 n); at most 0.2 where only adjacency speaks for the edge, or its type is another than suggested."""
    base = F.round(1 - rank / (2 * count), 6)
    low = F.least(base, F.lit(0.2))
    return F.when(hard_type | reranked, base).when(suggested, F.when(suggested_match, base).otherwise(low)).when(~hints | hint_match, base).otherwise(low)


def exploration_order(hops: Column, last_type: Column, edges: Column, wanted_hops: int | None = None, wanted_types: Sequence[str] = ()) -> list[Column]:
    """Sort columns of explored paths: another number of hops than wanted, another last type, length if none was wanted, edge ids."""
    off = F.lit(0) if wanted_hops is None else (hops != wanted_hops).cast("int")
    terminal = (~F.coalesce(last_type.isin(*wanted_types), F.lit(False))).cast("int") if wanted_types else F.lit(0)
    return [off, terminal, hops if wanted_hops is None else F.lit(0), F.array_join(edges, "|")]


def text_spans(df: DataFrame, key: str, text: str, most: int = 1200, overlap: int = 160) -> DataFrame:
    """(key, start, end) of the windows of each text: up to ``most`` code points, cut after the last white space of the latter half
    if there is one, each starting ``overlap`` before the one before it ends. Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                start, size = 0, len(t)
                while start < size:
                    end = min(start + most, size)
                    if end < size:
                        low = start + max(1, most // 2)
                        at = next((i for i in range(end - 1, low - 1, -1) if t[i].isspace()), None)
                        end = end if at is None else at + 1
                    rows.append((k, start, end))
                    if end == size:
                        break
                    start = max(start + 1, end - overlap)
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    return df.where(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, start int, end int")


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of ``name`` in ``namespace`` (its 32 hexadecimal digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def bounded_phrase(c: Column, most: int) -> Column:
    """White space collapsed, unprintable characters dropped, cut to ``most`` characters."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x{85}]+", " "))
    return F.substring(F.regexp_replace(plain, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""), 1, most)


def episode_name(ident: Column, fingerprint: Column, version: Column) -> Column:
    """Name under which a record is indexed: its id in URL-safe base64, its fingerprint and version."""
    encoded = F.rtrim(F.translate(F.base64(F.encode(ident, "utf-8")), "+/=\r\n", "-_"))
    return F.concat_ws(":", F.lit("episode"), F.lit("v5"), encoded, fingerprint, version.cast("string"))


def episode_parts(name: Column) -> Column:
    """Struct (ident, fingerprint, version) of an episode's name; null if it is none."""
    parts = F.split(name, ":")
    encoded = F.translate(F.get(parts, F.lit(2)), "-_", "+/")
    padded = F.rpad(encoded, (F.ceil(F.length(encoded) / 4) * 4).cast("int"), F.lit("="))
    ident = F.decode(F.unbase64(padded), "utf-8")
    fine = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "episode") & (F.get(parts, F.lit(1)) == "v5")
    return F.when(fine, F.struct(ident.alias("ident"), F.get(parts, F.lit(3)).alias("fingerprint"), F.get(parts, F.lit(4)).cast("int").alias("version")))


def swap_terms(text: Column, terms: dict[str, str]) -> Column:
    """Every key of ``terms`` replaced by its value, all at once: what one replacement puts in, no other changes. Longer keys first."""
    for i, x in enumerate(sorted(terms, key=lambda x: (-len(x), x))):
        text = F.replace(text, F.lit(x), F.lit(chr(0xE000 + i)))
    for i, x in enumerate(sorted(terms, key=lambda x: (-len(x), x))):
        text = F.replace(text, F.lit(chr(0xE000 + i)), F.lit(terms[x]))
    return text
