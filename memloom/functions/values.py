"""Normalization of roles, authorities, kinds, statuses and texts, as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.keys import trimmed

#: Fixed values.
ROLE_ALIASES = {"human_self": "owner", "peer": "contact", "internal": "system"}
AUTHORITY_OF_ROLE = {"owner": "human_self", "contact": "peer_statement", "agent": "agent_output"}
STATUS_ALIASES = {"present": "current", "future": "planned", "past": "historical", "history": "historical"}
ACTIVE_STATES = ("candidate", "confirmed")
NORMAL_DROP = r"[\s，。！？；：、,.!?;:]+"
GRAM_DROP = r"[^0-9a-z㐀-鿿]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c: Column | str) -> Column:
    """Trimmed, lower case; '' if null."""
    return F.lower(trimmed(F.coalesce(_col(c), F.lit(""))))


def mapped(c: Column, values: Mapping[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def role(c: Column | str) -> Column:
    value = label(c)
    return mapped(value, ROLE_ALIASES, F.when(value == "", "system").otherwise(value))


def authority(role_: Column) -> Column:
    return mapped(role_, AUTHORITY_OF_ROLE, F.lit("derived_summary"))


def kind(c: Column | str) -> Column:
    value = label(c)
    return F.substring(F.when(value == "", "event").otherwise(value), 1, 64)


def temporal_status(c: Column | str) -> Column:
    value = label(c)
    return F.substring(mapped(value, STATUS_ALIASES, F.when(value == "", "unknown").otherwise(value)), 1, 64)


def revision_kind(c: Column | str) -> Column:
    """Null where the value is none of the three."""
    value = label(c)
    value = F.when(value == "", "assertion").otherwise(value)
    return F.when(value.isin("assertion", "correction", "retraction"), value)


def nfkc(c: Column | str) -> Column:
    """NFKC form, from the ICU library that Spark brings along; texts in ASCII are in it already and cost nothing.

    Spark takes a call by reflection for nondeterministic: use it in a projection, not in a grouping or an aggregate.
    """
    c = _col(c)
    return F.when(c.isNull() | (F.length(c) == F.octet_length(c)), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def casefold(c: Column | str) -> Column:
    """Full case folding (ß to ss, final sigma and so on)."""
    c = _col(c)
    return F.when(c.isNull() | (F.length(c) == F.octet_length(c)), F.lower(c)).otherwise(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def normal_text(c: Column | str) -> Column:
    """NFKC, lower case, without white space and common punctuation; '' if null."""
    return F.regexp_replace(label(nfkc(c)), NORMAL_DROP, "")


def scope_key(scope: Mapping[str, Column], extra: Column) -> Column:
    """'dpl_' and the SHA-256 of the scope's JSON with sorted keys."""
    sorted_extra = F.map_from_entries(F.array_sort(F.map_entries(extra)))
    fields = {"agent_id": scope["agent"], "chat_id": scope["chat_id"], "chat_type": scope["chat_type"], "extra_dimensions": sorted_extra, "platform": scope["platform"], "user_id": scope["user"]}
    return F.concat(F.lit("dpl_"), F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), 256))


def subset(wanted: Sequence[str], tags: Column) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.coalesce(tags, F.array()))) == 0


# Character n-grams -----------------------------------------------------------------------------------------------


def grams(c: Column | str, size: int) -> Column:
    """All n-grams of the compacted text, with repeats."""
    # Split once and put neighbours together: taking each n-gram out of the text would read it from the start every time.
    text = F.regexp_replace(_col(c), GRAM_DROP, "")
    chars = F.regexp_extract_all(text, F.lit("."), F.lit(0))
    out = chars
    for k in range(1, size):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - k, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.filter(out, lambda x: x.isNotNull())


def lexical_tokens(c: Column | str) -> Column:
    """Word tokens 'w:' and Han characters and pairs 'h:' of a text in NFKC and folded case, with repeats; underscores separate."""
    folded = casefold(nfkc(c))
    words = F.regexp_extract_all(folded, F.lit(r"(?U)[^\W_㐀-䶿一-鿿]+"), F.lit(0))
    runs = F.regexp_extract_all(folded, F.lit("[㐀-䶿一-鿿]+"), F.lit(0))

    def han(run: Column) -> Column:
        # A run is split once; taking each character out of it would read it from the start every time.
        chars = F.regexp_extract_all(run, F.lit("."), F.lit(0))
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars)), lambda x, y: F.concat(F.lit("h:"), x, y))
        return F.concat(F.transform(chars, lambda x: F.concat(F.lit("h:"), x)), F.filter(pairs, lambda x: x.isNotNull()))

    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.when(F.size(runs) > 0, F.flatten(F.transform(runs, han))).otherwise(F.array().cast("array<string>")))
