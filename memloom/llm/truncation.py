"""Texts cut off by field limits or in transfer, and how often each source cuts.

Method: structural completeness. A stack automaton reads each text for what is still open at its end: brackets, quotes and
code fences, a broken multibyte sequence, an escape that has begun. A text that closes everything and ends with a
terminator is complete. One without a terminator is held against what its source and the whole corpus do:

* endings that a source's texts share (sign-offs, closing words, tag lines), and share far more often than they hold the same
  word elsewhere, are its own terminators;
* an ending after which sentences and lines end more often than they go on is a complete one that lacks its full stop:
  messages of a chat, titles, sentences that trail off. It is judged by as many of its last words as were seen before, and
  by a ratio, so that a growing corpus makes it surer, not laxer;
* lengths (in characters or in bytes) at which a source's texts without terminator pile up are its field limits, and a
  text of that length stopped there.

All three statistics are counted over all texts, one text once however often it is repeated. Counts are combined within each
Arrow batch and again before the shuffle, so no key is gathered anywhere. Words in running text are counted only where a text
without terminator asks for them: a bit set of fixed size keeps the rest from the shuffle, and the join drops what it lets pass.
Contexts are hashed over whole batches of texts at once, as arrays, so no word is handled on its own.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.staging import stage

#: Marks that a gateway puts where it has cut, or a writer where they trail off.
_MARK = re.compile(r"(?:\[(?:clipped|truncated|cut|more|snip(?:ped)?|continued|…|\.\.\.)\]|\((?:clipped|truncated|cut|more|continued|…|\.\.\.)\)|…|\.{3})$", re.IGNORECASE)
#: Characters that such a mark, or a broken escape, has at most.
_TAIL = 16
#: What ends a text: sentence ends, closing quotes and brackets, fences, pictographs.
_TERMINATOR = re.compile("[.。!?！？»”’\"')\\]}`>｡」』）】☀-➿⬀-⯿\U0001f000-\U0001faff️]$")
#: What no text ends with.
_DANGLING = re.compile(r"[,:;，、：；(\[{（【「『“‘«\\/&@#|=+-]$")
_BROKEN = re.compile("(?:�|[\ud800-\udfff]|\\\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?\\w{1,8}|%[0-9A-Fa-f]?)$")
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»"}
_SIGNS = re.compile("[" + re.escape("".join([*_OPEN, *_OPEN.values()])) + "\"]|</?[A-Za-z][^<>\n]{0,80}>|<[A-Za-z/][^<>\n]{0,80}$")

#: An ending is a source's own if this part of all its texts has it and was not cut at a field limit. Of its texts without
#: terminator alone would not do: where all of those are cut, common words end some of them.
OWN_ENDING = 0.012
#: And that part is so many times the word's part of the places within the source's texts: cuts anywhere fall on common words as
#: often as these stand there.
OWN_TIMES = 3.0
#: A length is a field limit if it has this part of a source's texts without terminator, and as many texts.
LIMIT_SHARE, LIMIT_TEXTS = 0.02, 8
#: An ending is known if, of the places where its longest context of these many words (characters in Chinese) was seen at least
#: SEEN times, this part are ends. Sentences of one opening come first: the same words end an invitation and not a report. Names count as alike where no context was seen; then the name too must end something.
WORDS, CHARS, SEEN, ENDS, NAME_SEEN, NAME_ENDS = (3, 4, 5, 6), (4, 6, 8, 10, 12), 2, 0.3, 3, 0.1
#: Bits of the set of endings asked for.
BITS = 1 << 22


def still_open(text: str) -> bool:
    """Whether the automaton's stack holds something at the end: a bracket, quote or tag of the last line, or a fence.

    Brackets and quotes don't reach over lines in running text, and a fence that closes closes what is in it. So a fence
    is open if their number is odd; else the stack of the last line after the last fence is what is left.
    """
    if _BROKEN.search(text[-_TAIL:]):
        return True
    before, fence, rest = text.rpartition("```")
    if fence and before.count("```") % 2 == 0:
        return True
    stack: list[str] = []
    for m in _SIGNS.finditer(rest[rest.rfind("\n") + 1 :]):
        s = m[0]
        if s[0] == "<":
            if s[-1] != ">":
                return True
        elif s in _OPEN:
            stack.append(_OPEN[s])
        elif stack and stack[-1] == s:
            stack.pop()
        elif s == '"':
            stack.append(s)
    return bool(stack)


# Places -----------------------------------------------------------------------------------------------------------
#
# Tokens and their contexts are found for many texts at once, as arrays: a text is its code points, a token's hash is a difference
# of running sums, a context's a weighted sum of its tokens'. Keys are 64-bit hashes; two that share one would be counted together.

_OTHER, _LETTER, _DIGIT, _HAN = range(4)
_SPACE, _HARD, _TERM, _QUOTE, _SOFT = 1, 2, 4, 8, 16
#: Characters that are read at a time, about.
PIECE_CHARS = 1 << 20
_U, _MASK = np.uint64, (1 << 64) - 1
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_UNBASE = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)
_CARET = _U(0x5851F42D4C957F2D)
_SALTS = {k: _U(0xA24BAED4963EE407 * (i + 1) & (1 << 64) - 1) for i, k in enumerate(("W", "N", "O", "S", "T", *range(2, 13)))}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: kind, lower case, role in breaking sentences, and whether it is a capital."""
    kind, low, role, up = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint64), np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            role[i] = _SPACE
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            kind[i] = _DIGIT if c.isdigit() else _HAN if 0x3400 <= i <= 0x9FFF else _LETTER
            if kind[i] == _DIGIT:
                low[i] = ord("0")
            elif len(c.lower()) == 1:
                low[i] = ord(c.lower())
            up[i] = c.isupper()
    for c in "\n。！？\0":
        role[ord(c)] |= _HARD
    for signs, r in ((".!?", _TERM), ("\"'”’)", _QUOTE), (":]", _SOFT)):
        for c in signs:
            role[ord(c)] |= r
    return kind, low, role, up


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _UNBASE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def hashed(text: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little"))


class Places:
    """All tokens of ``texts``, in order: ``doc``, ``last`` (of its text), ``inside`` (the sentence goes on after it), ``ends`` (a
    sentence ends after it, leaving aside the ends of texts), ``capital``, ``wide``; and keys of any of them.

    Tokens are words in lower case, numbers alike, and single Han characters. Keys: the last word (two Han characters), the two
    words before it, the sentence's opening with the shortest context, and the contexts from the shortest on. Contexts do not reach over the start of the sentence. Labels ("[time] name: ") stand outside of it.
    """

    def __init__(self, texts: list[str]):
        kinds, lows, roles, ups = _tables()
        whole = "\0".join([t.replace("\0", " ") for t in texts]) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        basic = np.minimum(points, 0xFFFF)
        kind = kinds[basic]
        kind[points >= 0x20000] = _HAN
        digit = kind == _DIGIT
        again = np.zeros(len(points), bool)
        again[1:] = digit[1:] & digit[:-1]
        # A sign between two digits belongs to the number.
        kind[1:-1][((points[1:-1] == 0x2E) | (points[1:-1] == 0x2C)) & digit[:-2] & digit[2:]] = _LETTER
        if again.any():  # a number counts as one digit
            keep = ~again
            points, basic, kind = points[keep], basic[keep], kind[keep]
        role = roles[basic]
        value = np.where(points > 0xFFFF, points.astype(np.uint64), lows[basic])
        word = (kind == _LETTER) | (kind == _DIGIT)
        han = kind == _HAN
        before, after = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        start, stop = np.flatnonzero(han | (word & ~before)), np.flatnonzero(han | (word & ~after)) + 1
        n = self.n = len(start)
        up, down = _powers(1 << max(20, int(len(kind)).bit_length()))
        sums = np.zeros(len(kind) + 1, np.uint64)
        np.cumsum(value * up[: len(kind)], out=sums[1:])
        h = _mixed((sums[stop] - sums[start]) * down[start])
        wide = han[start]

        space = np.zeros(len(kind) + 2, bool)
        space[: len(kind)] = (role & _SPACE) > 0
        space[: len(kind)] |= points == 0
        quote = (role & _QUOTE) > 0
        hard = ((role & _HARD) > 0) | (((role & _TERM) > 0) & (space[1:-1] | (np.append(quote[1:], False) & space[2:])))
        soft = ((role & _SOFT) > 0) & space[1:-1]

        def in_gap(flag: np.ndarray) -> np.ndarray:
            seen = np.zeros(len(flag) + 1, np.int32)
            np.cumsum(flag, out=seen[1:])
            nxt = np.append(start[1:], len(flag))
            return seen[nxt] - seen[stop] > 0

        broken, label = in_gap(hard), in_gap(soft)
        texts_before = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(points == 0, out=texts_before[1:])
        self.doc = texts_before[start]
        self.last = np.append(self.doc[1:] != self.doc[:-1], True)[:n] if n else np.zeros(0, bool)
        self.ends, self.inside = broken & ~self.last, ~broken & ~label & ~self.last
        self.capital = ups[np.minimum(points[start], 0xFFFF)] if n else np.zeros(0, bool)

        fresh = np.ones(n, bool)
        fresh[1:] = (broken | label | self.last)[:-1]
        index = np.arange(n)
        self._first = np.maximum.accumulate(np.where(fresh, index, 0)) if n else index
        self.place, self.wide, self._h = index - self._first, wide, h

    def _back(self, k: int, rows: np.ndarray) -> np.ndarray:
        """What stands ``k`` tokens before: a token, the start of the sentence once, and then nothing."""
        p = self.place[rows]
        return np.where(p >= k, self._h[np.maximum(rows - k, 0)], np.where(p == k - 1, _CARET, _U(0)))

    def words(self, rows: np.ndarray) -> np.ndarray:
        before = np.where(self.wide[rows] & (self.place[rows] > 0), self._h[np.maximum(rows - 1, 0)], _U(0))
        return _mixed(self._h[rows] + before * _STEP + _SALTS["W"])

    def names(self, rows: np.ndarray) -> np.ndarray:
        return _mixed(self._back(1, rows) + self._back(2, rows) * _STEP + _SALTS["N"])

    def contexts(self, rows: np.ndarray, sizes: tuple[int, ...], keep: Callable[[np.ndarray], np.ndarray] = lambda keys: np.ones(len(keys), bool)) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """(slot, keys, rows) for the contexts of ``rows`` from the shortest on, and for the opening with the shortest one. Longer
        ones are formed where ``keep`` holds of the key before, and the context before did not reach the sentence's start."""
        total, weight, reached = self._h[rows].copy(), _STEP, 1
        for j, size in enumerate(sizes):
            while reached < size:
                total += self._back(reached, rows) * weight
                weight, reached = _U(int(weight) * int(_STEP) & _MASK), reached + 1
            keys = _mixed(total + _SALTS[size])
            yield j, keys, rows
            hit = keep(keys)
            if not j:
                first = self._first[rows[hit]]
                opening = self._h[first] + np.where(self.wide[first], self._h[np.minimum(first + 1, self.n - 1)] * _STEP, _U(0))
                yield "O", _mixed(opening * _BASE + total[hit] + _SALTS["O"]), rows[hit]
            hit &= self.place[rows] + 1 >= size
            rows, total = rows[hit], total[hit]


def _pieces_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about PIECE_CHARS characters; a longer text is a range of its own, read whole."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def ending_keys(texts: list[str]) -> list[list[int]]:
    """What the end of each text is known by: its last word, that after which a name stands (0 if none does), the opening
    with the shortest context, and the contexts from the longest on. Texts without any token have no keys."""
    out: list[list[int]] = [[] for _ in texts]
    for a, b in _pieces_of(texts):
        p = Places(texts[a:b])
        at = np.flatnonzero(p.last)
        named = p.capital[at] & (p.place[at] >= 1) & ~p.wide[at]
        names = np.where(named, p.names(at), _U(0))
        for doc, word, name in zip(p.doc[at].tolist(), p.words(at).view(np.int64).tolist(), names.view(np.int64).tolist()):
            out[a + doc] = [word, name, 0]
        for wide, sizes in ((False, WORDS), (True, CHARS)):
            for slot, keys, rows in p.contexts(at[p.wide[at] == wide], sizes):
                for doc, k in zip(p.doc[rows].tolist(), keys.view(np.int64).tolist()):
                    if slot == "O":
                        out[a + doc][2] = k
                    else:
                        out[a + doc].insert(3, k)
    return out


def count_places(texts: list[str], whole: np.ndarray, sources: np.ndarray, first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how often a sentence ends there, how often it goes on), for the keys whose bit is set in ``asked``.

    ``whole``: whether the text's end is that of a sentence; the end of another says nothing. ``sources``: hashes of the
    texts' sources, for which last words are counted too; ``first``: whether the text counts for the corpus, not only its source.
    """
    found, ended = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    totals: dict[int, int] = {}

    def hits(keys: np.ndarray) -> np.ndarray:
        return asked[(keys & _U(BITS - 1)).view(np.int64)]

    for a, b in _pieces_of(texts):
        p = Places(texts[a:b])
        end = p.ends | (p.last & whole[a:b][p.doc])

        def add(keys: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
            found.append(keys[chosen])
            ended.append(end[rows[chosen]])

        known = np.flatnonzero(end | p.inside)
        corpus = first[a:b][p.doc]
        words = p.words(known)
        hit = hits(words)
        words, at = words[hit], known[hit]
        add(words, at, corpus[at])
        # Within the sources: places in running text only.
        inner = p.inside[at]
        words, at = words[inner], at[inner]
        keys = source_keys(words, sources[a:b][p.doc[at]])[0]
        add(keys, at, hits(keys))
        for s, c in zip(*np.unique(sources[a:b][p.doc[p.inside]], return_counts=True)):
            totals[int(s)] = totals.get(int(s), 0) + int(c)
        known = known[corpus[known]]
        rows = known[(p.place[known] >= 1) & ~p.wide[known]]
        keys = p.names(rows)
        add(keys, rows, hits(keys))
        for wide, sizes in ((False, WORDS), (True, CHARS)):
            for _, keys, rows in p.contexts(known[p.wide[known] == wide], sizes, hits):
                add(keys, rows, hits(keys))
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    every = np.bincount(at, minlength=len(keys))
    ends = np.bincount(at, weights=np.concatenate(ended), minlength=len(keys)).astype(np.int64)
    t = np.array(list(totals), np.uint64)
    keys = np.concatenate([keys, _mixed(t + _SALTS["T"])])
    return keys.view(np.int64), np.concatenate([ends, np.zeros(len(t), np.int64)]), np.concatenate([every - ends, np.array(list(totals.values()), np.int64)]).astype(np.int64)


def source_keys(word: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of last words within their sources, and of all places of those."""
    return _mixed(word + source * _STEP + _SALTS["S"]), _mixed(source + _SALTS["T"])


#: Characters by which an announced length may differ from that of a whole text (parameter of ``inspect``).
LOOSE = 5


def _base(text: str) -> str:
    """``text`` without the marks of a cut and the white space around them."""
    text = text.rstrip()
    while mark := _MARK.search(text[-_TAIL:]):
        dots = mark[0] == "..."
        text = text[: len(text) - len(mark[0])]
        text = (text.rstrip(".") if dots else text).rstrip()
    return text


def _whole(base: str, open_end: bool) -> bool:
    return not open_end and _TERMINATOR.match(base[-1:]) is not None


def _endings(documents: DataFrame, key: str, text: str, source: str, declared: str | None) -> DataFrame:
    kind = dict(documents.dtypes)[key]
    fields = f"`{key}` {kind}, source string, same long, chars int, bytes int, lacking long, complete boolean, broken boolean, keys array<long>, within long, places long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases = [_base(t) for t in batch[text]]
            batch, bases = batch[[bool(b) for b in bases]], [b for b in bases if b]
            opened = [still_open(b) for b in bases]
            done = [_whole(b, o) for b, o in zip(bases, opened)]
            keys: list[list[int] | None] = [None] * len(bases)
            loose = [i for i, d in enumerate(done) if not d]
            found = ending_keys([bases[i] for i in loose])
            named = {s: hashed(s) for s in batch["source"].unique()}
            words = np.array([k[0] if k else 0 for k in found], np.int64).view(np.uint64)
            inner, places = source_keys(words, np.array([named[batch["source"].iat[i]] for i in loose], np.uint64))
            within, all_places = np.zeros(len(bases), np.int64), np.zeros(len(bases), np.int64)
            within[loose], all_places[loose] = inner.view(np.int64), places.view(np.int64)
            for i, k in zip(loose, found):
                keys[i] = k
            yield pd.DataFrame({
                key: batch[key].to_numpy(), "source": batch["source"].to_numpy(), "same": batch["same"].to_numpy(), "chars": [len(b) for b in bases], "bytes": [len(b.encode("utf-8", "replace")) for b in bases],
                "lacking": batch["lacking"].astype("Int64"), "complete": done, "broken": [not d and (o or _DANGLING.match(b[-1:]) is not None) for d, o, b in zip(done, opened, bases)],
                "keys": keys, "within": within, "places": all_places,
            })

    lacking = (F.col(declared) - F.length(text)).cast("long") if declared else F.lit(None).cast("long")
    chosen = documents.where(F.col(text).isNotNull()).select(key, text, F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(text).alias("same"), lacking.alias("lacking"))
    return chosen.mapInPandas(run, fields)


def _asked_bits(asked: DataFrame) -> bytes:
    """The set of the ``ending``s asked for, as BITS bits: it may let others pass, it holds back none."""
    bit = F.expr(f"ending & {BITS - 1}L")
    words = asked.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(BITS // 64, dtype="<i8")
    for r in words.collect():
        out[r.word] = r.bits
    return out.tobytes()


def _places(documents: DataFrame, key: str, text: str, once: DataFrame, bits: bytes) -> DataFrame:
    """How often each ending asked for stands at the end of a sentence and within one, over the texts of ``once``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            named = {s: hashed(s) for s in batch["source"].unique()}
            sources = np.array([named[s] for s in batch["source"]], np.uint64)
            keys, ends, inside = count_places([_base(t) for t in batch[text]], batch["complete"].to_numpy(bool), sources, batch["first"].to_numpy(bool), asked)
            yield pd.DataFrame({"ending": keys, "ends": ends, "inside": inside})

    counted = documents.select(key, text).join(once, key).select(F.col(text), "complete", "source", "first").mapInPandas(run, "ending long, ends long, inside long")
    return counted.groupBy("ending").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))


def inspect(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", declared: str | None = None) -> DataFrame:
    """One row for each text that isn't complete at sight: ``key``, source, truncated, and what speaks for it.

    Texts that are null, or have nothing but white space and marks, were not cut in mid-sentence; they have no row.
    A null source is a source of its own. ``declared`` may name a column with the length the sender announced: it settles
    texts without terminator whose end is not broken or open, being more than LOOSE characters short or not. Where it is null, the
    statistics decide.
    """
    texts = stage(_endings(documents, key, text, source, declared))
    loose = texts.where("not complete").select(key, "source", "same", "chars", "bytes", "lacking", "broken", "keys", F.get("keys", F.lit(0)).alias("last"), "within", "places")

    # What a source's texts without terminator share; copies of a text count once.
    once = loose.groupBy("source", "same").agg(*[F.first(c).alias(c) for c in ("chars", "bytes", "last", "within", "places")])
    total = once.groupBy("source").agg(F.count("*").alias("loose"))
    by_source = texts.groupBy("source", "same").agg(F.min(key).alias(key), F.max("complete").alias("complete"))
    whole = by_source.groupBy("source").agg(F.count("*").alias("every"))
    lengths = once.select("source", "last", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x"))
    # A cut leaves many endings at one length; texts from one template have one.
    by_last = lengths.groupBy("source", "x.unit", "x.size", "last").agg(F.count("*").alias("m"))
    piled = by_last.groupBy("source", "unit", "size").agg(F.sum("m").alias("m"), F.max("m").alias("most")).where("most <= 0.5 * m").join(total, "source").where((F.col("m") >= LIMIT_TEXTS) & (F.col("m") >= LIMIT_SHARE * F.col("loose")))
    # At most 1 / LIMIT_SHARE lengths a source and unit.
    limits = piled.groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("size"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("size"))).alias("byte_limits"))

    near = lambda limits, size: F.coalesce(F.exists(limits, lambda x: (F.col(size) <= x) & (F.col(size) >= x - 3)), F.lit(False))
    at_limit = near(F.col("char_limits"), "chars") | near(F.col("byte_limits"), "bytes")

    # Endings that a source has often, at most 1 / OWN_ENDING of them.
    own = once.join(limits, "source", "left").where(~at_limit & F.col("last").isNotNull()).groupBy("source", "last").agg(F.count("*").alias("own"), F.first("within").alias("within"), F.first("places").alias("places"))
    own = stage(own.join(whole, "source").withColumn("share", F.col("own") / F.col("every")).where((F.col("share") >= OWN_ENDING) & (F.col("own") >= LIMIT_TEXTS)))

    # The last word matters where it may be a name, and where it may be a source's own ending.
    asked = loose.select(key, F.posexplode("keys").alias("slot", "ending"), (F.get("keys", F.lit(1)) != 0).alias("named")).where("ending != 0 and (slot > 0 or named)").drop("named")
    bits = _asked_bits(asked.select("ending").unionByName(own.select(F.explode(F.array("last", "within")).alias("ending"))))
    first = by_source.groupBy("same").agg(F.min(key).alias("_first"))
    once_read = by_source.join(first, "same").select("source", key, "complete", (F.col(key) == F.col("_first")).alias("first"))
    counts = stage(_places(documents, key, text, once_read, bits))
    ratio = F.col("ends") / (F.col("ends") + F.col("inside"))

    # The part of the places within the source's texts that have the same word.
    own = own.join(counts.select(F.col("ending").alias("within"), F.col("inside").alias("here")), "within", "left").join(counts.select(F.col("ending").alias("places"), F.col("inside").alias("every_place")), "places", "left")
    own = own.where(F.col("share") >= OWN_TIMES * F.coalesce(F.col("here") / F.col("every_place"), F.lit(0.0))).select("source", "last", F.lit(True).alias("own_ending"))

    # Slots: the last word, the name, the contexts.
    known = asked.join(counts.select("ending", (F.col("ends") + F.col("inside")).alias("seen"), ratio.alias("ratio")), "ending")
    counted = known.groupBy(key).agg(
        F.max(F.when(F.col("slot") == 0, F.col("ratio"))).alias("last_ratio"),
        F.max(F.when((F.col("slot") == 1) & (F.col("seen") >= NAME_SEEN), F.col("ratio"))).alias("name_ratio"),
        F.min_by("ratio", F.when((F.col("slot") > 1) & (F.col("seen") >= SEEN), F.col("slot"))).alias("context_ratio"),
    )
    by_name = (F.col("name_ratio") >= ENDS) & (F.col("last_ratio") >= NAME_ENDS)
    ended = F.coalesce(F.col("context_ratio") >= ENDS, by_name, F.lit(False))
    own_ending = F.coalesce("own_ending", F.lit(False))
    joined = loose.join(counted, key, "left").join(own, ["source", "last"], "left").join(limits, "source", "left")
    by_ending = F.col("broken") | (at_limit & ~own_ending) | ~(own_ending | ended)
    return joined.select(
        key,
        "source",
        (F.col("broken") | F.coalesce(F.col("lacking") > LOOSE, by_ending)).alias("truncated"),
        F.col("broken").alias("left_open"),
        at_limit.alias("at_limit"),
        own_ending.alias("own_ending"),
        ended.alias("known_ending"),
    )


def shares(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", declared: str | None = None) -> DataFrame:
    """Texts and truncated texts by source, with their share."""
    cut = inspect(documents, key, text, source, declared).where("truncated").groupBy("source").agg(F.count("*").alias("truncated"))
    every = documents.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("texts"))
    return every.join(cut, "source", "left").select("source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("texts")).alias("share"))
