"""Evaluation texts leaking into training text.

Method: a distributed positional inverted index. Texts become tokens without case, punctuation, spacing and escaping: words,
and single characters in Chinese. The index holds the postings (term, document, position) of every training text; terms are
pairs of adjacent tokens, and terms that no test item has are not stored, as nothing asks for them. Document frequencies
over all texts tell each item's rarest terms. From those, postings are joined with the item's own positions and
intersected by offset: matches of one passage lie at the same offset, or nearly so where words were added or lost.
Pairs of document and item that can still hold half of the item go to an exact comparison of positions, which finds the
runs, their changed words and their order.

The item side is a stated query set, taken in blocks of bounded text, which are broadcast. The corpus side is never grouped by term, so a
term in a third of all texts makes no large task.
"""

from __future__ import annotations

import heapq
import html
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.staging import stage

_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbf]|%([0-9a-fA-F]{2}(?:%[0-9a-fA-F]{2})*)|<[^<>]{1,40}>|[­​-‏⁠﻿]|(?<=\w)-\n(?=\w)")


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    if m[3]:
        return bytes.fromhex(m[3].replace("%", "")).decode("utf-8", "replace")
    return "" if m[0][0] in "­​‌‍‎‏⁠﻿-" else " "


def tokens(text: str) -> list[str]:
    """Words, and single Han characters, without case, punctuation, spacing, escapes and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    text = _ESCAPES.sub(_unescape, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text.casefold())


def needed(n: int) -> int:
    """Terms (token pairs) that a text must share with an item of ``n`` tokens to be able to hold half of it.

    Half of the item is m = n / 2 tokens in at most MAX_RUNS runs, m / 8 of them changed. A run of k tokens has k - 1 pairs,
    a changed token spoils two.
    """
    return max(2, int(np.floor(n / 2 - MAX_RUNS - 2 * n / 16)))


#: Runs that a leaked passage may be in; the shortest run in words and in characters; tokens between two parts of one run.
MAX_RUNS, MIN_WORDS, MIN_CHARS, MAX_HOLE = 4, 6, 10, 3
#: Part of an item that must be held, and of the held part that may be changed.
HELD, CHANGED = 0.5, 1 / 8
#: Of the pairs looked up, the rarest, so many are sure to be in a text that holds half of the item.
SURE = 4
#: Offsets that count together.
BAND = 8
#: Characters of items that are looked for at once (parameter of ``find``).
BLOCK_CHARS = 4_000_000


class Item:
    """A test item's tokens; its terms are numbered through all items."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.tokens = item_id, tokens(text)
        self.n = len(self.tokens)
        self.wide = sum("㐀" <= t <= "鿿" or "豈" <= t <= "﫿" for t in self.tokens) * 2 > self.n
        self.pairs = list(zip(self.tokens, self.tokens[1:]))


def index(documents: DataFrame, vocabulary: dict[tuple[str, str], int], least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings by document: ``key``, terms, positions (arrays in order). Texts with fewer than ``least`` are left out: they can hold no item."""
    words = frozenset(w for w, _ in vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for batch in batches:
            keys, terms, places = [], [], []
            for k, t in zip(batch[key], batch[text]):
                found = tokens(t)
                at = [(p, i) for i, w in enumerate(found[:-1]) if w in words and (p := get((w, found[i + 1]))) is not None]
                if len(at) >= least:
                    keys.append(k)
                    terms.append([p for p, _ in at])
                    places.append([i for _, i in at])
            if keys:
                yield pd.DataFrame({key: keys, "terms": terms, "positions": places})

    kind = dict(documents.dtypes)[key]
    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, terms array<int>, positions array<int>")


def held(item: Item, at: dict[tuple[str, str], int], terms: np.ndarray, positions: np.ndarray) -> tuple[int, int, int]:
    """(tokens of the item held, of these changed, runs) of the best chain of long runs; (0, 0, 0) if there is none."""
    where: dict[int, list[int]] = {}
    for q, pair in enumerate(item.pairs):
        where.setdefault(at[pair], []).append(q)
    hits = [(q, p) for t, p in zip(terms.tolist(), positions.tolist()) for q in where.get(t, ())]
    if len({q for q, _ in hits}) < needed(item.n):
        return 0, 0, 0
    # Exact stretches: hits that follow each other on one diagonal; [q0, q1) of the item at p0 of the text.
    hits.sort(key=lambda h: (h[1] - h[0], h[0]))
    exact: list[list[int]] = []
    for q, p in hits:
        if exact and exact[-1][2] - exact[-1][0] == p - q and q <= exact[-1][1]:
            exact[-1][1] = q + 2
        else:
            exact.append([q, q + 2, p])
    # Runs: stretches joined over short holes, on the same or a near diagonal. Only what ends right before a stretch, in item and
    # text, can be joined with it, so each looks at a fixed number of places however many stretches there are.
    exact.sort()
    best: list[tuple[int, int, int]] = []  # matched, start q, start p
    by_end: dict[tuple[int, int], int] = {}
    holes = range(-1, MAX_HOLE + 1)
    for j, (q0, q1, p0) in enumerate(exact):
        top = (q1 - q0, q0, p0)
        for hole_q in holes:
            for hole_p in holes:
                i = by_end.get((q0 - hole_q, p0 - hole_p))
                if i is not None:
                    matched = best[i][0] + q1 - max(q0, exact[i][1])
                    span = q1 - best[i][1]
                    if matched > top[0] and span - matched <= max(2, span * 0.25):
                        top = (matched, best[i][1], best[i][2])
        best.append(top)
        by_end[q1, p0 + q1 - q0] = j
    least = MIN_CHARS if item.wide else MIN_WORDS
    runs = []
    for (matched, q0, p0), (a0, q1, b0) in zip(best, exact):
        p1 = b0 + q1 - a0
        changed = max(q1 - q0, p1 - p0) - matched
        if q1 - q0 >= least and changed <= (q1 - q0) * CHANGED + 1:
            runs.append((p0, p1, q0, q1, max(0, changed)))
    # Chain of at most MAX_RUNS runs, in order and apart in item and text, that holds the most. Runs are taken in the text's order;
    # of those that have ended, only the best for each end in the item and each number of runs is kept.
    runs.sort()
    ended: list[tuple[int, int, list[tuple[int, int]]]] = []  # heap: end p, end q, (held, changed) with 1 .. MAX_RUNS runs
    behind: dict[int, list[tuple[int, int]]] = {}
    top = (0, 0, 0)
    for p0, p1, q0, q1, c in runs:
        # A run may reach a token or two too far, into what happens to follow it.
        while ended and ended[0][0] <= p0 + 2:
            _, end, rows = heapq.heappop(ended)
            behind[end] = [max(x, y) for x, y in zip(rows, behind.get(end, rows))]
        rows = [(q1 - q0, -c)] + [(0, 0)] * (MAX_RUNS - 1)
        for end, chains in behind.items():
            double = max(0, end - q0)
            if double <= 2:
                for k in range(1, MAX_RUNS):
                    h, d = chains[k - 1]
                    if h:
                        rows[k] = max(rows[k], (h + q1 - q0 - double, d - c))
        heapq.heappush(ended, (p1, q1, rows))
        for k, (h, d) in enumerate(rows):
            if h > top[0]:
                top = (h, -d, k + 1)
    return top


def _bands(n: int) -> int:
    """Bands of offsets that the passages of an item of ``n`` tokens can lie in: two a run, and more as words are added or lost."""
    return 2 * MAX_RUNS + int(np.ceil((n * CHANGED + 1) * MAX_HOLE / BAND))


def find(documents: DataFrame, items: DataFrame | Iterable[tuple[int, str]], key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents with the items they hold: ``key``, item_id, held (part of the item), changed (part of that), runs.

    ``items``: a table (item_id, text), or such rows, of any number. They are taken in blocks of ``block_chars`` characters,
    each against all documents, so what is broadcast is bounded by that.
    Defined results: null and empty texts hold nothing; items of fewer than two tokens are found nowhere; repeated
    texts each have their own rows.
    """
    rows = items.select("item_id", "text").toLocalIterator() if isinstance(items, DataFrame) else iter(items)
    out, block, size = None, [], 0
    for item_id, t in itertools.chain(rows, [(None, None)]):
        if block and (item_id is None or size + len(t or "") > block_chars):
            found = _find(documents, block, key, text)
            out, block, size = found if out is None else out.unionByName(found), [], 0
        if item_id is not None and t:
            block.append((item_id, t))
            size += len(t)
    return _find(documents, [], key, text) if out is None else out


def _find(documents: DataFrame, items: list[tuple[int, str]], key: str, text: str) -> DataFrame:
    spark = documents.sparkSession
    known = [i for i in (Item(k, t) for k, t in items) if i.n >= 2]
    vocabulary: dict[tuple[str, str], int] = {}
    for item in known:
        for pair in item.pairs:
            vocabulary.setdefault(pair, len(vocabulary))
    least = min((needed(i.n) for i in known), default=1)
    postings = stage(index(documents, vocabulary, least, key, text))
    flat = postings.select(key, F.explode(F.arrays_zip("terms", "positions")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.positions").alias("position"))
    # One row a term of the item vocabulary: as bounded as the items.
    frequency = {r.term: r.df for r in flat.groupBy("term").agg(F.count_distinct(key).alias("df")).collect()}
    # A text that holds half of an item lacks at most n - 1 - needed of its n - 1 pairs. Of so many and SURE more, the rarest, it has SURE.
    seeds, limits, bands = [], [], []
    for number, item in enumerate(known):
        order = sorted(range(len(item.pairs)), key=lambda q: (frequency.get(vocabulary[item.pairs[q]], 0), q))
        sure = min(SURE, needed(item.n), len(order))
        taken = order[: min(len(order), len(order) - needed(item.n) + sure)]
        seeds += [(vocabulary[item.pairs[q]], number, q) for q in taken]
        limits.append(sure)
        bands.append(_bands(item.n))
    asked = spark.createDataFrame(pd.DataFrame(seeds, columns=["term", "item", "q"]), "term int, item int, q int")
    met = flat.join(F.broadcast(asked), "term").select(key, "item", "q", F.floor((F.col("position") - F.col("q")) / BAND).alias("band"))
    # Offset-adjusted intersection: an item's terms in a text count by the offset at which they stand, and only the offsets that its
    # runs can lie at count together. Terms that a text merely happens to have lie at as many offsets as they are.
    by_band = met.groupBy(key, "item", "band").agg(F.count_distinct("q").alias("shared"))
    of_item = lambda values: F.get(F.array(*[F.lit(v) for v in values] or [F.lit(1)]), F.col("item"))
    most = F.slice(F.sort_array(F.collect_list("shared"), asc=False), 1, F.first(of_item(bands)))
    candidates = by_band.groupBy(key, "item").agg(F.aggregate(most, F.lit(0).cast("long"), lambda s, x: s + x).alias("shared")).where(F.col("shared") >= of_item(limits))
    listed = candidates.groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("items"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, terms, positions, asked_items in zip(batch[key], batch["terms"], batch["positions"], batch["items"]):
                for number in asked_items:
                    item = known[number]
                    h, c, r = held(item, vocabulary, terms, positions)
                    # A token between two changed ones is in no pair and so counts as changed; one is allowed for in long passages.
                    if h >= HELD * item.n and c <= CHANGED * h + (h >= 0.75 * item.n):
                        rows.append((k, item.item_id, h / item.n, c / h, r))
            yield pd.DataFrame(rows, columns=[key, "item_id", "held", "changed", "runs"])

    kind = dict(documents.dtypes)[key]
    return postings.join(listed, key).mapInPandas(verify, f"`{key}` {kind}, item_id long, held double, changed double, runs int")
