"""Overlapping and gapped intervals: continuous periods for each key, and the gaps between them.

Method: canonical dyadic blocks. The ends of a key's intervals are numbered in order, so intervals become small integer ones and
have few blocks. Each is decomposed into its canonical dyadic blocks [i * 2^k, (i + 1) * 2^k). Blocks of six successive levels
share a cell, 64 units wide, and a block is the set of its units, one bit each:

* blocks covered by an ancestor within the cell, and repeated ones, add no bit; siblings that are both there make up their
  parent's bits. One hash aggregation a tier (six levels) does both, with map-side combination;
* a cell whose bits are all set has merged upward to one unit of the tier above, and takes part there;
* a cell that a unit of a higher tier covers is removed, by looking up its ancestors' cells.

What is left is disjoint: runs of set bits, which are coalesced where they touch. A cell holds 64 bits however many rows fall in it,
and all steps work by (key, cell) or by ranges of (key, position), so a key that holds a third of all rows is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.ranks import positions
from memloom.staging import drop, stage

#: Levels in a tier, and units in its cells.
LEVELS, UNITS = 6, 64
#: What stands for an open end; Spark's timestamps are within 2^58 microseconds of 1970.
LOW, HIGH = -(1 << 60), 1 << 60


def _shift(way: str, c: Column, by: Column | int) -> Column:
    return F.call_function("shift" + way, c, by if isinstance(by, Column) else F.lit(by))


def blocks(a: Column, b: Column, levels: int) -> Column:
    """Array of the canonical dyadic blocks (level, index) of [a, b) in 0 .. 2^levels.

    At level k the interval has a block at its left end if ceil(a / 2^k) is odd, and one at its right end if
    floor(b / 2^k) is odd, as long as the one is less than the other.
    """

    def at(k: Column) -> Column:
        first, last = _shift("right", a + _shift("left", F.lit(1).cast("long"), k) - 1, k), _shift("right", b, k)
        left = F.when((first < last) & (first.bitwiseAND(1) == 1), F.struct(k.alias("level"), first.alias("index")))
        right = F.when((first < last) & (last.bitwiseAND(1) == 1), F.struct(k.alias("level"), (last - 1).alias("index")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def _cells(intervals: DataFrame, levels: int) -> DataFrame:
    """(_k, tier, cell, bits): the blocks of ``intervals`` (_k, r0, r1) as bits of cells, repeats and covered ones merged."""
    found = intervals.select("_k", F.explode(blocks(F.col("r0"), F.col("r1"), levels)).alias("x"))
    tier, within = (F.col("x.level") / LEVELS).cast("int"), F.col("x.level") % LEVELS
    unit = _shift("left", F.col("x.index"), within)
    width = _shift("left", F.lit(1), within)
    ones = _shift("rightunsigned", F.lit(-1).cast("long"), F.lit(UNITS) - width)
    bits = _shift("left", ones, unit.bitwiseAND(UNITS - 1).cast("int"))
    return found.select("_k", tier.alias("tier"), _shift("right", unit, LEVELS).alias("cell"), bits.alias("bits")).groupBy("_k", "tier", "cell").agg(F.bit_or("bits").alias("bits"))


def _runs(bits: Column) -> Column:
    """Array of (first, last) of the runs of set bits."""
    at = F.sequence(F.lit(0), F.lit(UNITS - 1))
    on = lambda i: _shift("right", bits, i).bitwiseAND(1) == 1
    firsts = F.filter(at, lambda i: on(i) & ((i == 0) | ~on(F.greatest(i - 1, F.lit(0)))))
    lasts = F.filter(at, lambda i: on(i) & ((i == UNITS - 1) | ~on(F.least(i + 1, F.lit(UNITS - 1)))))
    return F.zip_with(firsts, lasts, lambda x, y: F.struct(x.alias("first"), y.alias("last")))


def _disjoint(intervals: DataFrame, levels: int) -> DataFrame:
    """Disjoint runs (_k, r0, r1) of what ``intervals`` cover; runs may touch."""
    base = stage(_cells(intervals, levels))
    tiers = levels // LEVELS + 1
    whole: list[DataFrame] = []
    for t in range(tiers):
        now = base.where(F.col("tier") == t).select("_k", "cell", "bits")
        if t:
            risen = whole[-1].where("bits = -1").select("_k", _shift("right", F.col("cell"), LEVELS).alias("cell"), _shift("left", F.lit(1).cast("long"), F.col("cell").bitwiseAND(UNITS - 1).cast("int")).alias("bits"))
            now = stage(now.unionByName(risen).groupBy("_k", "cell").agg(F.bit_or("bits").alias("bits")))
        whole.append(now)
    out = None
    for t, now in enumerate(whole):
        left = now if t == tiers - 1 else now.where("bits != -1")
        for u in range(t + 1, tiers):
            # The unit of tier u that the cell lies in, and the cell that holds this unit's bit.
            unit = _shift("right", F.col("cell"), LEVELS * (u - t - 1))
            above = whole[u].select("_k", F.col("cell").alias("_above"), F.col("bits").alias("_bits"))
            left = left.withColumns({"_unit": unit, "_above": _shift("right", unit, LEVELS)}).join(above, ["_k", "_above"], "left")
            left = left.where(F.coalesce(_shift("right", F.col("_bits"), F.col("_unit").bitwiseAND(UNITS - 1).cast("int")).bitwiseAND(1) == 0, F.lit(True))).select("_k", "cell", "bits")
        runs = left.select("_k", "cell", F.explode(_runs(F.col("bits"))).alias("x"))
        size = UNITS**t
        start = F.col("cell") * UNITS
        runs = runs.select("_k", ((start + F.col("x.first")) * size).alias("r0"), ((start + F.col("x.last") + 1) * size).alias("r1"))
        out = runs if out is None else out.unionByName(runs)
    return out


class Merged:
    """The merged intervals [start, end) of each key: ``gaps`` and ``periods``, by ``keys``, ``p0`` and ``p1``.

    A gap lies between two covered points. Empty, reversed and null intervals cover nothing; repeats and ties change
    nothing; null keys form a group; further columns are ignored; an empty table gives empty ones. Ends may be any 64-bit integers.
    Keys are worked on by a 128-bit hash.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], start: str, end: str):
        self.keys = list(keys)
        valid = df.where(F.col(start) < F.col(end))
        key = F.unhex(F.md5(F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)]))))
        self._names = valid.groupBy(*self.keys).agg(F.lit(1).alias("_")).select(key.alias("_k"), *self.keys)
        # Of intervals with the same start only the longest matters; combined before the shuffle.
        longest = stage(valid.select(key.alias("_k"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).groupBy("_k", "a").agg(F.max("b").alias("b")))
        points = longest.select("_k", F.col("a").alias("p")).unionByName(longest.select("_k", F.col("b").alias("p"))).groupBy("_k", "p").agg(F.lit(1).alias("_")).drop("_")
        self._ranked = stage(positions(points, ["_k"], ["p"], "r", base=0))
        small = stage(longest.join(self._at("a", "r0"), ["_k", "a"]).join(self._at("b", "r1"), ["_k", "b"]).select("_k", "r0", "r1"))
        drop(longest)
        levels = max(1, (small.agg(F.max("r1")).first()[0] or 1).bit_length())
        runs = positions(_disjoint(small, levels), ["_k"], ["r0"], "n")
        following = runs.select("_k", (F.col("n") + 1).alias("n"), F.col("r1").alias("before"))
        self._line = stage(runs.join(following, ["_k", "n"], "left").select("_k", "r0", "r1", "before"))
        drop(small)

    def _at(self, p: str, r: str) -> DataFrame:
        return self._ranked.select("_k", F.col("p").alias(p), F.col("r").alias(r))

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self._names, "_k").select(*self.keys, "p0", "p1")

    def gaps(self) -> DataFrame:
        holes = self._line.where("before < r0")
        return self._named(holes.join(self._at("p0", "before"), ["_k", "before"]).join(self._at("p1", "r0"), ["_k", "r0"]))

    def periods(self) -> DataFrame:
        """From a run that no other touches before it to the start of the next gap, or the key's last point."""
        holes = self._line.where("before < r0").select("_k", F.col("before").alias("r1"))
        starts = positions(self._line.where("before is null or before < r0").select("_k", "r0"), ["_k"], ["r0"], "n")
        ends = positions(holes.unionByName(self._line.groupBy("_k").agg(F.max("r1").alias("r1"))), ["_k"], ["r1"], "n")
        both = starts.join(ends, ["_k", "n"])
        return self._named(both.join(self._at("p0", "r0"), ["_k", "r0"]).join(self._at("p1", "r1"), ["_k", "r1"]))


def claim_intervals(claims: DataFrame) -> DataFrame:
    """Validity of claims in microseconds, by trimmed scope, subject and lower-case topic.

    One null end is open (LOW, HIGH); a claim with both null, or that ends before it starts, covers nothing. Blank topics are left out.
    """
    from memloom.functions.keys import clean_id, micros, trimmed

    a, b = F.coalesce(micros("valid_from"), F.lit(LOW)), F.coalesce(micros("valid_to"), F.lit(HIGH))
    return claims.where("valid_from is not null or valid_to is not null").select(
        trimmed("scope_key").alias("scope_key"), trimmed("subject_id").alias("subject_id"), F.lower(clean_id("topic_key")).alias("topic_key"), a.cast("long").alias("a"), b.cast("long").alias("b")
    ).where("topic_key is not null")
