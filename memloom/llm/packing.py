"""Filling fixed-capacity containers with texts, as little unused space as possible.

Method: sum-of-squares online packing. For each fill level h the number N(h) of open containers at that level is kept in a
level array. A text of size s goes to the level that makes the sum of N(h)^2 over partly filled containers least after the
placement. Which container of the level takes it makes no difference to the sum; the one opened last does.

The texts of a budget are packed in lots: a text's lot is a hash of its id, the number of lots follows the number of
texts. Every lot is packed on its own, so no task sees more than a bounded number of texts; a lot leaves a few partly
filled containers, next to nothing beside the thousands it fills. Only ids and sizes leave the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in one lot, about (parameter of ``pack``).
LOT_TEXTS = 10_000
#: Partitions that lots are spread over, at most; beyond it a task packs several lots, one after the other.
MOST_PARTITIONS = 20_000


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given. Sizes are 1 .. capacity."""
    count = np.zeros(capacity + 1, np.int32)  # the level array; 0 and capacity stand for no open container
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    used, where, n_used = np.empty(capacity + 1, np.int32), np.full(capacity + 1, -1, np.int32), 0  # levels in use, in no order
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum of squares: leaving h adds 1 - 2 N(h), reaching h + s adds 2 N(h + s) + 1; full ones don't count.
        at = used[:n_used]
        fits = at[at <= capacity - s]
        best, h = (2 * int(count[s]) + 1 if s < capacity else 0), 0
        if fits.size:
            to = fits + s
            change = np.where(to < capacity, 2 * count[to] + 1, 0) + 1 - 2 * count[fits]
            least = int(change.min())
            if least <= best:
                same = fits[change == least]
                h = int(same.max())  # of equals, the fullest
        if h:
            b = open_at[h].pop()
            count[h] -= 1
            if not count[h]:
                n_used -= 1
                last = used[n_used]
                used[where[h]] = last
                where[last] = where[h]
                where[h] = -1
        else:
            b, made = made, made + 1
        h += s
        if h < capacity:
            open_at[h].append(b)
            if not count[h]:
                used[n_used] = h
                where[h] = n_used
                n_used += 1
            count[h] += 1
        out[i] = b
    return out


def _pack_lot(capacities: dict[int, int], key: str):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values([key], kind="stable")
        ids, sizes, lot = batch[key].to_numpy(), batch["size"].to_numpy(np.int64), int(batch["lot"].iloc[0])
        parts = []
        for budget, capacity in capacities.items():
            whole, rest = np.divmod(sizes, capacity)
            fit = (sizes <= capacity) & (sizes > 0)
            # A text over the capacity fills containers of its own; what is left of it is an item like any other.
            sized = np.where(fit, sizes, rest)
            items = np.flatnonzero(sized > 0)
            at = place(sized[items], capacity)
            n = int(at.max()) + 1 if len(at) else 0
            full = np.repeat(np.arange(len(sizes)), np.where(fit, 0, whole))
            first = np.concatenate([[0], np.cumsum(np.where(fit, 0, whole))])[:-1]
            number = np.arange(len(full)) - first[full]
            parts.append(pd.DataFrame({
                "budget_id": budget, "lot": lot,
                "container": np.concatenate([at, n + np.arange(len(full))]),
                key: ids[np.concatenate([items, full])],
                "from_byte": np.concatenate([np.where(fit[items], 0, (sizes - rest)[items]), number * capacity]),
                "bytes": np.concatenate([sized[items], np.full(len(full), capacity)]),
                "oversized": np.concatenate([~fit[items], np.ones(len(full), bool)]),
            }))
        return pd.concat(parts)

    return run


def pack(df: DataFrame, text: str, budgets: list[tuple[int, int]], key: str = "doc_id", lot_texts: int = LOT_TEXTS) -> DataFrame:
    """Containers of all texts for each budget.

    ``budgets``: (budget_id, capacity_tokens); a token is a UTF-8 byte. ``key`` must be unique. Columns: budget_id, lot,
    container (within budget and lot), ``key``, from_byte, bytes, oversized. A text has one row, but for texts over the
    capacity, which have one for each part. Null and empty texts take no space and are in no container.
    """
    if any(c < 1 for _, c in budgets):
        raise ValueError("capacities must be positive")
    sized = df.select(F.col(key), F.octet_length(text).cast("long").alias("size")).where("size > 0")
    lots = max(1, -(-sized.count() // lot_texts))
    kind = dict(df.dtypes)[key]
    schema = f"budget_id int, lot int, container long, `{key}` {kind}, from_byte long, bytes long, oversized boolean"
    cut = sized.withColumn("lot", F.pmod(F.xxhash64(key), F.lit(lots)).cast("int"))
    # A lot is a task's worth of work but few bytes; its own partitioning keeps small lots from being put together into one task.
    return cut.repartition(min(lots, MOST_PARTITIONS), "lot").groupBy("lot").applyInPandas(_pack_lot(dict(budgets), key), schema)


def utilization(packed: DataFrame, budgets: list[tuple[int, int]]) -> DataFrame:
    """Containers, bytes and the used share of all space, by budget."""
    containers = packed.groupBy("budget_id", "lot", "container").agg(F.sum("bytes").alias("bytes"))
    capacity = F.create_map(*[F.lit(x) for pair in budgets for x in pair])[F.col("budget_id")]
    return containers.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("bytes").alias("bytes")).withColumn("used", F.col("bytes") / (F.col("containers") * capacity))
