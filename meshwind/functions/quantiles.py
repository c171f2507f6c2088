"""Exact quantiles of all earlier values of each row, by wavelet matrices over blocks of times and of values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panels import stored
from .scans import numbered

#: Rows of a key that one task takes at most; longer keys go in blocks of as many times and as many values.
GROUP_ROWS = 1 << 17


class WaveletMatrix:
    """A sequence of whole numbers that answers, for many prefixes at once, which number is k-th smallest and how many are below a bound.

    Bit by bit from the top, numbers with a 0 go before those with a 1; ``zeros`` counts the former before each place."""

    def __init__(self, values: np.ndarray):
        self.n, self.zeros = len(values), []
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def smallest(self, prefix: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0 on) of the first ``prefix`` numbers."""
        low, high, k, out = np.zeros_like(prefix), prefix.copy(), k.copy(), np.zeros_like(prefix)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            left = k < b - a
            out |= np.where(left, 0, 1 << self.bits - 1 - level)
            k -= np.where(left, 0, b - a)
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
        return out

    def below(self, prefix: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the first ``prefix`` numbers are less than ``bound``."""
        low, high, out = np.zeros_like(prefix), prefix.copy(), np.where(bound >> self.bits, prefix, 0)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            one = (bound >> self.bits - 1 - level & 1).astype(bool)
            out = out + np.where(one & ~(bound >> self.bits > 0), b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def _places(earlier: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two places between which a quantile of so many values lies, and how far towards the second."""
    at = level * (np.maximum(earlier, 1) - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.ceil(at).astype(np.int64), at - low


def _between(low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    return low + share * (high - low)


def expanding(values: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """(rows, levels): linearly interpolated quantiles of all values before each row; NaN for the first."""
    n = len(values)
    out = np.full((n, len(levels)), np.nan)
    if n < 2:
        return out
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    matrix, sorted_, earlier = WaveletMatrix(rank), values[order], np.arange(1, n)
    for c, level in enumerate(levels):
        low, high, share = _places(earlier, level)
        out[1:, c] = _between(sorted_[matrix.smallest(earlier, low)], sorted_[matrix.smallest(earlier, high)], share)
    return out


def expanding_quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float], date: str = "date") -> DataFrame:
    """(by, date, value, q, earlier): the quantiles of the key's known values before each row, and their number; null on rows without
    a value and, for q, without an earlier one.

    Keys of up to GROUP_ROWS rows are a group each. A longer key is dealt by number of time and by number of value: counts of the
    earlier blocks of times say in which block of values a row's quantile lies, and that block's rows which one it is.
    """
    by, levels = list(by), [float(x) for x in levels]
    df = stored(df.select(*by, date, F.col(value).cast("double").alias(value)))
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, date]]
    if most <= GROUP_ROWS:

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(date)
            s = table.column(value).to_numpy()
            known = ~np.isnan(s)
            q, earlier = np.full((len(s), len(levels)), np.nan), np.cumsum(known) - known
            q[known] = expanding(s[known], levels)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, len(levels), dtype=np.int32)), pa.array(q.reshape(-1)), mask=pa.array(np.isnan(q[:, 0])))
            return table.append_column("q", lists).append_column("earlier", pa.array(earlier, mask=~known))

        return df.groupBy(*by).applyInArrow(run, ", ".join([*kinds, f"`{value}` double", "q array<double>", "earlier long"]))
    return _in_blocks(df, by, value, levels, date)


def _in_blocks(df: DataFrame, by: list[str], value: str, levels: list[float], date: str) -> DataFrame:
    key = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).select(key.alias("key"), F.col(date).alias("date"), F.col(value).alias("s"))
    rows = numbered(numbered(rows, ["key"], ["date"], "t"), ["key"], ["s", "date"], "v")
    total = rows.count()
    size = max(GROUP_ROWS // 8, math.isqrt(total))  # as many blocks of times as of values, so that their grid grows with the rows
    rows = stored(rows.withColumns({"tb": F.floor(F.col("t") / size), "vb": F.floor(F.col("v") / size)}))
    key_kind = rows.schema["key"].dataType.simpleString()
    # how many rows of each block of values lie in earlier blocks of times
    ends = rows.groupBy("key").agg(F.max("tb").alias("tb"), F.max("vb").alias("vb"))
    grid = ends.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "tb")).alias("tb"), "vb").select("key", "tb", F.explode(F.sequence(F.lit(0).cast("long"), "vb")).alias("vb"))
    cells = grid.join(rows.groupBy("key", "tb", "vb").count(), ["key", "tb", "vb"], "left")
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("key", "vb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = cells.withColumn("n", earlier).groupBy("key", "tb").agg(F.array_sort(F.collect_list(F.struct("vb", "n"))).alias("cells")).select(F.col("key").alias("of"), F.col("tb").alias("at"), F.col("cells.n").alias("counts"))

    def locate(table: pa.Table, counts: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, vb = table.column("t").to_numpy(), table.column("vb").to_numpy()
        first = np.concatenate([[0], np.cumsum(counts.column("counts").combine_chunks().values.to_numpy())])
        matrix, inside, out = WaveletMatrix(vb), np.arange(len(t)), []
        blocks = len(first) - 1
        for c, level in enumerate(levels):
            for side, place in enumerate(_places(t, level)[:2]):
                # the last block of values before which there are no more than ``place`` earlier rows
                low, high = np.zeros(len(t), np.int64), np.full(len(t), blocks - 1)
                while (low < high).any():
                    middle = (low + high + 1) // 2
                    fits = first[middle] + matrix.below(inside, middle) <= place
                    low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
                k = place - first[low] - matrix.below(inside, low)
                use = t > 0
                out.append(pa.table({"key": table.column("key").filter(pa.array(use)), "t": t[use], "tb": table.column("tb").to_numpy()[use], "slot": np.full(use.sum(), 2 * c + side), "vb": low[use], "k": k[use]}))
        return pa.concat_tables(out)

    asked = stored(rows.groupBy("key", "tb").cogroup(carry.groupBy("of", "at")).applyInArrow(locate, f"key {key_kind}, t long, tb long, slot long, vb long, k long"))
    need = asked.select(F.col("key").alias("of"), F.col("vb").alias("bucket"), F.col("tb").alias("at")).distinct()
    held = rows.join(need, (F.col("key") == F.col("of")) & (F.col("vb") == F.col("bucket")) & (F.col("tb") <= F.col("at"))).select("of", "bucket", "at", F.col("t").alias("time"), "v", "s")

    def resolve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("time")
        s, v = rows.column("s").to_numpy(), rows.column("v").to_numpy()
        order = np.argsort(v)
        rank = np.empty(len(v), np.int64)
        rank[order] = np.arange(len(v))
        prefix = np.searchsorted(rows.column("time").to_numpy(), queries.column("t").to_numpy())
        found = s[order][WaveletMatrix(rank).smallest(prefix, queries.column("k").to_numpy())]
        return queries.select(["key", "t", "slot"]).append_column("x", pa.array(found))

    found = asked.groupBy("key", "vb", "tb").cogroup(held.groupBy("of", "bucket", "at")).applyInArrow(resolve, f"key {key_kind}, t long, slot long, x double")
    slots = found.groupBy("key", "t").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("x"))
    at = [F.lit(q) * (F.col("t") - 1) for q in levels]
    x = lambda slot: F.col("x")[F.lit(slot).cast("long")]
    q = F.array(*[x(2 * c) + (p - F.floor(p)) * (x(2 * c + 1) - x(2 * c)) for c, p in enumerate(at)])
    done = rows.join(slots, ["key", "t"], "left").select(F.col("key").alias("of"), F.col("date").alias("when"), F.when(F.col("t") > 0, q).alias("q"), F.col("t").alias("earlier"))
    joined = df.withColumn("key", key).join(done, F.col("key").eqNullSafe(F.col("of")) & (F.col(date) == F.col("when")), "left")
    clean = F.when(F.col(value).isNotNull(), F.col("q")), F.when(F.col(value).isNotNull(), F.col("earlier"))
    return joined.select(*by, date, value, clean[0].alias("q"), clean[1].alias("earlier"))
