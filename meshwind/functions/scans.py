"""Running aggregates, row numbers and ranks of long ordered frames, without a task that sees all rows of a key.

A frame is dealt into blocks by ranges of (by, order). Windows run within (by, block); each block's totals, one row a block and key,
are carried on to the blocks after it; both are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.panels import stored

#: Rows of a block.
BLOCK_ROWS = 50_000
_BLOCK = "_block"


def blocked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written, with the number of each row's block, which rises with (by, order); up to BLOCK_ROWS rows are one block."""
    if _BLOCK in df.columns:
        return df
    df = stored(df)
    n = -(-df.count() // BLOCK_ROWS)
    if n <= 1:
        return df.withColumn(_BLOCK, F.lit(0))
    # equal places are spread over blocks too, in an order that writing fixes
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by, *order, "_tie")
    return stored(dealt.withColumn(_BLOCK, F.spark_partition_id()).drop("_tie"))


def _carried(df: DataFrame, by: Sequence[str], totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """df with each block's carries: ``over`` of the ``totals`` of the key's earlier blocks."""
    keys = [*by, _BLOCK]
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    w = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.over(w).alias(n) for n, c in over.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)] + [F.col(_BLOCK) == F.col(f"_k{len(by)}")]
    on = same[0]
    for c in same[1:]:
        on &= c
    return df.join(carry, on).drop(*[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, by: Sequence[str], columns: dict[str, tuple[str, Column]], order: str = "date", *, strict: bool = False) -> DataFrame:
    """df with a running aggregate of each (kind, value): sum, product, max, min, count, first or last (known value) of the rows up to
    each row, or with ``strict`` of those before it; lag is the value of the row before, known or not.

    ``order`` has to tell the rows of a key apart; rows without one come first.
    """
    df = blocked(df, by, [order])
    df = df.withColumns({f"_v{k}": v for k, (_, v) in enumerate(columns.values())})
    own = Window.partitionBy(*by, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    step = Window.partitionBy(*by, _BLOCK).orderBy(order)
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    plain = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "count": F.count}
    totals, over, local, made = {}, {}, {}, {}
    for k, (name, (kind, _)) in enumerate(columns.items()):
        v, c, x = f"_v{k}", F.col(f"_c{k}"), F.col(f"_l{k}")
        if kind == "lag":
            totals[f"_t{k}"] = F.max_by(F.struct(v), place)
            over[f"_c{k}"] = F.last(f"_t{k}")
            local[f"_l{k}"] = F.lag(F.struct(v)).over(step)
            made[name] = F.coalesce(x, c)[v]
        elif kind == "first":
            totals[f"_t{k}"] = F.min_by(v, F.when(F.col(v).isNotNull(), place))
            over[f"_c{k}"] = F.first(f"_t{k}", ignorenulls=True)
            local[f"_l{k}"] = F.first(v, ignorenulls=True).over(own)
            made[name] = F.coalesce(c, x)
        elif kind == "last":
            totals[f"_t{k}"] = F.max_by(v, F.when(F.col(v).isNotNull(), place))
            over[f"_c{k}"] = F.last(f"_t{k}", ignorenulls=True)
            local[f"_l{k}"] = F.last(v, ignorenulls=True).over(own)
            made[name] = F.coalesce(x, c)
        else:
            totals[f"_t{k}"] = plain[kind](v)
            over[f"_c{k}"] = plain["sum" if kind == "count" else kind](f"_t{k}")
            local[f"_l{k}"] = plain[kind](v).over(own)
            both = {"sum": c + x, "count": c + x, "product": c * x, "max": F.greatest(c, x), "min": F.least(c, x)}[kind]
            made[name] = F.coalesce(both, x, c) if kind != "count" else F.coalesce(both, x, c, F.lit(0))
    kept = [c for c in df.columns if not c.startswith("_v")]
    out = _carried(df.withColumns(local), by, totals, over) if len(columns) else df
    return out.select(*[c for c in kept if c not in made and c != _BLOCK], *[c.alias(n) for n, c in made.items()], _BLOCK)


def unblocked(df: DataFrame) -> DataFrame:
    return df.drop(_BLOCK)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's number, from 0 on, in the order of its key's rows; ties are numbered in some order."""
    df = blocked(df, by, order)
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, _BLOCK).orderBy(*order)))
    out = _carried(out, by, {"_t": F.count(F.lit(1))}, {"_c": F.sum("_t")})
    return out.withColumn(name, (F.coalesce("_c", F.lit(0)) + F.col("_n") - 1).cast("long")).drop("_c", "_n", _BLOCK)


def average_ranks(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """df with the average rank (from 1 on) of each column's value among its key's rows, for each (name, column).

    Values are counted first, so that a value which many rows share is one row of the scan."""
    df = stored(df)
    for k, (name, column) in enumerate(columns.items()):
        counts = df.groupBy(*by, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
        low = running(counts, by, {"_b": ("sum", F.col("_m"))}, "_x", strict=True)
        rank = unblocked(low).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "_x", (F.coalesce("_b", F.lit(0)) + (F.col("_m") + 1) / 2).alias(name))
        on = F.col(column).eqNullSafe(F.col("_x"))
        for i, b in enumerate(by):
            on &= F.col(b).eqNullSafe(F.col(f"_k{i}"))
        df = df.join(rank, on).drop("_x", *[f"_k{i}" for i in range(len(by))])
    return df


def with_halo(df: DataFrame, by: Sequence[str], before: int, after: int = 0, order: str = "date", size: int = 4096) -> DataFrame:
    """Rows in blocks (``part``) of ``size`` numbers ``n`` of their key, with so many rows before and after each block: windows of that
    reach run within (by, part), and are whole on the rows where ``own`` holds."""
    rows, size = numbered(df, by, [order], "n"), max(size, before, after)
    first, last = F.floor(F.greatest(F.col("n") - after, F.lit(0)) / size), F.floor((F.col("n") + before) / size)
    return rows.withColumn("part", F.explode(F.sequence(first, last))).withColumn("own", F.floor(F.col("n") / size) == F.col("part"))


def halo_window(by: Sequence[str], first: int, last: int) -> WindowSpec:
    """The rows of with_halo's blocks from ``first`` to ``last``, counted from each row."""
    return Window.partitionBy(*by, "part").orderBy("n").rowsBetween(first, last)


def trailing_means(df: DataFrame, by: Sequence[str], column: str, windows: dict[str, int], order: str = "date") -> DataFrame:
    """df with the mean of the known values among each row and those before it, for each (name, rows)."""
    spread = with_halo(df, by, max(windows.values()) - 1, order=order)
    return spread.withColumns({c: F.avg(column).over(halo_window(by, 1 - n, 0)) for c, n in windows.items()}).where("own").drop("part", "own", "n")
