"""Column expressions and window frames that the operators share. NaN and infinities are null everywhere inside the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Standard deviations up to which values count as constant.
CONSTANT = 1e-8


def finite(c: Column | str) -> Column:
    """The double value, null if it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def num(c: Column | str) -> Column:
    """Coerced to a finite double; what doesn't parse is null."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def as_bool(c: Column | str) -> Column:
    """1.0 or 0.0 for booleans, their names in text and 1 or 0; other numbers as they are."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.when(text.isin("True", "true", "1"), 1.0).when(text.isin("False", "false", "0"), 0.0).otherwise(c.cast("string").try_cast("double"))


def label(source: Column, condition: Column) -> Column:
    """1 or 0, null where the source is."""
    return F.when(source.isNull(), None).when(condition, 1).otherwise(0).cast("int")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ordered(by: Sequence[str], date: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(date)


def trailing(by: Sequence[str], n: int, date: str = "date") -> WindowSpec:
    return ordered(by, date).rowsBetween(-(n - 1), 0)


def full_only(value: Column, counted: Column, over: WindowSpec, n: int) -> Column:
    """The windowed value where all n rows have one."""
    return F.when(F.count(counted).over(over) == n, value.over(over))


def correlation(x: Column | str, y: Column | str, least: int = 2) -> Column:
    """Pearson aggregate over complete pairs; null under ``least`` pairs or if either side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (sx > CONSTANT) & (sy > CONSTANT), ratio(F.covar_pop(x, y), sx * sy))


def sign_name(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.abs(c) <= CONSTANT), "zero_or_unstable").when(c > 0, "positive").otherwise("negative")


def z_scores(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), *, fill: bool = True, over: Column | None = None) -> DataFrame:
    """Adds out = (x - mean) / population deviation for each out: x of ``columns``; zero where the deviation is zero or undefined.

    Moments are window aggregates of each group, so that the plan holds df once however often scores are chained.
    fill: nulls become zero. over: rows that the moments are taken of (all, if none is given)."""
    w = Window.partitionBy(*by)
    pick = (lambda x: F.when(over, F.col(x))) if over is not None else F.col
    df = df.withColumns({f"_{s}{k}": f(pick(x)).over(w) for k, x in enumerate(columns.values()) for s, f in (("m", F.avg), ("s", F.stddev_pop))})
    made = {}
    for k, (name, x) in enumerate(columns.items()):
        z = F.when(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) > 0, (F.col(x) - F.col(f"_m{k}")) / F.col(f"_s{k}")).otherwise(F.lit(0.0))
        made[name] = F.coalesce(z, F.lit(0.0)) if fill else z
    return df.withColumns(made).drop(*[f"_{s}{k}" for s in "ms" for k in range(len(columns))])


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the row's values that are not null; zero if there are none."""
    n = sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0))
    return F.coalesce(ratio(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)), n), F.lit(0.0))


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_m")).select(*keys, f"_m.{name}", f"_m.{value}")


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} is missing {missing}")
