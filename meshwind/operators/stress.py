"""Benchmarks and stress labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import finite, full_only, label, num
from ..functions.scans import blocked, halo_window, running, with_halo
from ..sources.panels import stored
from .returns import dense, market_return

#: Fixed benchmark columns, in order.
BENCHMARKS = ("vix", "realized_volatility", "average_correlation", "average_absolute_correlation", "drawdown")


def realized_volatility(returns: DataFrame, window: int = 21, annualize: bool = True, trading_days: int = 252) -> DataFrame:
    """(date, realized_volatility): deviation of the equal-weight mean return over full windows."""
    if window <= 1:
        raise ValueError("a window has two rows or more")
    if trading_days <= 0:
        raise ValueError("a year has one trading day or more")
    vol = full_only(F.stddev_samp("ret"), F.col("ret"), halo_window([], 1 - window, 0), window)
    rows = with_halo(market_return(returns), [], window - 1).withColumn("v", vol * float(np.sqrt(trading_days)) if annualize else vol)
    return rows.where("own").select("date", F.col("v").alias("realized_volatility"))


def market_drawdown(prices: DataFrame, value: str = "value") -> DataFrame:
    """(date, drawdown): price against its maximum so far, null where the price is."""
    p = blocked(prices.select("date", num(value).alias("p")), [], ["date"])
    if p.where("p is not null").isEmpty():
        raise ValueError("a drawdown needs at least one known price")
    p = p.withColumn("p", F.when(F.col("p") <= 0, F.raise_error(F.lit("prices must be positive"))).otherwise(F.col("p")))
    return running(p, [], {"top": ("max", F.col("p"))}).select("date", (F.col("p") / F.col("top") - 1).alias("drawdown"))


def correlation_scores(returns: DataFrame, window: int = 126) -> DataFrame:
    """(date, average_correlation, average_absolute_correlation): means over pairs of assets of the pairwise-complete
    correlations of each full window of dates, from sliding moments."""
    if window <= 1:
        raise ValueError("a correlation window needs two dates at least")
    if returns.where(num("value").isNotNull()).select("asset").distinct().limit(2).count() < 2:
        raise ValueError("average correlation needs returns of two assets at least")

    def run(dates: np.ndarray, moments: kernels.Moments) -> pd.DataFrame:
        c = moments.correlations()[:, *np.triu_indices(moments.n.shape[1], 1)]
        known = np.isfinite(c)
        count, c = known.sum(axis=1), np.where(known, c, 0.0)
        mean = lambda v: np.where(count > 0, v.sum(axis=1) / np.maximum(count, 1), np.nan)
        return pd.DataFrame({"date": dates, "a": mean(c), "b": mean(np.abs(c))})

    got = over_windows(returns, window, window, run, f"date {returns.schema['date'].dataType.simpleString()}, a double, b double")
    return got.select("date", finite("a").alias("average_correlation"), finite("b").alias("average_absolute_correlation"))


def correlation_score(returns: DataFrame, window: int = 126, use_absolute: bool = False) -> DataFrame:
    """(date, average_correlation or average_absolute_correlation) of correlation_scores."""
    return correlation_scores(returns, window).select("date", "average_absolute_correlation" if use_absolute else "average_correlation")


def over_windows(returns: DataFrame, window: int, min_periods: int, run, schema: str) -> DataFrame:
    """What ``run(dates, moments)`` makes of the windows of the last ``window`` dates that end at each date, from ``min_periods`` dates on;
    moments are pairwise-complete sums over assets by name.

    Dates go out in blocks with the window before each block, so that a row travels about twice whatever the window."""
    rows = dense(returns).groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", F.coalesce("value", F.lit(float("nan"))).alias("v")))), lambda s: s["v"]).alias("row"))
    blocks = with_halo(rows, [], window - 1, size=max(window, 64)).withColumnRenamed("part", "block")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        own = np.flatnonzero(f["own"].to_numpy() & (f["n"].to_numpy() + 1 >= min_periods))
        dates = f["date"].to_numpy()
        made = [run(dates[places], moments) for places, moments in kernels.sliding_moments(matrix(f["row"]), window, own)]
        return pd.concat(made) if made else pd.DataFrame({c.strip().split(" ")[0]: pd.Series([], dtype=object) for c in schema.split(",")})

    return blocks.groupBy("block").applyInPandas(work, schema)


def matrix(w) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in w])


def outer_join(*frames: DataFrame) -> DataFrame:
    """Frames by date, every date of any; one union and one grouping instead of a chain of joins."""
    columns = [c for f in frames for c in f.columns if c != "date"]
    kinds = {c: f.schema[c].dataType for f in frames for c in f.columns if c != "date"}
    both = reduce(DataFrame.unionAll, [f.select("date", *[(F.col(c) if c in f.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]) for f in frames])
    return both.groupBy("date").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def stress_labels(vix: DataFrame | None = None, drawdown: DataFrame | None = None, realized_vol: DataFrame | None = None, correlation: DataFrame | None = None, vix_threshold: float = 30.0, drawdown_threshold: float = -0.10, vol_quantile: float = 0.8, correlation_quantile: float = 0.8) -> DataFrame:
    """The given series by date with their labels and the systemic label, the greatest of them (missing counts as 0)."""
    for q, name in ((vol_quantile, "vol_quantile"), (correlation_quantile, "correlation_quantile")):
        if not 0 <= q <= 1:
            raise ValueError(f"{name} is a share from 0 to 1")
    given = [(n, f) for n, f in (("vix", vix), ("drawdown", drawdown), ("realized_volatility", realized_vol), ("average_correlation", correlation)) if f is not None]
    if not given:
        raise ValueError("At least one benchmark series is required")
    frames = [f.select("date", num(next(c for c in f.columns if c != "date")).alias(n)) for n, f in given]
    df = outer_join(*frames)
    names = [n for n, _ in given]
    quantiles = {}
    for n, q in (("realized_volatility", vol_quantile), ("average_correlation", correlation_quantile)):
        if n in names:
            quantiles[f"_q_{n}"] = F.percentile(n, q)
    if quantiles:
        df = stored(df)
        df = df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in quantiles.items()])))  # one row
    tests = {"vix": F.col("vix") >= vix_threshold, "drawdown": F.col("drawdown") <= drawdown_threshold} | {n: F.col(n) >= F.col(f"_q_{n}") for n in ("realized_volatility", "average_correlation") if n in names}
    out = {"average_correlation": "correlation"}
    made = [f"{out.get(n, n)}_stress_label" for n in names]
    for n, c in zip(names, made):
        df = df.withColumn(c, label(F.col(n), tests[n]))
    zeros = [F.coalesce(F.col(c), F.lit(0)) for c in made]
    systemic = F.greatest(*zeros) if len(zeros) > 1 else zeros[0]
    return df.select("date", *names, *made, systemic.alias("systemic_stress_label"))


def stress_onsets(labels: DataFrame, min_gap: int = 20, column: str = "systemic_stress_label") -> DataFrame:
    """(date, stress_onset_label): 1 where stress starts after at least min_gap calm rows in a run."""
    if min_gap < 0:
        raise ValueError("min_gap counts rows, from 0 on")
    if column not in labels.columns:
        rest = [c for c in labels.columns if c != "date"]
        if len(rest) != 1:
            raise KeyError(f"no column {column!r} to find onsets in")
        column = rest[0]
    df = running(labels.select("date", F.coalesce(num(column).cast("int"), F.lit(0)).alias("l")), [], {"n": ("count", F.lit(1)), "before": ("lag", F.col("l"))})
    df = running(df, [], {"stressed": ("max", F.when(F.col("l") != 0, F.col("n")))}, strict=True)
    starts = (F.col("l") == 1) & (F.coalesce("before", F.lit(0)) == 0) & (F.col("n") - F.coalesce("stressed", F.lit(0)) - 1 >= min_gap)
    return df.select("date", starts.cast("int").alias("stress_onset_label"))


def benchmark_changes(benchmarks: DataFrame) -> DataFrame:
    """(date, <benchmark>_change): differences to the row before."""
    found = [c for c in BENCHMARKS if c in benchmarks.columns]
    if not found:
        raise ValueError("none of the known benchmarks is a column")
    df = running(benchmarks.select("date", *[num(c).alias(c) for c in found]), [], {f"_before_{c}": ("lag", F.col(c)) for c in found})
    return df.select("date", *[(F.col(c) - F.col(f"_before_{c}")).alias(f"{c}_change") for c in found])
