"""Prices to returns, cleaning, portfolios. Panels are long: (date, asset, value); ``by`` names columns that keep panels apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, num, ordered


def dense(panel: DataFrame) -> DataFrame:
    """Every date with every asset of the panel; cells without a row are null. Assets are few."""
    grid = panel.select("date").distinct().crossJoin(F.broadcast(panel.select("asset").distinct()))
    return grid.join(panel.select("date", "asset", num("value").alias("value")), ["date", "asset"], "left")


def prices_to_returns(prices: DataFrame, method: str = "log") -> DataFrame:
    """Returns against the row before (a missing neighbour gives null); dates without any return go, and assets without any price."""
    if method not in ("log", "simple"):
        raise ValueError("unknown method: choose log or simple")
    usable = prices.select("date", "asset", num("value").alias("value"))
    grid = dense(usable.join(usable.groupBy("asset").agg(F.count("value").alias("n")).where("n > 0").select("asset"), "asset", "left_semi"))
    grid = grid.withColumn("value", F.when(F.col("value") <= 0, F.raise_error(F.lit("prices must be positive"))).otherwise(F.col("value")))
    last = F.lag("value").over(ordered(["asset"]))
    change = F.ln(F.col("value") / last) if method == "log" else F.col("value") / last - 1
    out = grid.withColumn("r", finite(change))
    kept = out.groupBy("date").agg(F.count("r").alias("n")).where("n > 0").select("date")
    return out.join(kept, "date", "left_semi").select("date", "asset", F.col("r").alias("value"))


def check_prices(prices: DataFrame) -> None:
    """Raises ValueError before any plan is built if a price is not positive."""
    if prices.where(num("value") <= 0).limit(1).count():
        raise ValueError("prices have to be positive before returns are taken")


def clean_returns(returns: DataFrame, min_non_missing: float = 0.95) -> DataFrame:
    """Assets with at least that share of dates, then only dates on which all of those have a return."""
    if not 0 < min_non_missing <= 1:
        raise ValueError("min_non_missing is a share above 0 and up to 1")
    r = returns.select("date", "asset", num("value").alias("value"))
    dates = r.agg(F.countDistinct("date").alias("n_dates"))
    kept = r.groupBy("asset").agg(F.count("value").alias("n")).crossJoin(F.broadcast(dates)).where(F.col("n") >= min_non_missing * F.col("n_dates")).select("asset")
    part = r.join(kept, "asset", "left_semi").where("value is not null")
    whole = part.groupBy("date").agg(F.count("value").alias("n")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("assets")))).where("n = assets").select("date")
    return part.join(whole, "date", "left_semi")


def market_return(returns: DataFrame, column: str | None = None) -> DataFrame:
    """(date, ret): the named asset's return, or without one (or without that asset) the mean over the assets that have one."""
    r = returns.select("date", "asset", F.col("value").cast("double").alias("value"))
    r = r.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if column is not None and not r.where(F.col("asset") == column).isEmpty():
        return r.where(F.col("asset") == column).select("date", finite("value").alias("ret"))
    return r.groupBy("date").agg(finite(F.avg("value")).alias("ret"))


def portfolio_returns(returns: DataFrame, weights: str | Mapping[str, float] = "equal_weight") -> DataFrame:
    """(date, ret): equal weight over the assets present, or given weights scaled to sum to one; those are not scaled again for missing cells."""
    if isinstance(weights, str):
        if weights != "equal_weight":
            raise ValueError("weights: equal_weight, or a mapping from assets")
        return returns.select("date", num("value").alias("value")).groupBy("date").agg(F.avg("value").alias("ret"))
    total = float(sum(weights.values()))
    if abs(total) <= 1e-8:
        raise ValueError("weights that sum to nothing can't be scaled")
    w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v) / total))])[F.col("asset")], F.lit(0.0))
    return returns.select("date", "asset", num("value").alias("value")).groupBy("date").agg(F.sum(F.col("value") * w).alias("ret"))


