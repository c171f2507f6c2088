"""Tables behind the charts; drawing is left to the reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import CONSTANT, melt, num, require
from ..functions.scans import running
from ..operators.evaluate import RI


def indicator_line(indicator: DataFrame, labels: DataFrame | None = None, column: str = RI, label: str = "systemic_stress_label") -> DataFrame:
    """(date, indicator, is_stress)."""
    require(indicator, [column], "indicator")
    df = indicator.select("date", num(column).alias(column))
    if labels is None or label not in labels.columns:
        return df.withColumn("is_stress", F.lit(False))
    return df.join(labels.select("date", F.coalesce(num(label) == 1, F.lit(False)).alias("is_stress")), "date", "left").fillna(False, ["is_stress"])


def indicator_vs_benchmark(indicator: DataFrame, benchmark: DataFrame, name: str, column: str = RI) -> DataFrame:
    out = indicator.select("date", num(column).alias(column)).join(benchmark.select("date", num(name).alias(name)), "date").dropna()
    if out.isEmpty():
        raise ValueError("indicator and benchmark share no dates")
    return out


def feature_panel(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(date, feature, value) of the columns that have any value."""
    long = melt(features, ["date"], [c for c in columns if c in features.columns], "feature", "value").withColumn("value", num("value"))
    return long.join(long.groupBy("feature").agg(F.count("value").alias("n")).where("n > 0").select("feature"), "feature", "left_semi").select("date", "feature", "value")


def stress_boxes(aligned: DataFrame, column: str = RI, label: str = "systemic_stress_label") -> DataFrame:
    """(label, n, min, q1, median, q3, max)."""
    require(aligned, [column, label], "aligned")
    out = aligned.where(num(column).isNotNull() & num(label).isin(0, 1)).groupBy(num(label).cast("int").alias("label")).agg(F.count("*").alias("n"), F.min(column).alias("min"), F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max(column).alias("max"))
    if out.count() < 2:
        raise ValueError("Both stress and non-stress observations are required")
    return out.select("label", "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def scatter_with_line(indicator: DataFrame, target: DataFrame, name: str, column: str = RI) -> DataFrame:
    """(x, y, fitted): fitted is null under three pairs or if x is constant."""
    pairs = indicator.select("date", num(column).alias("x")).join(target.select("date", num(name).alias("y")), "date").dropna()
    line = pairs.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("s"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return pairs.crossJoin(F.broadcast(line)).select("x", "y", F.when((F.col("n") >= 3) & (F.col("s") > CONSTANT), F.col("a") + F.col("b") * F.col("x")).alias("fitted"))


def regime_bars(summary: DataFrame, metric: str = "volatility") -> DataFrame:
    require(summary, [metric], "regime_class_summary")
    return summary.select("regime_class", metric)


def wealth_and_drawdown(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, wealth, drawdown)."""
    df = running(returns.where(num("ret").isNotNull()).select(*by, "date", "ret"), by, {"wealth": ("product", 1 + F.greatest("ret", F.lit(-0.999999)))})
    return running(df, by, {"top": ("max", F.col("wealth"))}).select(*by, "date", "wealth", (F.col("wealth") / F.col("top") - 1).alias("drawdown"))


def heatmap(table: DataFrame, rows: str, columns: str, value: str, names: Sequence) -> DataFrame:
    """Mean of value by rows and columns."""
    return table.groupBy(rows).pivot(columns, list(names)).agg(F.avg(value))


def top(table: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k rows with the largest value; ties go by further columns."""
    return table.orderBy(F.col(by).desc_nulls_last(), *ties).limit(k)
