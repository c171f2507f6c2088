"""python -m meshwind PRICES --out FOLDER: runs workflows over a price table, writes their tables and charts, prints summaries."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, models, selection, stress
from .operators import returns as ret
from .plans import figures, plotdata, workflows
from .sources import panels

WORKFLOWS = ("empirical", "overlays", "grid", "consolidation")


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="meshwind", description="Regime analytics over a wide table of prices (CSV with a date column, or Parquet).")
    p.add_argument("prices")
    p.add_argument("--out", required=True, help="folder of tables and charts")
    p.add_argument("--workflow", choices=WORKFLOWS, action="append", help="may be given several times; all if it is not given")
    p.add_argument("--vix", help="a table of date and level")
    p.add_argument("--window", type=int, default=126)
    p.add_argument("--alpha", type=float, default=0.10)
    p.add_argument("--threshold", type=float, default=1e-6)
    p.add_argument("--mode", choices=("cd", "lars"), default="cd")
    p.add_argument("--quick", action="store_true", help="one configuration instead of the whole grid")
    p.add_argument("--format", choices=("parquet", "csv"), default="csv")
    splits = models.SampleSplits()
    for name in ("development_start", "development_end", "validation_start", "validation_end", "test_start"):
        p.add_argument("--" + name.replace("_", "-"), default=getattr(splits, name))
    p.add_argument("--years", type=int, nargs="*", default=[2020, 2021, 2022, 2023, 2024, 2025], help="test years of the rolling origin")
    return p.parse_args(argv)


def summary(name: str, table: DataFrame, rows: int = 12) -> str:
    """A table's first rows as text."""
    found = table.limit(rows).toPandas()
    return f"{name}: {table.count()} rows\n{found.to_string(index=False, max_cols=8)}\n"


def run(spark: SparkSession, a: argparse.Namespace, say=print) -> dict[str, DataFrame]:
    prices = panels.to_long(panels.read_table(spark, a.prices))
    returns = panels.stored(ret.prices_to_returns(prices))
    index = prices.where("value is not null").groupBy("date").agg(F.avg("value").alias("value"))
    vix = panels.read_table(spark, a.vix).toDF("date", "vix") if a.vix else None
    splits = models.SampleSplits(a.development_start, a.development_end, a.validation_start, a.validation_end, a.test_start)
    if vix is None:
        labels = stress.stress_labels(None, stress.market_drawdown(index), stress.realized_volatility(returns), stress.correlation_scores(returns, a.window).select("date", "average_correlation"))
        benchmarks = panels.stored(labels)
    else:
        benchmarks = panels.stored(workflows.benchmark_table(index, returns, vix, corr_window=a.window))
    ri = panels.stored(graph.regime_indicator(graph.rolling_graph_features(returns, a.window, a.alpha, partial_corr_threshold=a.threshold, max_iter=1000, mode=a.mode)))
    tables: dict[str, DataFrame] = {}
    for name in a.workflow or WORKFLOWS:
        if name == "empirical":
            tables |= workflows.empirical(returns, benchmarks, a.window, a.alpha, a.threshold)
        elif name == "overlays":
            tables |= workflows.overlays(ri, returns, benchmarks)
        elif name == "grid":
            tables |= workflows.grid_selection(returns, benchmarks, selection.quick_grid() if a.quick else selection.parameter_grid(), splits)
        else:
            tables |= workflows.consolidation(ri, returns, benchmarks, splits, selection.origin_splits(a.years, a.development_start), pca_window=a.window, min_history=a.window)
    tables = {n: panels.stored(t) for n, t in tables.items()}
    panels.write_tables(tables, f"{a.out}/tables", a.format)
    for name, table in tables.items():
        say(summary(name, table))
    line = plotdata.indicator_line(ri.select("date", "regime_indicator"), benchmarks)
    say("chart: " + figures.save(line, f"{a.out}/figures/regime_indicator.png", "lines", "date", ["regime_indicator"]))
    wealth = plotdata.wealth_and_drawdown(ret.portfolio_returns(returns))
    say("chart: " + figures.save(wealth, f"{a.out}/figures/drawdown.png", "lines", "date", ["drawdown"]))
    return tables


def main(argv: Sequence[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("meshwind").getOrCreate()
    try:
        with panels.scratch(spark):
            run(spark, a)
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(f"meshwind: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
