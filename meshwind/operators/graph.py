"""Rolling sparse-network features and the regime indicator."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import finite, num, ordered, z_scores
from ..functions.scans import running
from .returns import clean_returns
from .stress import over_windows

#: Fixed parts of the indicator, with signs; its z columns follow the same order.
INDICATOR_PARTS = (("average_graph_strength", 1.0), ("algebraic_connectivity", 1.0), ("largest_laplacian_eigenvalue_share", 1.0), ("modularity", -1.0), ("laplacian_frobenius_change", 1.0))
DIAGNOSTICS = ("graph_lasso_converged", "graph_lasso_n_iter", "graph_lasso_alpha", "graph_lasso_max_iter", "graph_lasso_tol", "graph_lasso_enet_tol", "graph_lasso_mode", "graph_lasso_warning_count", "graph_lasso_warning_message")
FEATURES = ("average_graph_strength", "weighted_edge_density", "algebraic_connectivity", "largest_laplacian_eigenvalue", "largest_laplacian_eigenvalue_share", "modularity", "laplacian_frobenius_change", "number_of_edges", "average_node_strength")


def check_fit(alpha: float, max_iter: int, tol: float, enet_tol: float, mode: str) -> None:
    for ok, said in ((alpha > 0, "alpha must be positive."), (max_iter > 0, "max_iter must be positive."), (tol > 0, "tol must be positive."), (enet_tol > 0, "enet_tol must be positive."), (mode in ("cd", "lars"), "mode must be either 'cd' or 'lars'.")):
        if not ok:
            raise ValueError(said)


def network_grid(returns: DataFrame, configs: Sequence[dict], *, min_periods: int | None = None, min_non_missing: float = 0.95, max_iter: int = 1000, tol: float = 1e-4, enet_tol: float = 1e-4, mode: str = "cd") -> DataFrame:
    """(config_id, date, features, diagnostics) for configs of window, alpha, threshold and with_modularity.

    Each (window, alpha) is fitted once per date, whatever the number of thresholds; windows are dealt out by date.
    """
    for c in configs:
        check_fit(c["alpha"], max_iter, tol, enet_tol, mode)
        if c["window"] <= 1:
            raise ValueError("a window has two rows or more")
        if c["threshold"] < 0:
            raise ValueError("a threshold of partial correlations can't be below zero")
    cleaned = clean_returns(returns, min_non_missing)
    shape = cleaned.agg(F.count_distinct("asset").alias("assets"), F.count_distinct("date").alias("dates")).first()
    if shape["assets"] < 2:
        raise ValueError("a network needs two assets that have returns")
    needed = min(c["window"] for c in configs) if min_periods is None else min_periods
    if shape["dates"] < needed:
        raise ValueError(f"too few dates on which all assets have returns: {shape['dates']} of {needed}")
    kind = returns.schema["date"].dataType.simpleString()
    schema = f"config_id string, date {kind}, " + ", ".join(f"{f} double" for f in kernels.GRAPH_FEATURES) + ", laplacian array<double>, graph_lasso_converged boolean, graph_lasso_n_iter int, graph_lasso_alpha double, graph_lasso_max_iter int, graph_lasso_tol double, graph_lasso_enet_tol double, graph_lasso_mode string, graph_lasso_warning_count int, graph_lasso_warning_message string"
    out = None
    for size in sorted({c["window"] for c in configs}):
        least = size if min_periods is None else min_periods
        if least <= 1:
            raise ValueError("min_periods: two rows or more")
        if least > size:
            raise ValueError("min_periods is at most the window")
        own = [c for c in configs if c["window"] == size]

        def run(dates: np.ndarray, moments: kernels.Moments, own=own) -> pd.DataFrame:
            if moments.n.shape[1] < 2:
                raise ValueError("a network needs two assets that have returns")
            s, out = moments.correlations(pairwise=False), []
            for alpha, theta, done, sweeps in kernels.fit_windows(s, {c["alpha"] for c in own}, max_iter, tol, enet_tol, mode):
                partial = kernels.partial_correlations(theta)
                for c in own:
                    if c["alpha"] != alpha:
                        continue
                    a = kernels.adjacency(partial, c["threshold"])
                    lap = kernels.laplacian(a)
                    got = pd.DataFrame({"config_id": c["config_id"], "date": dates, **kernels.graph_features(a, lap, c.get("with_modularity", False))})
                    got["laplacian"] = list(lap.reshape(len(lap), -1))
                    got["graph_lasso_converged"], got["graph_lasso_n_iter"] = done, sweeps.astype(np.int32)
                    got["graph_lasso_alpha"], got["graph_lasso_max_iter"], got["graph_lasso_tol"], got["graph_lasso_enet_tol"], got["graph_lasso_mode"] = float(alpha), np.int32(max_iter), tol, enet_tol, mode
                    got["graph_lasso_warning_count"] = (~done).astype(np.int32)
                    got["graph_lasso_warning_message"] = np.where(done, "", kernels.NO_CONVERGENCE.format(max_iter))
                    out.append(got)
            return pd.concat(out)

        part = over_windows(cleaned, size, least, run, schema)
        out = part if out is None else out.unionAll(part)
    last = F.lag("laplacian").over(ordered(["config_id"]))
    change = F.sqrt(F.aggregate(F.zip_with("laplacian", last, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = out.withColumn("laplacian_frobenius_change", change).withColumn("modularity", finite("modularity"))
    return out.select("config_id", "date", *FEATURES, *DIAGNOSTICS)


@dataclass(frozen=True)
class GraphicalLassoFit:
    """One window's fit with its diagnostics."""

    covariance: np.ndarray
    precision: np.ndarray
    converged: bool
    n_iter: int
    warning_messages: tuple[str, ...]
    alpha: float
    max_iter: int
    tol: float
    enet_tol: float
    mode: str


def fit_window(window: pd.DataFrame | np.ndarray, alpha: float, max_iter: int = 1000, tol: float = 1e-4, enet_tol: float = 1e-4, mode: str = "cd", assume_centered: bool = True) -> GraphicalLassoFit:
    """The fit of one (rows, assets) window as it is given, on the driver; assume_centered: its means count as zero."""
    check_fit(alpha, max_iter, tol, enet_tol, mode)
    x = np.asarray(window, float)
    if not np.isfinite(x).all():
        raise ValueError("a window to be fitted has finite values only")
    if not assume_centered:
        x = x - x.mean(axis=0)
    cov, theta, done, sweeps = kernels.graphical_lasso((x.T @ x / len(x))[None], alpha, max_iter, tol, enet_tol, mode)
    said = () if done[0] else (kernels.NO_CONVERGENCE.format(max_iter),)
    return GraphicalLassoFit(cov[0], theta[0], bool(done[0]), int(sweeps[0]), said, alpha, max_iter, tol, enet_tol, mode)


def rolling_graph_features(returns: DataFrame, window: int, alpha: float, min_periods: int | None = None, min_non_missing: float = 0.95, partial_corr_threshold: float = 1e-8, max_iter: int = 200, compute_modularity: bool = False, tol: float = 1e-4, enet_tol: float = 1e-4, mode: str = "cd", on_non_convergence: str = "record") -> DataFrame:
    """(date, features, diagnostics) of the windows that end at each complete date."""
    if on_non_convergence not in ("record", "warn", "raise"):
        raise ValueError("unknown on_non_convergence: record, warn or raise")
    config = {"config_id": "one", "window": window, "alpha": alpha, "threshold": partial_corr_threshold, "with_modularity": compute_modularity}
    out = network_grid(returns, [config], min_periods=min_periods, min_non_missing=min_non_missing, max_iter=max_iter, tol=tol, enet_tol=enet_tol, mode=mode).drop("config_id")
    if on_non_convergence != "record":
        row = out.agg(F.count("*").alias("n"), F.sum((~F.col("graph_lasso_converged")).cast("int")).alias("bad"), F.min(F.when(~F.col("graph_lasso_converged"), F.col("date"))).alias("first")).first()
        if row["bad"]:
            said = f"graphical lasso did not converge in {row['bad']}/{row['n']} rolling windows, first {row['first']}"
            if on_non_convergence == "raise":
                raise RuntimeError(said)
            warnings.warn(said, RuntimeWarning, stacklevel=2)
    return out


def regime_indicator(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """features with z columns of the indicator's parts and their signed sum; nulls count as zero."""
    missing = [c for c, _ in INDICATOR_PARTS if c not in features.columns]
    if missing:
        raise KeyError(f"the indicator lacks {missing}")
    df = features.withColumns({c: num(c) for c, _ in INDICATOR_PARTS})
    df = z_scores(df, {f"z_{c}": c for c, _ in INDICATOR_PARTS}, by)
    return df.withColumn("regime_indicator", sum((F.lit(sign) * F.col(f"z_{c}") for c, sign in INDICATOR_PARTS), F.lit(0.0)))


def convergence_summary(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Windows, converged and not, the rate, warnings, and the solver's sweeps."""
    if "graph_lasso_converged" not in features.columns:
        raise KeyError("a column graph_lasso_converged is needed to count windows that settled")
    good = F.col("graph_lasso_converged").cast("int")
    extra = []
    if "graph_lasso_warning_count" in features.columns:
        extra.append(F.sum("graph_lasso_warning_count").cast("double").alias("graph_lasso_warning_count_total"))
    if "graph_lasso_n_iter" in features.columns:
        extra += [F.avg("graph_lasso_n_iter").alias("graph_lasso_n_iter_mean"), F.max("graph_lasso_n_iter").cast("double").alias("graph_lasso_n_iter_max")]
    return features.groupBy(*by).agg(F.count("*").alias("n_windows"), F.sum(good).cast("bigint").alias("n_converged"), F.sum(1 - good).cast("bigint").alias("n_non_converged"), F.avg(good).alias("convergence_rate"), *extra)


def rolling_pca_features(returns: DataFrame, window: int = 126, min_periods: int | None = None, min_non_missing: float = 0.8) -> DataFrame:
    """(date, first eigenvalue, its share, effective rank, and their changes to the last value that was not null) of rolling correlations."""
    if window <= 1:
        raise ValueError("a window has two rows or more")
    least = window if min_periods is None else min_periods
    if not 1 < least <= window:
        raise ValueError("min_periods lies between two and the window")
    if not 0 < min_non_missing <= 1:
        raise ValueError("min_non_missing is a share above 0 and up to 1")

    def run(dates: np.ndarray, moments: kernels.Moments) -> pd.DataFrame:
        return pd.DataFrame(kernels.correlation_spectra(moments, min_non_missing), columns=list("abc")).assign(date=dates)[["date", "a", "b", "c"]]

    got = over_windows(returns, window, least, run, f"date {returns.schema['date'].dataType.simpleString()}, a double, b double, c double").select("date", *[finite(x).alias(x) for x in "abc"])
    got = running(got, [], {"a0": ("last", F.col("a")), "c0": ("last", F.col("c"))}, strict=True)
    return got.select("date", F.col("a").alias("pca_first_eigenvalue"), F.col("b").alias("pca_first_eigenvalue_share"), F.col("c").alias("pca_effective_rank"), (F.col("a") - F.col("a0")).alias("pca_first_eigenvalue_change"), (F.col("c") - F.col("c0")).alias("pca_effective_rank_change"))


PCA_FEATURES = ("pca_first_eigenvalue", "pca_first_eigenvalue_share", "pca_effective_rank", "pca_first_eigenvalue_change", "pca_effective_rank_change")
