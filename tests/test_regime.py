"""Hand-computed values, invariants and error messages of the regime engine."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest

from meshwind.functions import kernels as K
from meshwind.operators import components, evaluate, graph, overlay, returns, selection, stress
from meshwind.operators.models import SampleSplits, rank_information_sets, sample_period
from meshwind import __main__ as cli
from meshwind.plans import figures, plotdata
from meshwind.sources import downloads, panels


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def series(spark, values, name="score"):
    return spark.createDataFrame([(day(k), None if v is None else float(v)) for k, v in enumerate(values)], f"date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_csv_is_sorted_typed_and_pruned(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("date,SPY,TLT,empty\n2020-01-02,101,inf,\n2020-01-01,100,50,\n")
    df = panels.load_prices_csv(spark, str(path))
    assert df.columns == ["date", "SPY", "TLT"] and [tuple(r) for r in df.collect()] == [(day(0), 100.0, 50.0), (day(1), 101.0, None)]
    with pytest.raises(FileNotFoundError):
        panels.load_prices_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ImportError, match="required"):
        panels.download_prices(spark, ["SPY"], "2020-01-01")
    assert panels.price_columns([("Close", "A"), ("Adj Close", "A"), ("Close", "B")], ["A", "B"]) == {"A": ("Adj Close", "A"), "B": ("Close", "B")}


def test_returns_and_weights(spark):
    p = spark.createDataFrame([(day(k), a, float(v)) for a, vs in (("x", (100, 105, 110)), ("y", (50, 49, 51))) for k, v in enumerate(vs)], "date date, asset string, value double")
    got = {(r.date, r.asset): r.value for r in returns.prices_to_returns(p).collect()}
    assert got[day(1), "x"] == pytest.approx(np.log(1.05)) and len(got) == 4
    r = returns.prices_to_returns(p, "simple")
    assert column(returns.portfolio_returns(r, {"x": 1.0, "y": 3.0}), "ret")[0] == pytest.approx(0.25 * 0.05 + 0.75 * -0.02)
    with pytest.raises(ValueError, match="method"):
        returns.prices_to_returns(p, "other")
    with pytest.raises(ValueError, match="positive"):
        returns.check_prices(p.withColumn("value", p.value - 100))


def test_exposure_rules(spark):
    assert column(overlay.exposure(series(spark, [0, 0, 0, 10, 0]), min_history=3), "exposure") == [1, 1, 1, 1, 0.5]
    assert column(overlay.exposure(series(spark, [-3, -2, -1, 10, 0]), method="full_sample", high_q=0.6, extreme_q=0.8), "exposure")[-1] == 0.5
    held = overlay.exposure(series(spark, [-1, 0, 5, 4, 3, -2]), variant="hysteresis", method="full_sample", high_q=0.5, extreme_q=0.95, exit_q=0.25)
    assert column(held, "exposure") == [1.0, 1.0, 1.0, 0.5, 0.7, 0.7]
    cool = column(overlay.exposure(series(spark, [0, 10] * 6), variant="cooldown_5d", method="full_sample"), "exposure")
    changes = [k for k in range(1, 12) if cool[k] != cool[k - 1]]
    assert all(b - a > 5 for a, b in zip(changes, changes[1:]))
    for bad, said in (({"high_q": 0.9, "extreme_q": 0.8}, "quantiles"), ({"method": "x"}, "method"), ({"min_history": 0}, "min_history"), ({"high": 2.0}, "normal_exposure")):
        with pytest.raises(ValueError, match=said):
            overlay.exposure(series(spark, [1]), **bad)


def test_costs_and_drawdown(spark):
    base = series(spark, [0.01] * 4, "ret")
    e = series(spark, [1, 0.5, 0.5, 1], "exposure")
    on = overlay.apply_overlay(base, e).drop("ret").join(base, "date")
    assert column(overlay.with_costs(on, [], [10.0]), "ret") == pytest.approx([0.01, 0.0095, 0.01, 0.0095])
    perf = overlay.performance(series(spark, [0.1, -0.1, 0.05], "ret")).first()
    assert perf.max_drawdown == pytest.approx(-0.10) and perf.n_obs == 3 and perf.hit_rate == pytest.approx(2 / 3)
    assert overlay.performance(base.limit(0)).first().n_obs == 0
    with pytest.raises(ValueError, match="costs"):
        overlay.with_costs(on, [], [-1.0])


def test_stress_labels_and_onsets(spark):
    got = stress.stress_labels(vix=series(spark, [20, None, 40], "v"))
    assert column(got, "vix_stress_label") == [0, None, 1] and column(got, "systemic_stress_label") == [0, 0, 1]
    on = stress.stress_onsets(series(spark, [0, 0, 1, 1, 0, 1, 0, 0, 1], "systemic_stress_label"), 2)
    assert [k for k, v in enumerate(column(on, "stress_onset_label")) if v] == [2, 8]
    with pytest.raises(ValueError, match="At least one benchmark"):
        stress.stress_labels()
    with pytest.raises(ValueError, match="known benchmarks"):
        stress.benchmark_changes(series(spark, [1], "other"))


def test_forward_targets_need_full_horizons(spark):
    r = series(spark, [0.10, 0.01, 0.02, -0.03, 0.04], "value").selectExpr("date", "'a' as asset", "value")
    t = evaluate.forward_targets(r, [2])
    assert column(t, "forward_return_sum_2d")[0] == pytest.approx(0.03) and column(t, "forward_return_sum_2d")[-2:] == [None, None]
    assert column(t, "forward_max_drawdown_2d")[2] == pytest.approx(-0.03)
    with pytest.raises(ValueError, match="horizon"):
        evaluate.forward_targets(r, [])


def test_regimes_and_events(spark):
    ri = series(spark, range(10), "regime_indicator")
    got = evaluate.event_study(ri, ["2020-01-05", "2019-01-01"], 2, 1).collect()
    assert sorted(r.relative_day for r in got if r.matched_date == day(4)) == [-2, -1, 0, 1] and sorted(r.relative_day for r in got if r.matched_date == day(0)) == [0, 1]
    flat = evaluate.regime_classes(series(spark, [1, 1, None], "regime_indicator"))
    assert column(flat, "regime_class") == ["normal", "normal", None]


def test_graphical_lasso_satisfies_its_optimality_conditions():
    rng = np.random.RandomState(7)
    x = K.standardized(rng.randn(5, 80, 6) + rng.randn(5, 80, 1))
    s = np.einsum("bni,bnj->bij", x, x) / 80
    for alpha in (0.05, 0.3):
        w, theta, done, sweeps = K.graphical_lasso(s, alpha, tol=1e-8, inner_tol=1e-8)
        assert done.all() and (sweeps >= 1).all()
        off = ~np.eye(6, dtype=bool)
        assert np.allclose(np.linalg.inv(theta), w, atol=1e-4)
        gap = (w - s)[:, off]
        t = theta[:, off]
        assert (np.abs(gap) <= alpha + 1e-4).all() and np.allclose(gap[np.abs(t) > 1e-6], alpha * np.sign(t[np.abs(t) > 1e-6]), atol=1e-3)
    a = K.adjacency(K.partial_correlations(theta), 0.0)
    lap = K.laplacian(a)
    assert np.allclose(lap.sum(axis=-1), 0) and (K.spectrum(lap)[:, 0] == 0).all()
    with pytest.raises(ValueError, match="constant"):
        K.graphical_lasso(np.zeros((1, 2, 2)), 0.1)


def test_disconnected_graph_and_modularity():
    a = np.zeros((1, 4, 4))
    a[0, 0, 1] = a[0, 1, 0] = a[0, 2, 3] = a[0, 3, 2] = 1.0
    f = K.graph_features(a, K.laplacian(a), True)
    assert f["algebraic_connectivity"][0] == 0 and f["number_of_edges"][0] == 2 and f["modularity"][0] == pytest.approx(0.5)


def test_rolling_features_and_errors(spark):
    rng = np.random.RandomState(7)
    m = rng.randn(12) * 0.8
    r = spark.createDataFrame([(day(k), f"a{j}", float(m[k] * (0.4 + j / 10) + rng.randn() * 0.5)) for k in range(12) for j in range(3)], "date date, asset string, value double")
    f = graph.rolling_graph_features(r, 5, 0.1)
    rows = f.orderBy("date").collect()
    assert len(rows) == 8 and rows[0].laplacian_frobenius_change is None and rows[1].laplacian_frobenius_change is not None
    assert all(x.modularity is None for x in rows)
    assert len(graph.regime_indicator(f).where("regime_indicator is null").collect()) == 0
    pca = graph.rolling_pca_features(r, 5).orderBy("date").collect()
    assert all(1 <= x.pca_effective_rank <= 3 + 1e-9 and 0 < x.pca_first_eigenvalue_share <= 1 for x in pca)
    for bad, said in (({"alpha": 0}, "alpha must be positive"), ({"tol": 0}, "tol must be positive"), ({"enet_tol": 0}, "enet_tol must be positive"), ({"mode": "x"}, "mode must be either"), ({"on_non_convergence": "x"}, "on_non_convergence")):
        with pytest.raises(ValueError, match=said):
            graph.rolling_graph_features(r, 5, **({"alpha": 0.1} | bad))
    with pytest.raises(RuntimeError, match="did not converge"):
        graph.rolling_graph_features(r, 5, 0.01, max_iter=1, tol=1e-12, on_non_convergence="raise")


def test_grid_and_selection(spark):
    assert len(selection.parameter_grid()) == 24 and selection.quick_grid()[0].config_id == "alpha0.20_window63_threshold0.03"
    rows = [(c, s, t, 0.1, 10, 0.0, sh, -0.2 + sh / 10, 0.2 - sh / 100, sh, -0.03 + sh / 100, 5.0) for c, k in (("a", 0.5), ("b", 0.9)) for s in ("validation", "test") for t, sh in (("baseline", 0.4), ("ri_overlay", k if s == "validation" else 1 - k))]
    m = spark.createDataFrame(rows, "config_id string, sample string, strategy string, alpha double, window int, partial_corr_threshold double, sharpe double, max_drawdown double, annualized_volatility double, calmar double, worst_5pct_return double, annualized_turnover_proxy double")
    picked = selection.select_configuration(m)
    assert [r.config_id for r in picked.where("selected").collect()] == ["b"]
    out = selection.oos_outputs(m, m, picked)
    assert {(r.config_id, r["sample"]) for r in out["oos_test_performance"].collect()} == {("b", "test")}
    splits = selection.origin_splits((2021,))
    assert splits[0].selection_end == "2020-12-31"
    periods = spark.createDataFrame([(dt.date(2016, 1, 1),), (dt.date(2021, 1, 1),), (dt.date(2024, 1, 1),), (dt.date(2000, 1, 1),)], "date date")
    assert [r[0] for r in periods.select(sample_period(periods.date, SampleSplits())).collect()] == ["development", "validation", "test", None]


def test_ranking_takes_the_first_of_ties(spark):
    c = spark.createDataFrame([("t", "regression", s, v) for s, v in (("pca_only", 0.3), ("ri_only", 0.3), ("benchmarks_only", None))], "target string, target_type string, information_set string, oos_r2 double")
    row = rank_information_sets(c).first()
    assert (row.best_information_set, row.n_candidates) == ("ri_only", 2.0)
    with pytest.raises(ValueError, match="Both stress and non-stress"):
        plotdata.stress_boxes(series(spark, [1, 2], "regime_indicator").selectExpr("*", "0 as systemic_stress_label"))


def test_heatmap_query_over_all_years(spark):
    import pandas as pd

    from meshwind import queries as Q

    folder = "/root/testdata/sf0.001"
    t = pd.read_parquet(f"{folder}/lineitem.parquet")
    want = t.groupby(["l_returnflag", t["l_shipdate"].dt.year])["l_extendedprice"].mean().unstack()
    rows = Q.queries()["chart_heatmap_all_years"](spark, folder).collect()
    assert len(rows) == len(want) and rows[0].__fields__[1:] == [f"y{y}" for y in want.columns] and len(want.columns) == 7
    for r in rows:
        assert np.allclose(list(r)[1:], want.loc[r.returnflag], atol=1e-6, equal_nan=True)


def test_network_queries_over_all_assets(spark):
    from meshwind import queries as Q

    folder, made = "/root/testdata/sf0.001", Q.queries()
    every = Q.Data(spark, folder)
    ri = {r.date: r.average_graph_strength for r in Q.flagship(spark, folder).collect()}
    got = [r for r in plotdata.feature_panel(every.ri(), ["average_graph_strength", "modularity", "laplacian_frobenius_change"]).collect() if r.feature == "average_graph_strength"]
    assert len(got) > 100 and all(abs(r.value - ri[r.date]) < 1e-5 for r in got)
    vol = {r.date: r.realized_volatility for r in made["realized_volatility"](spark, folder).collect() if r.realized_volatility is not None}
    days = sorted(d for d, x in ri.items() if x is not None and d in vol)
    slope, level = np.polyfit([vol[d] for d in days], [ri[d] for d in days], 1)
    out = {r.date: r.orthogonal_average_graph_strength for r in components.residualize(every.ri().select("date", "average_graph_strength"), every.vol(), "full_sample").collect()}
    assert all(abs(out[d] - (ri[d] - level - slope * vol[d])) < 1e-4 for d in days)


def test_least_angles_and_coordinates_agree():
    rnd = np.random.RandomState(4)
    for p in (2, 4, 9):
        x = rnd.normal(size=(80, p)) @ rnd.normal(size=(p, p))
        s = np.corrcoef(x.T)
        for alpha in (0.05, 0.2, 0.6):
            a, b = (K.graphical_lasso(s[None], alpha, 500, 1e-8, 1e-10, mode) for mode in ("cd", "lars"))
            assert a[2][0] and b[2][0] and np.abs(a[1] - b[1]).max() < 1e-4
    gram, xy = np.array([[1.0, 0.9], [0.9, 1.0]]), np.array([0.5, 0.48])
    beta = K.angle_lasso(gram, xy, 0.1)
    left = xy - gram @ beta
    assert np.abs(left).max() <= 0.1 + 1e-9 and np.allclose(left[beta != 0], 0.1 * np.sign(beta[beta != 0]))


def test_fit_of_one_window_records_convergence():
    x = np.random.RandomState(5).normal(size=(60, 4)) + 3.0
    fit = graph.fit_window(x, 0.1, assume_centered=False)
    assert fit.converged and fit.warning_messages == () and np.allclose(fit.covariance @ fit.precision, np.eye(4), atol=1e-2)
    assert not np.allclose(graph.fit_window(x, 0.1).covariance, fit.covariance)
    bad = graph.fit_window(np.random.RandomState(6).normal(size=(30, 8)) @ np.random.RandomState(7).normal(size=(8, 8)), 1e-4, max_iter=1, tol=1e-12)
    assert not bad.converged and "did not converge" in bad.warning_messages[0] and bad.n_iter == 1
    for kind, said in (({"alpha": 0.0}, "alpha must be positive"), ({"alpha": 0.1, "mode": "x"}, "mode must be either"), ({"alpha": 0.1, "enet_tol": 0.0}, "enet_tol must be positive")):
        with pytest.raises(ValueError, match=said):
            graph.fit_window(x, **kind)


def test_errors_of_unusable_input(spark):
    few = spark.createDataFrame([(day(k), a, 0.01 * k) for k in range(4) for a in "xy"], "date date, asset string, value double")
    with pytest.raises(ValueError, match="too few dates"):
        graph.rolling_graph_features(few, 10, 0.1)
    with pytest.raises(ValueError, match="two assets"):
        graph.rolling_graph_features(few.where("asset = 'x'"), 2, 0.1)
    with pytest.raises(ValueError, match="two assets"):
        stress.correlation_scores(few.where("asset = 'x'"), 3)
    with pytest.raises(ValueError, match="known price"):
        stress.market_drawdown(series(spark, [None, None], "value"))


def test_expanding_residuals_and_errors_by_definition():
    rnd = np.random.RandomState(8)
    x = rnd.normal(size=(90, 3)) * [1.0, 100.0, 0.01]
    x[:, 2] = x[:, 0] * 2  # collinear
    y = x[:, 0] + 0.01 * x[:, 1] + rnd.normal(size=90)
    y[5] = np.nan
    got, full = K.expanding_residuals(y, x, 20), np.flatnonzero(np.isfinite(y))
    for k, r in enumerate(full):
        design = np.c_[np.ones(k), x[full[:k]]]
        want = y[r] - np.r_[1.0, x[r]] @ np.linalg.pinv(design) @ y[full[:k]] if k >= 20 else np.nan
        assert (np.isnan(got[r]) and np.isnan(want)) or abs(got[r] - want) < 1e-7
    design = np.c_[np.ones(60), rnd.normal(size=(60, 2))]
    beta = np.array([0.5, 1.0, -2.0])
    e = rnd.normal(size=60)
    inverse, s = np.linalg.inv(design.T @ design), np.zeros((3, 3))
    for i in range(60):
        for j in range(60):
            if abs(i - j) <= 4:
                s += (1 - abs(i - j) / 5) * e[i] * e[j] * np.outer(design[i], design[j])
    assert np.allclose(K.hac_t(design, e, beta, 4), beta / np.sqrt(np.diag(inverse @ s @ inverse)))


def test_charts_are_png_files(spark, tmp_path):
    table = spark.createDataFrame([(day(k), float(k % 5), None if k == 3 else float(k)) for k in range(30)], "date date, a double, b double")
    for kind in ("lines", "points", "bars", "grid"):
        path = figures.save(table, f"{tmp_path}/{kind}.png", kind, "date", ["a", "b"])
        data = open(path, "rb").read()
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == figures.SIZE
        at, raw = 8, b""
        while at < len(data):
            n, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
            raw += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
            at += 12 + n
        pixels = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(figures.SIZE[1], 1 + 3 * figures.SIZE[0])[:, 1:]
        assert (pixels != 255).any()
    assert figures.encoded(figures.lines([])) and figures.encoded(figures.bars([None]))


def test_command_line_writes_tables_and_charts(spark, tmp_path):
    rnd = np.random.RandomState(3)
    rows = ["date,A,B,C"] + [f"{day(k)},{','.join(f'{v:.4f}' for v in 100 * np.exp(0.01 * rnd.normal(size=3)))}" for k in range(90)]
    (tmp_path / "p.csv").write_text("\n".join(rows))
    said = []
    a = cli.arguments([str(tmp_path / "p.csv"), "--out", str(tmp_path / "out"), "--workflow", "overlays", "--window", "30", "--alpha", "0.2"])
    tables = cli.run(spark, a, said.append)
    assert "overlay_performance_comparison" in tables and any("regime_indicator.png" in s for s in said)
    assert (tmp_path / "out/figures/drawdown.png").exists() and (tmp_path / "out/tables/overlay_exposure_summary").exists()
    assert cli.main([str(tmp_path / "none.csv"), "--out", str(tmp_path)]) == 1


def test_market_source_reads_a_symbol_a_partition(spark, tmp_path):
    (tmp_path / "yfinance.py").write_text("import pandas as pd\n\ndef download(names, **k):\n    days = pd.date_range(k['start'], periods=3)\n    return pd.DataFrame({('Close', names[0]): [1.0, 2.0, 3.0], ('Adj Close', names[0]): [4.0, None, 6.0]}, index=days)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "yfinance.py"))
    spark.dataSource.register(downloads.MarketSource)
    read = lambda **o: spark.read.format("market").options(**o).load()
    rows = read(symbols="SPY, TLT", start="2020-01-01").orderBy("asset", "date").collect()
    assert [(r.date, r.asset, r.value) for r in rows] == [(day(0), "SPY", 4.0), (day(2), "SPY", 6.0), (day(0), "TLT", 4.0), (day(2), "TLT", 6.0)]
    with pytest.raises(Exception, match="unknown provider"):
        read(provider="x", symbols="A").collect()
    with pytest.raises(Exception, match="pandas_datareader is required"):
        read(provider="fred", symbols="USREC").collect()
