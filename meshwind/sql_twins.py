"""SQL for chained operators: parts (common table expressions) that queries put together. Text only; nothing runs here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .operators.overlay import DIFFERENCES, PERFORMANCE, TURNOVER


def performance(source: str, by: str = "", out: str = "perf") -> str:
    """CTEs that end in ``out``: the performance metrics of ``source`` (by, date, r)."""
    b, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    return f"""{out}1 as (select {b}date, r, product(1 + greatest(r, -0.999999)) over ({part}order by date rows between unbounded preceding and current row) as w from {source} where r is not null),
{out}2 as (select *, w / max(w) over ({part}order by date rows between unbounded preceding and current row) - 1 as d from {out}1),
{out}3 as (select {b}arg_max(w, date) as w, count(r) as n, stddev_samp(r) * sqrt(252) as vol, stddev_samp(r) filter (where r < 0) * sqrt(252) as down, min(d) as mdd, avg(r) as mean, avg(abs(r)) as mabs, quantile_cont(r, 0.01) as q1, quantile_cont(r, 0.05) as q5, avg(case when r > 0 then 1.0 else 0.0 end) as hit from {out}2 {f'group by {by}' if by else ''}),
{out} as (select {b}case when w > 0 then w ** (252.0 / n) - 1 end as annualized_return, vol as annualized_volatility, case when vol > 0 then (w ** (252.0 / n) - 1) / vol end as sharpe, case when down > 0 then (w ** (252.0 / n) - 1) / down end as sortino, mdd as max_drawdown, case when mdd < 0 then (w ** (252.0 / n) - 1) / abs(mdd) end as calmar,
  mean as mean_return, mabs as mean_absolute_return, q1 as worst_1pct_return, q5 as worst_5pct_return, hit as hit_rate, cast(n as double) as n_obs from {out}3)"""


def turnover(source: str, by: str = "", out: str = "turn") -> str:
    b, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    return f"""{out}1 as (select {b}date, exposure, coalesce(abs(exposure - lag(exposure) over ({part}order by date)), 0) as c from {source} where exposure is not null),
{out} as (select {b}avg(exposure) as average_exposure, avg(case when exposure < 1 then 1.0 else 0.0 end) as time_in_reduced_exposure, sum(case when c > 1e-12 then 1.0 else 0.0 end) as number_of_exposure_changes, sum(c) * 252 / count(c) as annualized_turnover_proxy, avg(c) as mean_absolute_exposure_change, avg(case when exposure <= 0.5 then 1.0 else 0.0 end) as time_in_extreme_reduction from {out}1 {f'group by {by}' if by else ''})"""


def rounded(columns: Sequence[str], of: str = "") -> str:
    return ", ".join(f"round({of}{c}, 6) as {c}" for c in columns)


def minus(by: str, strategy: str = "strategy") -> str:
    over = f"over (partition by {by})" if by else "over ()"
    return ", ".join(f"round({c} - max(case when {strategy} = 'baseline' then {c} end) {over}, 6) as {c}_minus_baseline" for c in DIFFERENCES)


def z(columns: Mapping[str, str], by: str = "", where: str = "") -> str:
    """Select items: out = z score of a column (0 where it has no spread or is null), moments over rows that pass ``where``."""
    over, f = f"over (partition by {by})" if by else "over ()", f" filter (where {where})" if where else ""
    return ", ".join(f"coalesce(case when stddev_pop({c}){f} {over} > 0 then ({c} - avg({c}){f} {over}) / stddev_pop({c}){f} {over} else 0 end, 0) as {o}" for o, c in columns.items())


RULE = "case when {ok} and {v} >= x then 0.5 when {ok} and {v} >= h then 0.7 else 1.0 end"


def exposures(source: str, out: str, smooth: bool = False, least: int = 20, levels: str = "") -> str:
    """CTEs that end in ``out`` (k, variant, date, exposure) of ``source`` (k, date, v): the daily rule, or all seven.

    levels: a table (k, h, x, o) of fixed levels in place of quantiles of earlier rows."""
    kinds = [("raw", "v")] + ([("s5", "avg(v) over (partition by k order by date rows between 4 preceding and current row)"), ("s10", "avg(v) over (partition by k order by date rows between 9 preceding and current row)")] if smooth else [])
    made = f"{out}s as (" + " union all ".join(f"select '{n}' as sm, k, date, {c} as v from {source}" for n, c in kinds) + "),\n"
    if levels:
        made += f"{out}q as (select s.*, h, x, o, s.v is not null and h is not null as ok from {out}s s join {levels} using (k)),\n"
    else:
        made += f"""{out}p as (select *, quantile_cont(v, 0.8) over w as h, quantile_cont(v, 0.9) over w as x, quantile_cont(v, 0.6) over w as o, count(v) over w as c from {out}s window w as (partition by sm, k order by date rows between unbounded preceding and 1 preceding)),
{out}q as (select *, c >= {least} and v is not null as ok from {out}p),\n"""
    made += f"{out}r as (select sm, k, date, row_number() over (partition by sm, k order by date) as n, cast({RULE.format(ok='ok', v='v')} as double) as raw, case when not ok then null when v >= x then 0.5 when v >= h then 0.7 when v < o then 1.0 end as said from {out}q),\n"
    parts = [f"select k, 'daily' as variant, date, raw from {out}r where sm = 'raw'"]
    if smooth:
        made += f"""{out}c as (select k, n, date, raw as v, cast(-1000000000 as bigint) as at from {out}r where sm = 'raw' and n = 1
  union all select r.k, r.n, r.date, case when r.raw <> f.v and r.n - 1 - f.at <= 5 then f.v else r.raw end, case when r.raw <> f.v and r.n - 1 - f.at > 5 then r.n - 1 else f.at end from {out}c f join {out}r r on r.sm = 'raw' and r.k = f.k and r.n = f.n + 1),\n"""
        held = "coalesce(last_value(said ignore nulls) over (partition by sm, k order by date rows between unbounded preceding and current row), 1.0)"
        parts += [
            f"select k, 'smoothed_5d', date, raw from {out}r where sm = 's5'", f"select k, 'smoothed_10d', date, raw from {out}r where sm = 's10'", f"select k, 'hysteresis', date, {held} from {out}r where sm = 'raw'", f"select k, 'smoothed_5d_hysteresis', date, {held} from {out}r where sm = 's5'",
            f"select k, 'weekly', date, coalesce(last_value(case when isodow(date) = 1 or n = 1 then raw end ignore nulls) over (partition by k order by date rows between unbounded preceding and current row), 1.0) from {out}r where sm = 'raw'", f"select k, 'cooldown_5d', date, v from {out}c",
        ]
    return made + f"{out}a as (" + "\n union all ".join(parts) + f"),\n{out} as (select k, variant, date, cast(lag(raw, 1, 1.0) over (partition by k, variant order by date) as double) as exposure from {out}a)"


def solved(source: str, keys: str, out: str) -> str:
    """CTEs that end in ``out`` (keys, k, n, beta, inv): least squares of ``source`` (keys, y, x), where x starts with 1.

    The normal equations, with the identity and the right side beside them, are reduced a pivot at a time."""
    return f"""{out}m as (select {keys}, len(x) as k, i, j, sum(x[i] * case when j <= len(x) then x[j] else y end) as v, count(*) as n from {source}, unnest(generate_series(1, len(x))) as a(i), unnest(generate_series(1, len(x) + 1)) as b(j) group by all),
{out}w as (select {keys}, k, n, i, list(v order by j) as r from {out}m group by all),
{out}g as (select {keys}, k, n, 1 as s, list(list_concat(r[1:k], list_transform(generate_series(1, k), lambda j: case when j = i then 1.0::double else 0.0 end), [r[k + 1]]) order by i) as m from {out}w group by all
  union all select {keys}, k, n, s + 1, list_transform(m, lambda r, i: case when i = s then list_transform(r, lambda v: v / r[s]) else list_transform(r, lambda v, j: v - r[s] * m[s][j] / m[s][s]) end) from {out}g where s <= k),
{out} as (select {keys}, k, n, list_transform(m, lambda r: r[2 * k + 1]) as beta, list_transform(m, lambda r: r[k + 1:2 * k]) as inv from {out}g where s = k + 1)"""


def _classes(source: str, out: str) -> str:
    return f"""{out}r as (select *, rank() over (partition by target, model order by f) + (count(*) over (partition by target, model, f) - 1) / 2.0 as rk, least(greatest(f, 0), 1) as p from {source}),
{out} as (select target, model, auc, brier_score, pr as precision, re as recall, case when pr + re > 0 then 2 * pr * re / (pr + re) end as f1 from (select target, model, (sum(case when y = 1 then rk end) - sum(case when y = 1 then 1 end) * (sum(case when y = 1 then 1 end) + 1) / 2) / nullif(sum(case when y = 1 then 1 end) * sum(case when y = 0 then 1 end), 0) as auc, avg((p - y) ** 2) as brier_score,
  sum(case when p >= 0.5 and y = 1 then 1.0 else 0 end) / nullif(sum(case when p >= 0.5 then 1 else 0 end), 0) as pr, sum(case when p >= 0.5 and y = 1 then 1.0 else 0 end) / nullif(sum(case when y = 1 then 1 else 0 end), 0) as re from {out}r group by target, model))"""


def models(rows: str, onset: str = "stress_onset_label") -> str:
    """CTEs that end in ``fits`` (target, model, n_obs, n_positive, metrics, beta, se) of ``rows`` (target, model, date, y, x, period); lags of 5."""
    return f"""ob as (select target, model, date, y, list_prepend(1.0::double, x) as x, period, row_number() over (partition by target, model order by date) as n from {rows}),
fi as (select 'all' as fit, * from ob union all select 'train', * from ob where period in ('development', 'validation')),
{solved('fi', 'fit, target, model', 'eq')},
ys as (select fit, target, model, avg(y) as ybar, stddev_pop(y) as sy from fi group by all),
be as (select eq.*, ybar from eq join ys using (fit, target, model) where eq.n > k and sy > 1e-8),
rs as (select o.target, o.model, o.date, o.n, o.y, k, list_dot_product(x, beta) as f, o.y - list_dot_product(x, beta) as e, list_transform(inv, lambda r: list_dot_product(r, x)) as ix from ob o join be on be.fit = 'all' and be.target = o.target and be.model = o.model),
s1 as (select target, model, 1 - (sum(e * e) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - any_value(k)) as adjusted_r2, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae from rs group by all),
ia as (select target, model, n, i, e * ix[i] as a from rs, unnest(generate_series(1, k)) as u(i)),
hv as (select p.target, p.model, p.i, sqrt(greatest(sum(case when p.n = q.n then 1 else 2 * (1 - (p.n - q.n) / 6.0) end * p.a * q.a), 0)) as se from ia p join ia q on p.target = q.target and p.model = q.model and p.i = q.i and p.n - q.n between 0 and 5 group by all),
hl as (select target, model, list(se order by i) as se from hv group by all),
{_classes(f"(select * from rs where target = '{onset}')", 'c1')},
ts as (select o.target, o.model, o.y, list_dot_product(x, beta) as f, ybar from ob o join be on be.fit = 'train' and be.target = o.target and be.model = o.model where period = 'test'),
s2 as (select target, model, 1 - sum((y - f) ** 2) / nullif(sum((y - ybar) ** 2), 0) as oos_r2, sqrt(avg((y - f) ** 2)) as oos_rmse, avg(abs(y - f)) as oos_mae from ts group by all having count(*) >= 3),
{_classes(f"(select * from ts where target = '{onset}')", 'c2')},
fits as (select a.target, a.model, a.n_obs, a.n_positive, adjusted_r2, rmse, mae, c1.auc, c1.brier_score, c1.precision, c1.recall, c1.f1, oos_r2, oos_rmse, oos_mae, case when oos_rmse is not null then c2.auc end as oos_auc, case when oos_rmse is not null then c2.brier_score end as oos_brier_score,
  case when oos_rmse is not null then c2.precision end as oos_precision, case when oos_rmse is not null then c2.recall end as oos_recall, case when oos_rmse is not null then c2.f1 end as oos_f1, be.beta, hl.se
  from (select target, model, cast(count(*) as double) as n_obs, cast(sum(case when y = 1 then 1 else 0 end) as double) as n_positive from ob group by all) a
  left join s1 using (target, model) left join c1 using (target, model) left join s2 using (target, model) left join c2 using (target, model) left join be on be.fit = 'all' and be.target = a.target and be.model = a.model left join hl on hl.target = a.target and hl.model = a.model)"""


def sign(c: str) -> str:
    return f"case when {c} is null or abs({c}) <= 1e-8 then 'zero_or_unstable' when {c} > 0 then 'positive' else 'negative' end"


def specs_rows(specs: Mapping[str, Sequence[str]], design: str, target: str, period: str) -> str:
    """rows (target, model, date, y, x, period): each model's complete rows."""
    each = [f"select '{m}' as model, date, [{', '.join(f'{c}::double' for c in cols)}] as x from {design} where {' and '.join(f'{c} is not null' for c in cols)}" for m, cols in specs.items()]
    return "md as (" + " union all ".join(each) + f"), rows_ as (select target, model, date, y, x, coalesce({period}, '') as period from {target} join md using (date) where y is not null)"


def regressors(specs: Mapping[str, Sequence[str]]) -> str:
    return "rg(model, i, regressor) as (values " + ", ".join(f"('{m}', {i + 2}, '{c}')" for m, cols in specs.items() for i, c in enumerate(cols)) + ")"


PERF, TURN = rounded(PERFORMANCE), rounded(TURNOVER)


def lasso(source: str, alphas: Sequence[float], sweeps: int = 200) -> str:
    """Graphical lasso of three assets by recursion: ``source`` has the date and the correlations x (1, 2), y (1, 3), z (2, 3). A sweep
    takes the columns in turn; bij is the coefficient of asset j in the regression of asset i, wij the covariance fitted."""
    soft = lambda v: f"sign({v}) * greatest(abs({v}) - alpha, 0.0)"

    def column(v: str, s1: str, s2: str, old: str, n1: str, n2: str, f1: str, f2: str) -> str:
        return f"{soft(f'({s1} - {v} * {old})')} as {n1}, {soft(f'({s2} - {v} * {n1})')} as {n2}, {n1} + {v} * {n2} as {f1}, {v} * {n1} + {n2} as {f2}"

    steps = ", ".join([column("w23", "x", "y", "b13", "n12", "n13", "u12", "u13"), column("u13", "x", "z", "b23", "n21", "n23", "v12", "v23"), column("v12", "y", "z", "b32", "n31", "n32", "v13", "t23")])
    values = ", ".join(f"({a})" for a in alphas)
    zeros = ", ".join(f"0.0::double as b{k}" for k in ("12", "13", "21", "23", "31", "32"))
    moved = ", ".join(f"n{k}" for k in ("12", "13", "21", "23", "31", "32"))
    return f"""select cast(alpha as double) as alpha, date, x, y, z, 0 as k, 0.95 * x as w12, 0.95 * y as w13, 0.95 * z as w23, {zeros} from (select * from {source}) cross join (values {values}) as al(alpha)
  union all select alpha, date, x, y, z, k + 1, v12, v13, t23, {moved} from (select *, {steps} from ls where k < {sweeps})"""


def partials(source: str, sweeps: int = 200) -> str:
    """Absolute partial correlations a (1, 2), b (1, 3), c (2, 3) of the last sweep."""
    return f"""select alpha, date, least(abs(b21) * d2 / sqrt(d1 * d2), 1.0) as a, least(abs(b31) * d3 / sqrt(d1 * d3), 1.0) as b, least(abs(b32) * d3 / sqrt(d2 * d3), 1.0) as c
  from (select *, 1 / (1 - w12 * b12 - w13 * b13) as d1, 1 / (1 - w12 * b21 - w23 * b23) as d2, 1 / (1 - w13 * b31 - w23 * b32) as d3 from {source} where k = {sweeps})"""


def network(source: str, by: str = "") -> str:
    """Features of graphs of three nodes with edges a, b, c: the Laplacian's eigenvalues are 0 and s -+ r; greedy merging joins the best
    linked pair if that gains, then all if that gains more."""
    part = f"partition by {by} " if by else ""
    keys = f"{by}, " if by else ""
    diffs = ", ".join(f"{x} - lag({x}) over ({part}order by date) as d{x}" for x in "abc")
    gains = ", ".join(f"case when {e} > 0 then 2 * ({e} / (2 * s) - {i} * {j}) end" for e, i, j in (("a", "k1", "k2"), ("b", "k1", "k3"), ("c", "k2", "k3")))
    return f"""select {keys}date, 2 * s / 3 as average_graph_strength, s / 3 as weighted_edge_density, greatest(s - r, 0.0) as algebraic_connectivity, s + r as largest_laplacian_eigenvalue, case when s > 0 then (s + r) / (2 * s) else 0.0 end as largest_laplacian_eigenvalue_share,
  sqrt((da + db) ** 2 + (da + dc) ** 2 + (db + dc) ** 2 + 2 * (da ** 2 + db ** 2 + dc ** 2)) as laplacian_frobenius_change, cast((a > 0)::int + (b > 0)::int + (c > 0)::int as double) as number_of_edges, 2 * s / 3 as average_node_strength,
  case when s > 0 then case when gain > 0 then greatest(gain - k1 ** 2 - k2 ** 2 - k3 ** 2, 0.0) else -(k1 ** 2) - k2 ** 2 - k3 ** 2 end end as modularity
  from (select *, greatest({gains}) as gain from (select *, (a + b) / (2 * s) as k1, (a + c) / (2 * s) as k2, (b + c) / (2 * s) as k3 from (select *, a + b + c as s, sqrt(greatest(a * a + b * b + c * c - a * b - a * c - b * c, 0.0)) as r, {diffs} from {source})))"""


def spectrum(source: str) -> str:
    """First eigenvalue e, its share s and the effective rank k of correlation matrices of three assets, in closed form."""
    entropy = " + ".join(f"case when {v} > 0 then {v} / 3 * ln({v} / 3) else 0 end" for v in ("e1", "e2", "e3"))
    return f"""select date, case when ok then e1 end as e, case when ok then e1 / 3 end as s, case when ok then exp(-({entropy})) end as k from (select *, 3 - e1 - e3 as e2 from (select *, 1 + 2 * p * cos(t) as e1, 1 + 2 * p * cos(t + 2 * pi() / 3) as e3
  from (select *, case when p > 0 then acos(greatest(least(x * y * z / p ** 3, 1.0), -1.0)) / 3 else 0 end as t from (select *, sqrt((x * x + y * y + z * z) / 3) as p from {source}))))"""
