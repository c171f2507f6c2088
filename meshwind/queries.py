"""The regime engine's operators as queries over a folder of tables, with equivalent SQL where SQL can express them.

Prices are weekly panels of the star schema; a series of realized volatility stands in for the indicator where only
relational operators are shown, and a panel of two assets (suppliers by parity) where the network has a closed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import melt, num
from .operators import components, evaluate, graph, models, overlay, selection, stress
from .operators import returns as ret
from . import sql_twins as twin
from .plans import plotdata, workflows
from .sources import panels

SPLITS = models.SampleSplits("1995-01-01", "1997-12-31", "1998-01-01", "1998-12-31", "1999-01-01")
ORIGINS = selection.origin_splits((1999, 2000, 2001), "1995-01-01")
WINDOW, ALPHA = 52, 0.05
FIT = {"tol": 1e-12, "enet_tol": 1e-13}
EVENTS = ("1994-01-01", "1996-03-15", "1999-06-01", "2005-01-01")


class Data:
    """The panels and series that queries share, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept = spark, sf_dir, {}

    def _keep(self, name: str, make) -> DataFrame:
        """Date-level frames that a query uses more than once are written, so that plans stay short."""
        if name not in self._kept:
            self._kept[name] = panels.stored(make())
        return self._kept[name]

    def prices(self, which: str = "W4") -> DataFrame:
        return self._keep(f"p{which}", lambda: panels.star_panel(self.spark, self.dir, which))

    def returns(self, which: str = "W4") -> DataFrame:
        return self._keep(f"r{which}", lambda: ret.prices_to_returns(self.prices(which)))

    def pca(self) -> DataFrame:
        return self._keep("pca", lambda: graph.rolling_pca_features(self.three(), WINDOW))

    def two(self, *columns: str) -> DataFrame:
        return self.net().select("date", *columns)

    def pair(self) -> DataFrame:
        return self._keep("rpair", lambda: ret.prices_to_returns(self.prices("W2")))

    def three(self) -> DataFrame:
        return self._keep("rthree", lambda: ret.prices_to_returns(self.prices("W3")))

    def net(self) -> DataFrame:
        """Networks of three assets and their indicator, fitted to the last digits, as the equivalent SQL is."""
        made = lambda: graph.rolling_graph_features(self.three(), WINDOW, ALPHA, partial_corr_threshold=0.0, max_iter=1000, **FIT)
        return self._keep("net", lambda: graph.regime_indicator(self._keep("nets", made)))

    def index(self) -> DataFrame:
        return self.prices().groupBy("date").agg(F.avg("value").alias("value"))

    def vix(self) -> DataFrame:
        return workflows.vix_proxy(self.spark.read.parquet(f"{self.dir}/orders.parquet"))

    def vol(self) -> DataFrame:
        return self._keep("vol", lambda: stress.realized_volatility(self.returns()))

    def labels(self) -> DataFrame:
        return self._keep("labels", lambda: stress.stress_labels(self.vix(), stress.market_drawdown(self.index()), self.vol(), vix_threshold=140.0))

    def signal(self) -> DataFrame:
        return self.vol().withColumnRenamed("realized_volatility", "regime_indicator")

    def score(self) -> DataFrame:
        return self.vol().withColumnRenamed("realized_volatility", "score")

    def portfolio(self) -> DataFrame:
        return self._keep("portfolio", lambda: ret.portfolio_returns(self.returns()))

    def benchmarks(self) -> DataFrame:
        return self._keep("benchmarks", lambda: workflows.benchmark_table(self.index(), self.returns(), self.vix(), corr_window=WINDOW, vix_threshold=140.0))

    def ri(self, two: bool = False) -> DataFrame:
        made = lambda: graph.rolling_graph_features(self.pair() if two else self.returns(), WINDOW, ALPHA, partial_corr_threshold=0.0, max_iter=1000)
        return self._keep(f"ri{two}", lambda: graph.regime_indicator(self._keep(f"features{two}", made)))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, 6) + 0.0).alias(f.name) if kind == "double" and f.name not in keep else c.cast("bigint").alias(f.name) if kind in ("int", "bigint") else c)
    return df.select(*out)


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = lambda spark, sf_dir: rounded(f(Data(spark, sf_dir)))
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


CTES = {
    "p": "select cast(date_trunc('week', l_shipdate) as date) as date, 's' || cast(l_suppkey % 4 as varchar) as asset, avg(l_extendedprice) as value from lineitem group by all",
    "d": "select a.date, b.asset, p.value from (select distinct date from p) a cross join (select distinct asset from p) b left join p on p.date = a.date and p.asset = b.asset",
    "r0": "select date, asset, ln(value / lag(value) over (partition by asset order by date)) as value from d",
    "r": "select * from r0 where date in (select date from r0 group by date having count(value) > 0)",
    "m": "select date, avg(value) as ret from r group by date",
    "vol": "select date, case when count(ret) over w = 21 then stddev_samp(ret) over w * sqrt(252) end as v from m window w as (order by date rows between 20 preceding and current row)",
    "idx": "select date, avg(value) as value from p group by date",
    "dd": "select date, value / max(value) over (order by date rows between unbounded preceding and current row) - 1 as drawdown from idx",
    "vx": "select cast(date_trunc('week', o_orderdate) as date) as date, stddev_samp(o_totalprice) / 1000 as vix from orders group by 1",
    "b": "select coalesce(vx.date, dd.date, vol.date) as date, vix, drawdown, v as realized_volatility from vx full join dd on dd.date = vx.date full join vol on vol.date = coalesce(vx.date, dd.date)",
    "lab": "select b.*, case when vix is null then null when vix >= 140 then 1 else 0 end as vix_stress_label, case when drawdown is null then null when drawdown <= -0.1 then 1 else 0 end as drawdown_stress_label, "
    "case when realized_volatility is null then null when realized_volatility >= (select quantile_cont(realized_volatility, 0.8) from b) then 1 else 0 end as realized_volatility_stress_label from b",
    "labs": "select *, greatest(coalesce(vix_stress_label, 0), coalesce(drawdown_stress_label, 0), coalesce(realized_volatility_stress_label, 0)) as systemic_stress_label from lab",
    "ons0": "select date, systemic_stress_label as l, row_number() over (order by date) as n from labs",
    "ons": "select date, case when l = 1 and coalesce(lag(l) over (order by date), 0) = 0 and n - coalesce(max(case when l <> 0 then n end) over (order by date rows between unbounded preceding and 1 preceding), 0) - 1 >= 20 then 1 else 0 end as stress_onset_label from ons0",
    "e0": "select date, v, quantile_cont(v, 0.8) over w as h, quantile_cont(v, 0.9) over w as x, quantile_cont(v, 0.6) over w as o, count(v) over w as c from vol window w as (order by date rows between unbounded preceding and 1 preceding)",
    "e1": "select *, case when c >= 20 and v >= x then 0.5 when c >= 20 and v >= h then 0.7 else 1.0 end as raw from e0",
    "e": "select date, cast(lag(raw, 1, 1.0) over (order by date) as double) as exposure from e1",
    "o": "select m.date, coalesce(exposure, 1.0) as exposure, ret * coalesce(exposure, 1.0) as oret, ret from m join e on e.date = m.date where ret is not null",
    "t": "select date, " + ", ".join(f"case when count(ret) over w{h} = {h} then stddev_samp(ret) over w{h} end as vol{h}, case when count(ret) over w{h} = {h} then sum(ret) over w{h} end as sum{h}" for h in (5, 21)) + " from m window " + ", ".join(f"w{h} as (order by date rows between 1 following and {h} following)" for h in (5, 21)),
    "p2": "select cast(date_trunc('week', l_shipdate) as date) as date, 's' || cast(l_suppkey % 2 as varchar) as asset, avg(l_extendedprice) as value from lineitem group by all",
    "pr0": "select date, max(case when asset = 's0' then value end) as a, max(case when asset = 's1' then value end) as c from (select date, asset, ln(value / lag(value) over (partition by asset order by date)) as value from (select x.date, y.asset, p2.value from (select distinct date from p2) x cross join (select distinct asset from p2) y left join p2 on p2.date = x.date and p2.asset = y.asset)) group by date",
    "pr": "select * from pr0 where a is not null or c is not null",
    "prc": "select * from pr where a is not null and c is not null",
    "h0": "select date, row_number() over (order by date) as n, covar_pop(a, c) over w / (stddev_pop(a) over w * stddev_pop(c) over w) as rho from prc window w as (order by date rows between 51 preceding and current row)",
    "h1": "select date, greatest(abs(rho) - 0.05, 0.0) as a from h0 where n >= 52",
    "h": "select date, a as average_graph_strength, a as weighted_edge_density, 2 * a as algebraic_connectivity, 2 * a as largest_laplacian_eigenvalue, case when a > 0 then 1.0 else 0.0 end as largest_laplacian_eigenvalue_share, 2 * abs(a - lag(a) over (order by date)) as laplacian_frobenius_change, case when a > 0 then 1.0 else 0.0 end as number_of_edges, a as average_node_strength, case when a > 0 then 0.0 end as modularity from h1",
    "p3": "select cast(date_trunc('week', l_shipdate) as date) as date, l_returnflag as asset, avg(l_extendedprice) as value from lineitem group by all",
    "nr0": "select date, max(case when asset = 'A' then value end) as a, max(case when asset = 'N' then value end) as c, max(case when asset = 'R' then value end) as e from (select date, asset, ln(value / lag(value) over (partition by asset order by date)) as value from (select x.date, y.asset, p3.value from (select distinct date from p3) x cross join (select distinct asset from p3) y left join p3 on p3.date = x.date and p3.asset = y.asset)) group by date",
    "nr": "select * from nr0 where a is not null or c is not null or e is not null",
    "nrc": "select * from nr where a is not null and c is not null and e is not null",
    "g0": "select date, row_number() over (order by date) as n, corr(a, c) over w as x, corr(a, e) over w as y, corr(c, e) over w as z from nrc window w as (order by date rows between 51 preceding and current row)",
    "ls": twin.lasso("g0 where n >= 52", (0.05, 0.1, 0.2)),
    "lp": twin.partials("ls"),
    "g1": "select * from lp where alpha = 0.05",
    "g": twin.network("g1"),
    "pc0": "select date, n, least(ca, cc, ce) >= 42 as ok, coalesce(x, 0) as x, coalesce(y, 0) as y, coalesce(z, 0) as z from (select date, row_number() over (order by date) as n, count(a) over v as ca, count(c) over v as cc, count(e) over v as ce, corr(a, c) over v as x, corr(a, e) over v as y, corr(c, e) over v as z from nr window v as (order by date rows between 51 preceding and current row)) where n >= 52",
    "pc1": twin.spectrum("pc0"),
    "pc": "select date, e as pca_first_eigenvalue, s as pca_first_eigenvalue_share, k as pca_effective_rank, e - last_value(e ignore nulls) over w as pca_first_eigenvalue_change, k - last_value(k ignore nulls) over w as pca_effective_rank_change from pc1 window w as (order by date rows between unbounded preceding and 1 preceding)",
    "zs": "select g.*, " + twin.z({f"z_{c}": c for c in components.COMPONENTS}) + " from g",
    "ri": "select *, z_average_graph_strength + z_algebraic_connectivity + z_largest_laplacian_eigenvalue_share + z_laplacian_frobenius_change as regime_indicator from zs",
    "sco": "select *, z_average_graph_strength + z_algebraic_connectivity + z_weighted_edge_density as connectivity_score, z_laplacian_frobenius_change as transition_score, z_largest_laplacian_eigenvalue_share as spectral_score, (" + " + ".join(f"z_{c}" for c in components.COMPONENTS) + ") / 6 as graph_components_equal_weight_score from ri",
    "gd": "select x.date, y.asset, r.value from (select distinct date from r) x cross join (select distinct asset from r) y left join r on r.date = x.date and r.asset = y.asset",
    "co0": "select a.date, a.asset || '~' || b.asset as pair, case when b.value is not null then a.value end as x, case when a.value is not null then b.value end as y from gd a join gd b on a.date = b.date and a.asset < b.asset",
    "co1": "select date, row_number() over (partition by pair order by date) as n, covar_pop(x, y) over w / nullif(stddev_pop(x) over w * stddev_pop(y) over w, 0) as c from co0 window w as (partition by pair order by date rows between 51 preceding and current row)",
    "co": "select date, avg(c) as average_correlation, avg(abs(c)) as average_absolute_correlation from co1 where n >= 52 group by date",
    "bm0": "select coalesce(labs.date, co.date) as date, vix, drawdown, realized_volatility, average_correlation, average_absolute_correlation, vix_stress_label, drawdown_stress_label, realized_volatility_stress_label, systemic_stress_label from labs full join co on co.date = labs.date",
    "bm": "select * replace (greatest(coalesce(systemic_stress_label, 0), case when average_correlation >= (select quantile_cont(average_correlation, 0.8) from bm0) then 1 else 0 end) as systemic_stress_label), case when average_correlation is null then null when average_correlation >= (select quantile_cont(average_correlation, 0.8) from bm0) then 1 else 0 end as correlation_stress_label from bm0",
    "fw": "select a.date, h, b.n - a.n as k, sum(b.ret) over (partition by h, a.n order by b.n) as c from (select *, row_number() over (order by date) as n from m) a cross join (values (5), (21)) as hs(h) join (select *, row_number() over (order by date) as n from m) b on b.n between a.n + 1 and a.n + h",
    "fd": "select h, date, case when count(c) = h then least(0, min(d)) end as v from (select *, (1 + c) / greatest(1, max(1 + c) over (partition by h, date order by k)) - 1 as d from fw) group by h, date",
    "tg": "select date, 'realized_volatility_5d' as target, vol5 as y from t union all select date, 'realized_volatility_21d', vol21 from t union all select date, 'max_drawdown_' || h || 'd', v from fd union all select date, 'stress_onset_label', stress_onset_label from ons",
}
_NEEDS = {
    "p": "", "d": "p", "r0": "d", "r": "r0", "m": "r", "vol": "m", "idx": "p", "dd": "idx", "vx": "", "b": "vx dd vol", "lab": "b", "labs": "lab", "ons0": "labs", "ons": "ons0", "e0": "vol", "e1": "e0", "e": "e1", "o": "m e", "t": "m", "pr0": "p2", "pr": "pr0", "prc": "pr", "h0": "prc", "h1": "h0", "h": "h1", "p2": "", "p3": "", "nr0": "p3", "nr": "nr0", "nrc": "nr", "g0": "nrc", "ls": "g0", "lp": "ls", "g1": "lp", "g": "g1", "zs": "g", "ri": "zs", "sco": "ri", "pc0": "nr", "pc1": "pc0", "pc": "pc1", "gd": "r", "co0": "gd", "co1": "co0", "co": "co1", "bm0": "labs co", "bm": "bm0", "fw": "m", "fd": "fw", "tg": "t fd ons",
}


def sql(needs: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """The body after the CTEs it needs, in order of definition; extra: further CTEs of its own."""
    want, stack = set(), needs.split()
    while stack:
        if (n := stack.pop()) not in want:
            want.add(n)
            stack += _NEEDS[n].split()
    parts = [f"{n} as ({CTES[n]})" for n in CTES if n in want] + ([extra] if extra else [])
    return f"with {'recursive ' if recursive or 'ls' in want else ''}" + ",\n".join(parts) + "\n" + body


PERF, TURN = twin.PERF, twin.TURN
_perf, _turn = twin.performance, twin.turnover

# ---- panels, returns, benchmarks


@query("weekly_prices", sql("d", "select date, asset, round(value, 6) as value from d"))
def _(d):
    return ret.dense(d.prices())


@query("log_returns", sql("r", "select date, asset, round(value, 6) as value from r"))
def _(d):
    return d.returns()


_DAY = "p as (select cast(l_shipdate as date) as date, 's' || cast(l_suppkey % 4 as varchar) as asset, avg(l_extendedprice) as value from lineitem group by all), d as (" + CTES["d"] + "), "


@query("simple_returns_with_gaps", "with " + _DAY + "q as (select date, asset, value / lag(value) over (partition by asset order by date) - 1 as value from d) select date, asset, round(value, 6) as value from q where date in (select date from q group by date having count(value) > 0)")
def _(d):
    return ret.prices_to_returns(d.prices("D4"), "simple")


@query("clean_returns", "with " + _DAY + """r0 as (select date, asset, ln(value / lag(value) over (partition by asset order by date)) as value from d), r as (select * from r0 where date in (select date from r0 group by date having count(value) > 0)),
k as (select asset from r group by asset having count(value) >= 0.3 * (select count(distinct date) from r)), s as (select * from r where asset in (select asset from k) and value is not null)
select date, asset, round(value, 6) as value from s where date in (select date from s group by date having count(*) = (select count(*) from k))""")
def _(d):
    return ret.clean_returns(ret.prices_to_returns(d.prices("D4")), 0.3)


@query("portfolio_returns", sql("m", "select date, round(ret, 6) as ret from m"))
def _(d):
    return d.portfolio()


@query("weighted_portfolio", sql("r", "select date, round(sum(value * case asset when 's0' then 0.5 when 's1' then 0.25 when 's2' then 0.25 else 0.0 end), 6) as ret from r group by date"))
def _(d):
    return ret.portfolio_returns(d.returns(), {"s0": 2.0, "s1": 1.0, "s2": 1.0})


@query("market_return_of_asset", sql("r", "select date, round(value, 6) as ret from r where asset = 's1'"))
def _(d):
    return ret.market_return(d.returns(), "s1")


@query("realized_volatility", sql("vol", "select date, round(v, 6) as realized_volatility from vol"))
def _(d):
    return d.vol()


@query("market_drawdown", sql("dd", "select date, round(drawdown, 6) as drawdown from dd"))
def _(d):
    return stress.market_drawdown(d.index())


_CORR = """x as (select a.date, a.asset || '~' || b.asset as pair, a.value as x, b.value as y from (select g.date, g.asset, r.value from (select * from (select distinct date from r) cross join (select distinct asset from r)) g left join r using (date, asset)) a
  join (select g.date, g.asset, r.value from (select * from (select distinct date from r) cross join (select distinct asset from r)) g left join r using (date, asset)) b on a.date = b.date and a.asset < b.asset),
y as (select date, pair, case when x is not null and y is not null then x end as x, case when x is not null and y is not null then y end as y from x),
z as (select date, row_number() over (partition by pair order by date) as n, covar_pop(x, y) over w / nullif(stddev_pop(x) over w * stddev_pop(y) over w, 0) as c from y window w as (partition by pair order by date rows between 51 preceding and current row))"""


@query("average_correlation", sql("r", "select date, round(avg(c), 6) as average_correlation from z where n >= 52 group by date", _CORR))
def _(d):
    return stress.correlation_score(d.returns(), WINDOW)


@query("average_absolute_correlation", sql("r", "select date, round(avg(abs(c)), 6) as average_absolute_correlation from z where n >= 52 group by date", _CORR))
def _(d):
    return stress.correlation_score(d.returns(), WINDOW, True)


@query("stress_labels", sql("labs", "select date, round(vix, 6) as vix, round(drawdown, 6) as drawdown, round(realized_volatility, 6) as realized_volatility, " + ", ".join(f"cast({c} as bigint) as {c}" for c in ("vix_stress_label", "drawdown_stress_label", "realized_volatility_stress_label", "systemic_stress_label")) + " from labs"))
def _(d):
    return d.labels()


@query("stress_onsets", sql("ons", "select date, cast(stress_onset_label as bigint) as stress_onset_label from ons"))
def _(d):
    return stress.stress_onsets(d.labels())


@query("benchmark_changes", sql("b", "select date, " + ", ".join(f"round({c} - lag({c}) over (order by date), 6) as {c}_change" for c in ("vix", "realized_volatility", "drawdown")) + " from b"))
def _(d):
    return stress.benchmark_changes(d.labels())


# ---- targets, diagnostics, regimes


@query("forward_targets", sql("m", """select date, round(case when n = 5 then v end, 6) as forward_realized_volatility_5d, round(case when n = 5 then s end, 6) as forward_return_sum_5d, round(case when n = 5 then abs(s) end, 6) as forward_absolute_return_sum_5d,
  round(case when n = 5 then least(0, 1 + c1 - greatest(1, 1 + c1), (1 + c1) / greatest(1, 1 + c1) - 1, (1 + c2) / greatest(1, 1 + c1, 1 + c2) - 1, (1 + c3) / greatest(1, 1 + c1, 1 + c2, 1 + c3) - 1, (1 + c4) / greatest(1, 1 + c1, 1 + c2, 1 + c3, 1 + c4) - 1, (1 + c5) / greatest(1, 1 + c1, 1 + c2, 1 + c3, 1 + c4, 1 + c5) - 1) end, 6) as forward_max_drawdown_5d from f""",
    "f0 as (select date, ret, " + ", ".join(f"lead(ret, {k}) over (order by date) as r{k}" for k in range(1, 6)) + ", count(ret) over w as n, stddev_samp(ret) over w as v, sum(ret) over w as s from m window w as (order by date rows between 1 following and 5 following)), f as (select *, r1 as c1, r1 + r2 as c2, r1 + r2 + r3 as c3, r1 + r2 + r3 + r4 as c4, r1 + r2 + r3 + r4 + r5 as c5 from f0)").replace("1 + c1 - greatest(1, 1 + c1), ", ""))
def _(d):
    return evaluate.forward_targets(d.returns(), [5])


_AL = "al as (select vol.date, vol.v as x, vix, drawdown, vix_stress_label, drawdown_stress_label, systemic_stress_label from vol join labs on labs.date = vol.date where vol.v is not null)"


@query("align_indicator", sql("vol labs", "select date, round(x, 6) as regime_indicator, round(vix, 6) as vix, cast(systemic_stress_label as bigint) as systemic_stress_label from al", _AL))
def _(d):
    return evaluate.align(d.signal(), d.labels().select("date", "vix", "systemic_stress_label"))


_DIAG = _AL + """, lb as (select x, 'vix_stress_label' as benchmark, vix_stress_label as l from al union all select x, 'drawdown_stress_label', drawdown_stress_label from al union all select x, 'systemic_stress_label', systemic_stress_label from al),
s as (select benchmark, cast(count(*) as double) as n, cast(count(*) filter (where l = 1) as double) as n1, cast(count(*) filter (where l = 0) as double) as n0, avg(x) filter (where l = 1) as m1, avg(x) filter (where l = 0) as m0, var_samp(x) filter (where l = 1) as v1, var_samp(x) filter (where l = 0) as v0, quantile_cont(x, 0.5) filter (where l = 1) as q1, quantile_cont(x, 0.5) filter (where l = 0) as q0 from lb where l is not null group by benchmark),
cb0 as (select 'vix' as benchmark, x, vix as y from al where vix is not null union all select 'drawdown', x, drawdown from al where drawdown is not null),
cb as (select *, rank() over (partition by benchmark order by x) + (count(*) over (partition by benchmark, x) - 1) / 2.0 as rx, rank() over (partition by benchmark order by y) + (count(*) over (partition by benchmark, y) - 1) / 2.0 as ry from cb0),
c as (select benchmark, cast(count(*) as double) as n, corr(x, y) as pe, corr(rx, ry) as sp from cb group by benchmark),
u as (select 'stress_label' as diagnostic_type, benchmark, unnest(['n_total', 'n_stress', 'n_non_stress', 'mean_indicator_stress', 'mean_indicator_non_stress', 'median_indicator_stress', 'median_indicator_non_stress', 'difference_in_means', 'ratio_stress_to_non_stress', 'welch_t_statistic']) as metric,
  unnest([n, n1, n0, m1, m0, q1, q0, m1 - m0, m1 / nullif(m0, 0), case when n1 >= 2 and n0 >= 2 then (m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0) end]) as value from s
  union all select 'continuous_benchmark', benchmark, unnest(['n_obs', 'pearson_correlation', 'spearman_correlation']), unnest([n, pe, sp]) from c)"""


@query("contemporaneous_diagnostics", sql("vol labs", "select diagnostic_type, benchmark, metric, round(value, 6) as value from u", _DIAG))
def _(d):
    al = evaluate.align(d.signal(), d.labels().select("date", "vix", "drawdown", "vix_stress_label", "drawdown_stress_label", "systemic_stress_label"))
    return evaluate.contemporaneous_diagnostics(al)


_PRED = """j as (select v as x, unnest(['forward_realized_volatility_5d', 'forward_return_sum_5d', 'forward_realized_volatility_21d', 'forward_return_sum_21d']) as target, unnest([vol5, sum5, vol21, sum21]) as y from vol join t on t.date = vol.date),
k as (select *, rank() over (partition by target order by x) + (count(*) over (partition by target, x) - 1) / 2.0 as rx, rank() over (partition by target order by y) + (count(*) over (partition by target, y) - 1) / 2.0 as ry from j where x is not null and y is not null),
s as (select target, cast(count(*) as double) as n, corr(x, y) as pe, corr(rx, ry) as sp, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) as sse from k group by target)"""


@query("predictive_power", sql("vol t", "select target, unnest(['n_obs', 'pearson_correlation', 'spearman_correlation', 'ols_beta', 'ols_intercept', 'ols_beta_t_stat', 'r_squared']) as metric, round(unnest([n, pe, sp, b, a, b / sqrt(sse / (n - 2) / sxx), r2]), 6) as value from s", _PRED))
def _(d):
    t = evaluate.forward_targets(d.returns(), [5, 21])
    return evaluate.predictive_power(d.signal(), t.select("date", *[f"forward_{k}_{h}d" for h in (5, 21) for k in ("realized_volatility", "return_sum")]))


@query("event_study", sql("vol", "select event_date, matched_date, n - pos as relative_day, round(v, 6) as regime_indicator from x join q on n between pos - 3 and pos + 2",
    "q as (select date, v, row_number() over (order by date) as n from vol), ev as (select cast(unnest(['" + "', '".join(EVENTS) + "']) as date) as event_date), x0 as (select event_date, coalesce((select max(n) from q where q.date <= ev.event_date), 1) as pos from ev), x as (select x0.*, q.date as matched_date from x0 join q on q.n = x0.pos)"))
def _(d):
    return evaluate.event_study(d.signal(), EVENTS, 3, 2)


_CLS = "cl as (select date, v, case when v is null then null when v >= (select quantile_cont(v, 0.8) from vol) then 'high_systemic_connectedness' when v <= (select quantile_cont(v, 0.2) from vol) then 'low_systemic_connectedness' else 'normal' end as regime_class from vol)"


@query("regime_classes", sql("vol", "select date, regime_class from cl", _CLS))
def _(d):
    return evaluate.regime_classes(d.signal())


@query("regime_class_counts", sql("vol", "select regime_class, count(*) as n_obs from cl where regime_class is not null group by 1", _CLS))
def _(d):
    return evaluate.regime_summary(d.signal())


@query("regime_summary", sql("vol m", "select regime_class, count(ret) as n_obs, round(avg(ret), 6) as mean_return, round(stddev_samp(ret), 6) as volatility, round(avg(abs(ret)), 6) as mean_absolute_return from cl join m on m.date = cl.date where regime_class is not null group by 1", _CLS))
def _(d):
    return evaluate.regime_summary(d.signal(), d.returns())


@query("transition_correlations", sql("vol b", "select 'benchmark_change_correlation' as diagnostic_type, benchmark, cast(count(*) as double) as n_obs, round(corr(x, y), 6) as pearson_correlation, round(corr(rx, ry), 6) as spearman_correlation from k group by benchmark",
    """ch as (select date, vix - lag(vix) over (order by date) as v1, drawdown - lag(drawdown) over (order by date) as v2 from b), j as (select v as x, unnest(['vix_change', 'drawdown_change']) as benchmark, unnest([v1, v2]) as y from vol join ch on ch.date = vol.date),
k as (select *, rank() over (partition by benchmark order by x) + (count(*) over (partition by benchmark, x) - 1) / 2.0 as rx, rank() over (partition by benchmark order by y) + (count(*) over (partition by benchmark, y) - 1) / 2.0 as ry from j where x is not null and y is not null)"""))
def _(d):
    return evaluate.transition_correlations(d.signal(), stress.benchmark_changes(d.labels()).select("date", "vix_change", "drawdown_change"))


_RS = """rs0 as (select * from {src}), rq as (select {by}quantile_cont(x, 0.2) as lo, quantile_cont(x, 0.8) as hi from rs0 {group}),
rs1 as (select {by}x, ok, vix, realized_volatility as rv, average_correlation as ac, systemic_stress_label as l, vol21 as fv, fd21.v as fd, ret from rs0 left join bm on bm.date = rs0.date left join t on t.date = rs0.date left join (select date, v from fd where h = 21) fd21 on fd21.date = rs0.date left join m on m.date = rs0.date),
rs2 as (select rs1.*, lo, hi from rs1 {join}),
rsum as (select {by}count(x) as n_ri_observations, avg(ok) as convergence_rate, stddev_pop(x) as ri_standard_deviation, corr(x, vix) as correlation_with_vix, corr(x, rv) as correlation_with_realized_volatility, corr(x, ac) as correlation_with_average_correlation,
  avg(x) filter (where l = 1) - avg(x) filter (where l = 0) as stress_non_stress_ri_difference, corr(x, fv) as correlation_with_future_realized_volatility, corr(x, fd) as correlation_with_future_max_drawdown, stddev_samp(ret) filter (where x >= hi) as high_regime_volatility from rs2 {group})"""
_RSOUT = "n_ri_observations, " + twin.rounded(evaluate.SUMMARY[1:])


@query("robustness_summary", sql("vol bm t fd m", f"select {_RSOUT} from rsum", _RS.format(src="(select date, v as x, null::double as ok from vol)", by="", group="", join="cross join rq")))
def _(d):
    return evaluate.robustness_summary(d.signal(), d.benchmarks(), d.returns())


@query("converged_vs_all", sql("ri bm t fd m", f"select sample, {_RSOUT} from rsum", _RS.format(src="(select date, regime_indicator as x, 1.0 as ok, sample from ri, unnest(['all_windows', 'converged_only']) as u(sample))", by="sample, ", group="group by sample", join="join rq using (sample)")))
def _(d):
    return evaluate.converged_vs_all(d.net(), d.benchmarks(), d.returns())


# ---- exposures and overlays


@query("expanding_exposure", sql("e", "select date, exposure from e"))
def _(d):
    return overlay.exposure(d.score())


@query("full_sample_exposure", sql("vol", "select date, cast(lag(raw, 1, 1.0) over (order by date) as double) as exposure from (select date, case when v >= (select quantile_cont(v, 0.9) from vol) then 0.5 when v >= (select quantile_cont(v, 0.8) from vol) then 0.7 else 1.0 end as raw from vol)"))
def _(d):
    return overlay.exposure(d.score(), method="full_sample")


@query("hysteresis_exposure", sql("e0", "select date, cast(lag(raw, 1, 1.0) over (order by date) as double) as exposure from h", "s as (select date, case when v is null or c < 20 then null when v >= x then 0.5 when v >= h then 0.7 when v < o then 1.0 end as said from e0), h as (select date, coalesce(last_value(said ignore nulls) over (order by date rows between unbounded preceding and current row), 1.0) as raw from s)"))
def _(d):
    return overlay.exposure(d.score(), variant="hysteresis")


_SMOOTH = "sm as (select date, avg(v) over (order by date rows between 4 preceding and current row) as v from vol), s0 as (select date, v, quantile_cont(v, 0.8) over w as h, quantile_cont(v, 0.9) over w as x, count(v) over w as c from sm window w as (order by date rows between unbounded preceding and 1 preceding)), s1 as (select date, case when c >= 20 and v >= x then 0.5 when c >= 20 and v >= h then 0.7 else 1.0 end as raw from s0)"


@query("smoothed_exposure", sql("vol", "select date, cast(lag(raw, 1, 1.0) over (order by date) as double) as exposure from s1", _SMOOTH))
def _(d):
    return overlay.exposure(d.score(), variant="smoothed_5d")


_DAILY = "with " + _DAY + """r0 as (select date, asset, ln(value / lag(value) over (partition by asset order by date)) as value from d), m as (select date, avg(value) as ret from r0 group by date having count(value) > 0),
s0 as (select date, ret as v, quantile_cont(ret, 0.8) over w as h, quantile_cont(ret, 0.9) over w as x, count(ret) over w as c from m window w as (order by date rows between unbounded preceding and 1 preceding)), s1 as (select date, row_number() over (order by date) as n, cast(case when c >= 20 and v >= x then 0.5 when c >= 20 and v >= h then 0.7 else 1.0 end as double) as raw from s0)"""


def _daily(d):
    return ret.portfolio_returns(ret.prices_to_returns(d.prices("D4"))).withColumnRenamed("ret", "score")


@query("weekly_exposure", _DAILY + ", k as (select date, coalesce(last_value(case when isodow(date) = 1 or n = 1 then raw end ignore nulls) over (order by date rows between unbounded preceding and current row), 1.0) as raw from s1) select date, cast(lag(raw, 1, 1.0) over (order by date) as double) as exposure from k")
def _(d):
    return overlay.exposure(_daily(d), variant="weekly")


@query("cooldown_exposure", _DAILY.replace("with ", "with recursive ", 1) + """, f as (select n, date, raw as v, cast(-1000000000 as bigint) as at from s1 where n = 1
  union all select s1.n, s1.date, case when s1.raw <> f.v and s1.n - 1 - f.at <= 5 then f.v else s1.raw end, case when s1.raw <> f.v and s1.n - 1 - f.at > 5 then s1.n - 1 else f.at end from f join s1 on s1.n = f.n + 1)
select date, cast(lag(v, 1, 1.0) over (order by date) as double) as exposure from f""")
def _(d):
    return overlay.exposure(_daily(d), variant="cooldown_5d")


@query("overlay_returns", sql("o", "select date, exposure, round(oret, 6) as ret from o"))
def _(d):
    return overlay.apply_overlay(d.portfolio(), overlay.exposure(d.score()))


@query("performance", sql("m", f"select {PERF} from perf", "src as (select date, ret as r from m), " + _perf("src")))
def _(d):
    return overlay.performance(d.portfolio())


@query("overlay_vs_baseline", sql("o m", "select a.metric, round(a.value, 6) as baseline, round(b.value, 6) as overlay, round(b.value - a.value, 6) as overlay_minus_baseline from (unpivot (select * exclude (k) from perf where k = 'a') on columns(*) into name metric value value) a join (unpivot (select * exclude (k) from perf where k = 'b') on columns(*) into name metric value value) b on a.metric = b.metric", "src as (select 'a' as k, date, ret as r from m union all select 'b', date, oret from o), " + _perf("src", "k")))
def _(d):
    return overlay.compare_to_baseline(d.portfolio(), overlay.apply_overlay(d.portfolio(), overlay.exposure(d.score())))


@query("exposure_turnover", sql("e", f"select {TURN} from turn", _turn("e")))
def _(d):
    return overlay.turnover(overlay.exposure(d.score()))


@query("cost_sensitivity", sql("o e", f"select cost_bps, {PERF}, {TURN} from perf cross join turn", "c0 as (select date, oret, coalesce(abs(exposure - lag(exposure) over (order by date)), 0) as ch from o), src as (select cast(bps as double) as cost_bps, date, oret - ch * bps / 10000 as r from c0, unnest([0, 5, 10]) as u(bps)), " + _perf("src", "cost_bps") + ", " + _turn("e")))
def _(d):
    return overlay.cost_sensitivity(d.portfolio(), overlay.exposure(d.score()))


_BE = "bs as (select date, unnest(['vix', 'realized_volatility', 'drawdown']) as signal, unnest([vix, realized_volatility, -drawdown]) as v from b), b0 as (select signal, date, v, quantile_cont(v, 0.8) over w as h, quantile_cont(v, 0.9) over w as x, count(v) over w as c from bs window w as (partition by signal order by date rows between unbounded preceding and 1 preceding)), be as (select signal, date, cast(lag(case when c >= 20 and v >= x then 0.5 when c >= 20 and v >= h then 0.7 else 1.0 end, 1, 1.0) over (partition by signal order by date) as double) as exposure from b0)"


@query("benchmark_exposures", sql("b", "select signal, date, exposure from be", _BE))
def _(d):
    return overlay.benchmark_exposures(d.labels())


@query("exposure_summary", sql("b", "select signal || '_exposure' as exposure, cast(count(*) as double) as n_obs, round(avg(be.exposure), 6) as mean, min(be.exposure) as min, max(be.exposure) as max, round(avg(case when be.exposure < 1 then 1.0 else 0.0 end), 6) as share_reduced, round(avg(case when be.exposure <= 0.5 then 1.0 else 0.0 end), 6) as share_half_or_less from be group by signal", _BE))
def _(d):
    return overlay.summarize_exposures(overlay.benchmark_exposures(d.labels()))


_CASE = "case when date >= date '1999-01-01' then 'test' when date >= date '1998-01-01' then 'validation' when date >= date '1995-01-01' then 'development' end"


@query("sample_metrics", sql("o e m", f"select sample, k.strategy, {PERF.replace('round(n_obs, 6)', 'coalesce(round(n_obs, 6), 0)')}, {TURN} from keys k left join perf on perf.key = k.key left join turn on turn.key = k.key",
    f"sm as (select unnest(['all', {_CASE}]) as sample, 'baseline' as strategy, date, ret as r from m where ret is not null union all select unnest(['all', {_CASE}]), 'ri_overlay', date, oret from o), src as (select sample || strategy as key, date, r from sm where sample is not null), et as (select sample || 'ri_overlay' as key, date, exposure from (select unnest(['all', {_CASE}]) as sample, date, exposure from e) where sample is not null), "
    "keys as (select s as sample, t as strategy, s || t as key from unnest(['all', 'development', 'validation', 'test']) as a(s), unnest(['baseline', 'ri_overlay']) as b(t)), " + _perf("src", "key") + ", " + _turn("et", "key")))
def _(d):
    base, e = d.portfolio(), overlay.exposure(d.score()).withColumn("strategy", F.lit("ri_overlay"))
    rows = base.withColumn("strategy", F.lit("baseline")).select("strategy", "date", "ret").unionAll(overlay.apply_overlay(base, e, ["strategy"]).select("strategy", "date", "ret"))
    return selection.sample_metrics(rows, e, [], SPLITS)


@query("sample_period", sql("m", f"select date, {_CASE} as sample from m"))
def _(d):
    return d.portfolio().select("date", models.sample_period(F.col("date"), SPLITS).alias("sample"))


# ---- networks and spectra

_G = ", ".join(f"round({c}, 6) as {c}" for c in ("average_graph_strength", "weighted_edge_density", "algebraic_connectivity", "largest_laplacian_eigenvalue", "largest_laplacian_eigenvalue_share", "laplacian_frobenius_change", "number_of_edges"))


@query("graph_features_two_assets", sql("h", f"select date, {_G} from h"))
def _(d):
    return d.ri(True).select("date", *[c for c in graph.FEATURES if c not in ("modularity", "average_node_strength")])


_Z = "z as (select date, " + ", ".join(f"coalesce(case when stddev_pop({c}) over () > 1e-15 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end, 0) as z_{c}" for c in ("average_graph_strength", "algebraic_connectivity", "largest_laplacian_eigenvalue_share", "laplacian_frobenius_change", "weighted_edge_density")) + " from h)"


@query("regime_indicator_two_assets", sql("h", "select date, round(z_average_graph_strength + z_algebraic_connectivity + z_largest_laplacian_eigenvalue_share + z_laplacian_frobenius_change, 6) as regime_indicator from z", _Z))
def _(d):
    return d.ri(True).select("date", "regime_indicator")


@query("component_scores_two_assets", sql("h", "select date, round(z_average_graph_strength + z_algebraic_connectivity + z_weighted_edge_density, 6) as connectivity_score, round(z_laplacian_frobenius_change, 6) as transition_score, round(z_largest_laplacian_eigenvalue_share, 6) as spectral_score, round((2 * z_average_graph_strength + z_algebraic_connectivity + z_weighted_edge_density + z_laplacian_frobenius_change + z_largest_laplacian_eigenvalue_share) / 6, 6) as graph_components_equal_weight_score from z", _Z))
def _(d):
    return components.add_component_scores(d.ri(True)).select("date", "connectivity_score", "transition_score", "spectral_score", "graph_components_equal_weight_score")


@query("residuals_on_one_control", sql("h vol", "select h.date, round(average_graph_strength - a - b * v, 6) as orthogonal_average_graph_strength from h left join vol on vol.date = h.date cross join line", "line as (select regr_intercept(average_graph_strength, v) as a, regr_slope(average_graph_strength, v) as b from h join vol on vol.date = h.date)"))
def _(d):
    return components.residualize(d.ri(True).select("date", "average_graph_strength"), d.vol(), "full_sample").select("date", "orthogonal_average_graph_strength")


@query("convergence_summary_two_assets", sql("h", "select count(*) as n_windows, count(*) as n_converged, cast(0 as bigint) as n_non_converged, 1.0::double as convergence_rate from h"))
def _(d):
    return graph.convergence_summary(d.ri(True)).select("n_windows", "n_converged", "n_non_converged", "convergence_rate")


@query("pca_two_assets", sql("pr", """select date, round(1 + q, 6) as pca_first_eigenvalue, round((1 + q) / 2, 6) as pca_first_eigenvalue_share, round(1 + q - last_value(1 + q ignore nulls) over w, 6) as pca_first_eigenvalue_change from (select date, abs(rho) as q from
  (select date, row_number() over (order by date) as n, count(a) over v as ca, count(c) over v as cc, corr(a, c) over v as rho from pr window v as (order by date rows between 51 preceding and current row)) where n >= 52) window w as (order by date rows between unbounded preceding and 1 preceding)"""))
def _(d):
    return graph.rolling_pca_features(d.pair(), WINDOW).select("date", "pca_first_eigenvalue", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change")


@query("graph_features")
def _(d):
    return d.ri()


@query("graph_features_with_modularity", sql("g", f"select date, {_G}, round(modularity, 6) as modularity, round(average_node_strength, 6) as average_node_strength from g"))
def _(d):
    made = graph.rolling_graph_features(d.three(), WINDOW, ALPHA, partial_corr_threshold=0.0, compute_modularity=True, max_iter=1000, **FIT)
    return made.select("date", *graph.FEATURES)


@query("pca_features")
def _(d):
    return graph.rolling_pca_features(ret.prices_to_returns(d.prices("D4")), 126)


_ORTH = dict(components.ORTHOGONAL)
_RES = "xo as (select date, c, y, [1.0::double, " + ", ".join(components.CONTROLS) + "] as x, row_number() over (partition by c order by date) as n from (" + " union all ".join(f"select g.date, '{c}' as c, {c} as y, {', '.join(components.CONTROLS)} from g join bm on bm.date = g.date" for c in _ORTH) + ") where y is not null and " + " and ".join(f"{c} is not null" for c in components.CONTROLS) + """),
xp as (select p.c, p.n as pn, q.y, q.x from xo p join xo q on q.c = p.c and q.n < p.n where p.n > 60), """ + twin.solved("xp", "c, pn", "xs") + """,
xr as (select xo.date, xo.c, xo.y - list_dot_product(xo.x, beta) as r from xo join xs on xs.c = xo.c and xs.pn = xo.n),
og0 as (select date, """ + ", ".join(f"max(case when c = '{c}' then r end) as {o}" for c, o in _ORTH.items()) + " from (select date, null as c, null::double as r from g union all select date, c, r from xr) group by date),\nog as (select *, (" + " + ".join(f"z{k}" for k in range(len(_ORTH))) + f") / {len(_ORTH)} as orthogonal_graph_score from (select *, " + twin.z({f"z{k}": o for k, o in enumerate(_ORTH.values())}) + " from og0))"
_BLOCKS = ("connectivity_score", "transition_score", "spectral_score", "graph_components_equal_weight_score")


@query("component_scores", sql("sco bm", "select sco.date, " + twin.rounded([*_BLOCKS, *_ORTH.values(), "orthogonal_graph_score"]) + " from sco join og on og.date = sco.date", _RES, recursive=True))
def _(d):
    got = components.add_component_scores(d.net(), d.benchmarks(), min_history=60)
    return got.select("date", *_BLOCKS, *_ORTH.values(), "orthogonal_graph_score")


_ZP = "(" + " + ".join(f"z_{c}" for c in components.COMPONENTS)
_CAND = """cd0 as (select coalesce(ri.date, pc.date) as date, * exclude (date), from ri full join pc on pc.date = ri.date),
cd1 as (select date, """ + ", ".join(components.COMPONENTS) + ", regime_indicator as ri, pca_first_eigenvalue_share, pca_first_eigenvalue_change, " + twin.z({f"z_{c}": c for c in (*components.COMPONENTS, "pca_first_eigenvalue_share", "pca_first_eigenvalue_change")}) + """ from cd0),
cd2 as (select *, (""" + " + ".join(f"z_{c}" for c in components.COMPONENTS) + ") / 6 as graph_components_equal_weight_score, (" + " + ".join(f"z_{c}" for c in components.COMPONENTS if c != "algebraic_connectivity") + """) / 5 as excluding_algebraic_connectivity_score, z_laplacian_frobenius_change as transition_score, z_algebraic_connectivity as algebraic_connectivity_only,
  (z_average_graph_strength + z_algebraic_connectivity + z_weighted_edge_density) / 3 as connectivity_block_with_algebraic_connectivity, (z_average_graph_strength + z_weighted_edge_density) / 2 as connectivity_block_without_algebraic_connectivity, (z_pca_first_eigenvalue_share + z_pca_first_eigenvalue_change) / 2 as pca_score from cd1),
cd as (select *, (za + zb + zc) / 3 as pca_plus_graph_score from (select *, """ + twin.z({"za": "graph_components_equal_weight_score", "zb": "transition_score", "zc": "pca_score"}) + " from cd2))"
_CANDS = (*components.COMPONENTS, "ri", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change", "graph_components_equal_weight_score", "excluding_algebraic_connectivity_score", "transition_score", "algebraic_connectivity_only", "connectivity_block_with_algebraic_connectivity", "connectivity_block_without_algebraic_connectivity", "pca_score", "pca_plus_graph_score")


@query("candidate_scores", sql("ri pc", "select date, " + twin.rounded(_CANDS) + " from cd", _CAND))
def _(d):
    return components.candidate_scores(d.net(), d.pca()).select("date", *_CANDS)


_ALG = """ax as (select date, algebraic_connectivity as x from g), ast as (select cast(count(x) as double) as n, avg(x) as mean, stddev_pop(x) as std, min(x) as mi, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2, quantile_cont(x, 0.75) as q3, max(x) as ma from ax),
ay as (""" + " union all ".join([f"select date, '{c}' as variable, {c} as y from ri" for c in ("regime_indicator", "average_graph_strength", "weighted_edge_density", "laplacian_frobenius_change", "largest_laplacian_eigenvalue_share")] + ["select date, 'pca_first_eigenvalue_share', pca_first_eigenvalue_share from pc"] + [f"select date, '{c}', {c} from bm" for c in components.CONTROLS]) + """),
ap0 as (select variable, x, y from ay join ax using (date) where x is not null and y is not null), ap1 as (select *, rank() over (partition by variable order by x) + (count(*) over (partition by variable, x) - 1) / 2.0 as rx, rank() over (partition by variable order by y) + (count(*) over (partition by variable, y) - 1) / 2.0 as ry from ap0),
ac as (select variable, cast(count(*) as double) as n, case when stddev_pop(x) > 1e-8 and stddev_pop(y) > 1e-8 then corr(x, y) end as pe, case when stddev_pop(x) > 1e-8 and stddev_pop(y) > 1e-8 then corr(rx, ry) end as sp from ap1 group by variable),
at0 as (select case when target = 'stress_onset_label' then target else 'future_' || target end as variable, x, y from tg join ax using (date) where x is not null and y is not null), at1 as (select *, rank() over (partition by variable order by x) + (count(*) over (partition by variable, x) - 1) / 2.0 as rx from at0),
at2 as (select variable, cast(count(*) as double) as n, corr(x, y) as c, (sum(case when y = 1 then rx end) - sum(case when y = 1 then 1.0 else 0 end) * (sum(case when y = 1 then 1.0 else 0 end) + 1) / 2) / nullif(sum(case when y = 1 then 1.0 else 0 end) * sum(case when y = 0 then 1.0 else 0 end), 0) as a from at1 group by variable),
av as (select 'availability' as diagnostic_type, 'algebraic_connectivity' as variable, 'available' as metric, 1.0 as value, n as n_obs from ast
  union all select 'summary', 'algebraic_connectivity', unnest(['mean', 'std', 'min', 'p25', 'median', 'p75', 'max']), unnest([mean, std, mi, q1, q2, q3, ma]), n from ast
  union all select 'correlation', variable, unnest(['pearson', 'spearman']), unnest([pe, sp]), n from ac
  union all select 'predictive', variable, case when variable = 'stress_onset_label' then 'auc' else 'pearson' end, case when variable = 'stress_onset_label' then a else c end, n from at2)"""


@query("algebraic_connectivity_diagnostics", sql("ri pc bm tg", "select diagnostic_type, variable, metric, round(value, 6) as value, n_obs from av", _ALG))
def _(d):
    b = d.benchmarks()
    return components.algebraic_diagnostics(d.net(), b, models.targets(d.returns(), b, prefix="future"), d.pca())


_ALGS = ("graph_components_equal_weight_score", "excluding_algebraic_connectivity_score", "algebraic_connectivity_only", "connectivity_block_with_algebraic_connectivity", "connectivity_block_without_algebraic_connectivity")


def _variants(columns, smooth: bool, table: str = "cd") -> str:
    """CTEs vr, perf, turn by key (score~variant) on dates on which all scores and the return are known."""
    known = " and ".join(f"{c} is not null" for c in columns)
    rows = " union all ".join(f"select '{c}' as k, date, {c} as v from vk" for c in columns)
    return f"""vk as (select {table}.* from {table} join m on m.date = {table}.date where {known}), vs as ({rows}),
{twin.exposures('vs', 'ex', smooth)},
ek as (select k || '~' || variant as key, date, exposure from ex), vr as (select key, m.date, ret * exposure as r, exposure from ek join m on m.date = ek.date where ret is not null), """ + _perf("vr", "key") + ",\n" + _turn("ek", "key")


_KEYS = "split_part(key, '~', 1) as score, split_part(key, '~', 2) as variant"
_VC = "vc0 as (select key, date, r, coalesce(abs(exposure - lag(exposure) over (partition by key order by date)), 0) as ch from vr), vc as (select key || '~' || bps as key, date, r - ch * bps / 10000 as r from vc0, unnest([0, 5, 10]) as u(bps)), " + twin.performance("vc", "key", "cperf") + ", cost as (select split_part(cperf.key, '~', 1) as score, split_part(cperf.key, '~', 2) as variant, cast(split_part(cperf.key, '~', 3) as double) as cost_bps, cperf.* exclude (key), turn.* exclude (key) from cperf join turn on turn.key = split_part(cperf.key, '~', 1) || '~' || split_part(cperf.key, '~', 2))"


@query("algebraic_connectivity_overlays", sql("ri pc m", f"select {_KEYS}, {PERF}, {TURN}, round(time_in_extreme_reduction, 6) as time_in_extreme_reduction from perf join turn using (key)", _CAND.replace("full join pc", "left join pc") + ", " + _variants(_ALGS, False)))
def _(d):
    return components.algebraic_overlays(d.net(), d.returns())[0]


def _signals(columns) -> str:
    """CTEs of evaluate_signals over sg (date, columns): comparison in cmp0, costs in scost."""
    rows = " union all ".join(f"select '{c}' as k, date, {c} as v from sg" for c in columns)
    return f"""so as ({rows}), {twin.exposures('so', 'ex')},
ek as (select k as key, ex.date, exposure from ex join m on m.date = ex.date), bc as (select m.date, ret as r from m join sg on sg.date = m.date where ret is not null), vr as (select key, bc.date, r * exposure as r, exposure from ek join bc on bc.date = ek.date), """ + _perf("vr", "key") + ",\n" + _turn("ek", "key") + ",\n" + twin.performance("bc", "", "bperf") + """,
cmp0 as (select 'baseline' as signal, 'baseline' as strategy, *, """ + ", ".join(f"null::double as {c}" for c in overlay.TURNOVER) + " from bperf union all select perf.key, perf.key || '_overlay', perf.* exclude (key), " + ", ".join(overlay.TURNOVER) + """ from perf join turn using (key)),
sc0 as (select key, date, r, coalesce(abs(exposure - lag(exposure) over (partition by key order by date)), 0) as ch from vr), sc as (select key || '~' || bps as key, date, r - ch * bps / 10000 as r from sc0, unnest([0, 5, 10]) as u(bps)), """ + twin.performance("sc", "key", "cperf") + ", scost as (select split_part(cperf.key, '~', 1) as signal, cast(split_part(cperf.key, '~', 2) as double) as cost_bps, cperf.* exclude (key), turn.* exclude (key) from cperf join turn on turn.key = split_part(cperf.key, '~', 1))"


@query("component_overlays", sql("sco pc m", f"select signal, strategy, {PERF}, {TURN}, {twin.minus('')} from cmp0", "sg as (select sco.*, pca_first_eigenvalue_share, pca_first_eigenvalue_change from sco left join pc on pc.date = sco.date), " + _signals(components.SIGNALS)))
def _(d):
    return overlay.evaluate_signals(d.returns(), components.overlay_signals(d.net(), d.pca()))[0]


@query("component_overlay_costs", sql("sco m", f"select signal, cost_bps, {PERF}, {TURN} from scost", "sg as (select * from sco), " + _signals(components.SIGNALS[:9])))
def _(d):
    return overlay.evaluate_signals(d.returns(), components.overlay_signals(d.net()))[1]


# ---- models

_MOD = """j as (select v as x, vol21 as y from vol join t on t.date = vol.date where v is not null and vol21 is not null),
f as (select x, y, (select regr_intercept(y, x) from j) + (select regr_slope(y, x) from j) * x as p from j), s as (select count(*) as n, 1 - sum((y - p) ** 2) / (select regr_syy(y, x) from j) as r2, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae from f)"""


@query("one_regressor_model", sql("vol t", "select cast(n as double) as n_obs, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) as adjusted_r2, round(rmse, 6) as rmse, round(mae, 6) as mae, round((select regr_slope(y, x) from j), 6) as coefficient from s", _MOD))
def _(d):
    t = evaluate.forward_targets(d.returns(), [21]).select("date", "forward_realized_volatility_21d")
    return models.fit_models(d.vol(), t, {"one": ["realized_volatility"]}, SPLITS).select("n_obs", "adjusted_r2", "rmse", "mae", F.col("coefficients")[0].alias("coefficient"))


@query("onset_auc", sql("vol ons", """select cast(count(*) as double) as n_obs, cast(sum(y) as double) as n_positive, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as auc from
  (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from (select y, x * sign((select regr_slope(y, x) from j)) as s from j))""", "j as (select v as x, cast(stress_onset_label as double) as y from vol join ons on ons.date = vol.date where v is not null)"))
def _(d):
    return models.fit_models(d.vol(), stress.stress_onsets(d.labels()), {"one": ["realized_volatility"]}, SPLITS).select("n_obs", "n_positive", "auc")


_B5 = list(components.CONTROLS)
#: Columns of networks and spectra of which none is a combination of others.
_NET = ["average_graph_strength", "algebraic_connectivity", "laplacian_frobenius_change", "largest_laplacian_eigenvalue_share"]
_PCA = ["pca_first_eigenvalue_share", "pca_effective_rank", "pca_first_eigenvalue_change", "pca_effective_rank_change"]
_DES = "ds as (select coalesce(b.date, f.date) as date, b.* exclude (date), f.* exclude (date) from (select date, {controls} from bm) b full join ({features}) f on f.date = b.date)"


def _fitted(specs: dict, features: str, prefix: str = "forward_", onset: str = "stress_onset_label") -> str:
    """CTEs fits and rg of the models over the design of benchmarks and features."""
    target = f"(select date, case when target = '{onset}' then target else '{prefix}' || target end as target, y from tg)"
    return f"{_DES.format(features=features, controls=", ".join(_B5))}, tn as {target}, " + twin.specs_rows(specs, "ds", "tn", _CASE.replace("date >=", "md.date >=")) + ", " + twin.models("rows_") + ", " + twin.regressors(specs)


def _each(metrics: str) -> str:
    return f"select target, fits.model, regressor, n_obs, {metrics}, round(beta[i], 6) as coefficient, {twin.sign('beta[i]')} as coefficient_sign, round(beta[i] / nullif(se[i], 0), 6) as t_stat from fits join rg on rg.model = fits.model"


_S1 = {"baseline": _B5, "baseline_plus_ri": [*_B5, "regime_indicator"], "baseline_plus_graph_components": [*_B5, "regime_indicator", *_NET[:3]]}


@query("incremental_tests", sql("bm ri tg", _each(twin.rounded(("adjusted_r2", "oos_r2", "auc", "brier_score", "oos_auc", "oos_brier_score"))), _fitted(_S1, f"select date, regime_indicator, {', '.join(_NET[:3])} from ri"), recursive=True))
def _(d):
    return models.incremental_tests(d.two("regime_indicator", *_NET[:3]), d.benchmarks(), d.returns(), SPLITS)


_METRICS = twin.rounded([c for c in models.kernels.MODEL_METRICS if c != "oos_r2"]) + ", round(case when target <> 'stress_onset_label' then oos_r2 end, 6) as oos_r2"
_S2 = {"M0_benchmarks": _B5, "M1_benchmarks_plus_ri": [*_B5, "regime_indicator"], "M2_benchmarks_plus_pca": [*_B5, *_PCA], "M3_benchmarks_plus_graph_components": [*_B5, *_NET], "M4_benchmarks_plus_pca_plus_graph_components": [*_B5, *_PCA, *_NET], "M5_benchmarks_plus_orthogonal_graph": [*_B5, *_ORTH.values()]}
_F2 = f"select coalesce(ri.date, pc.date) as date, regime_indicator, {', '.join((*_NET, *_PCA, *_ORTH.values()))} from ri full join pc on pc.date = ri.date left join og on og.date = ri.date"


@query("model_ladder", sql("bm ri pc tg", _each(_METRICS), _RES + ", " + _fitted(_S2, _F2), recursive=True))
def _(d):
    scores = components.residualize(d.two(*_ORTH), d.benchmarks()).select("date", *_ORTH.values())
    return models.model_ladder(d.two("regime_indicator", *_NET), d.benchmarks(), d.returns(), d.pca().select("date", *_PCA), scores, SPLITS)


_SCORES = {"connectivity_only": "connectivity_score", "transition_only": "transition_score", "spectral_only": "spectral_score"}
_LESS = {"excluding_laplacian_frobenius_change": 2, "excluding_algebraic_connectivity": 1, "excluding_average_graph_strength": 0, "excluding_largest_eigenvalue_share": 3}
_S3 = {"all_graph_components": _NET, **{a: [c for c in _NET if c != _NET[k]] for a, k in _LESS.items()}, **{a: [c] for a, c in _SCORES.items()}}
_A3 = "za as (select date, " + ", ".join(f"({' + '.join('z_' + c for c in cols)}) / {len(cols)} as {a}" for a, cols in _S3.items()) + " from (select date, " + twin.z({f"z_{c}": c for c in (*_NET, *_SCORES.values())}) + " from sa)), zl as (" + " union all ".join(f"select '{a}' as k, date, {a} as v from za" for a in _S3) + "), " + twin.exposures("zl", "ex") + ", ek as (select k as key, date, exposure from ex), vr as (select key, m.date, ret * exposure as r from ek join m on m.date = ek.date where ret is not null), " + _perf("vr", "key") + ", " + _turn("ek", "key")


@query("component_ablation", sql("bm ri tg m", """select key as ablation, cast(len(string_split(components, ',')) as bigint) as component_count, components, adjusted_r2, oos_r2, auc, oos_auc, round(sharpe, 6) as overlay_sharpe, round(calmar, 6) as overlay_calmar, round(max_drawdown, 6) as overlay_max_drawdown, round(annualized_turnover_proxy, 6) as annualized_turnover_proxy, round(time_in_reduced_exposure, 6) as time_in_reduced_exposure
  from (select model, """ + ", ".join(f"round(max(case when target {o} 'stress_onset_label' then {c} end), 6) as {c}" for o, c in (("<>", "adjusted_r2"), ("<>", "oos_r2"), ("=", "auc"), ("=", "oos_auc"))) + """ from fits where target in ('forward_realized_volatility_21d', 'stress_onset_label') group by model) f join perf on perf.key = f.model join turn using (key)
  join (select model, string_agg(regressor, ',' order by i) as components from rg where i > 6 group by model) using (model)""",
    "sa as (select date, " + ", ".join(_NET) + ", z_average_graph_strength + z_algebraic_connectivity as connectivity_score, z_laplacian_frobenius_change as transition_score, z_largest_laplacian_eigenvalue_share as spectral_score from ri), " + _fitted({a: [*_B5, *c] for a, c in _S3.items()}, "select * from sa") + ", " + _A3, recursive=True))
def _(d):
    return models.component_ablation(components.add_component_scores(d.two(*_NET)), d.benchmarks(), d.returns(), SPLITS)


_S4 = {"benchmarks_only": _B5, "ri_only": ["regime_indicator"], "pca_only": _PCA, "graph_components_only": _NET, "pca_plus_graph_components": [*_PCA, *_NET], "benchmarks_plus_ri": [*_B5, "regime_indicator"], "benchmarks_plus_pca": [*_B5, *_PCA], "benchmarks_plus_graph_components": [*_B5, *_NET], "benchmarks_plus_pca_plus_graph_components": [*_B5, *_PCA, *_NET]}
_F4 = f"select coalesce(ri.date, pc.date) as date, regime_indicator, {', '.join((*_NET, *_PCA))} from ri full join pc on pc.date = ri.date"
_INFO = _fitted(_S4, _F4, "future_")


def _information(d):
    return models.information_sets(d.two("regime_indicator", *_NET), d.benchmarks(), d.returns(), d.pca().select("date", *_PCA), None, SPLITS)


@query("information_sets", sql("bm ri pc tg", f"""select target, case when target = 'stress_onset_label' then 'classification' else 'regression' end as target_type, model as information_set, n_obs, case when target = 'stress_onset_label' then n_positive end as n_positive_events, cast(len(string_split(regressors, ',')) as double) as n_regressors, regressors, {_METRICS}, coefficient_signs,
  case when target = 'stress_onset_label' then 'classification_scores_are_linear_probability_diagnostics' else 'in_sample_metrics_are_diagnostics_only' end as diagnostic_note
  from fits join (select target, fits.model, string_agg(regressor, ',' order by i) as regressors, string_agg(regressor || ':' || {twin.sign('beta[i]')}, ';' order by i) as coefficient_signs from fits join rg on rg.model = fits.model group by all) using (target, model)""", _INFO, recursive=True))
def _(d):
    return _information(d)


_RULES = "rules(type, metric, dir, diag) as (values " + ", ".join(f"('{t}', '{m}', '{k}', {str(o).lower()})" for t, m, k, o in models.RANKED) + "), sets(model, place) as (values " + ", ".join(f"('{c}', {k})" for k, c in enumerate(models.SETS)) + ")"
_RM = sorted({r[1] for r in models.RANKED})


@query("information_set_ranking", sql("bm ri pc tg", """select target, target_type, metric, rank_direction, best_information_set, round(best_value, 6) as best_value, cast(n as double) as n_candidates, diagnostics_only from (
  select target, type as target_type, metric, dir as rank_direction, model as best_information_set, v as best_value, count(*) over (partition by target, metric) as n, diag as diagnostics_only, row_number() over (partition by target, metric order by case when dir = 'max' then -v else v end, place) as k
  from (select target, model, unnest([""" + ", ".join(f"'{c}'" for c in _RM) + "]) as metric, unnest([" + ", ".join("case when target <> 'stress_onset_label' then oos_r2 end" if c == "oos_r2" else c for c in _RM) + """]) as v from fits) l join rules using (metric) join sets using (model) where v is not null and type = case when target = 'stress_onset_label' then 'classification' else 'regression' end) where k = 1""", _INFO + ", " + _RULES, recursive=True))
def _(d):
    return models.rank_information_sets(_information(d))


# ---- grids, selection, rolling origins

CONFIGS = selection.parameter_grid((0.05, 0.20), (52,), (0.0, 0.03))


_CF = "cf(config_id, alpha, win, thr) as (values " + ", ".join(f"('{c.config_id}', {c.alpha}, {c.window}, {c.partial_corr_threshold})" for c in CONFIGS) + "), "
_GF = "gb as (" + twin.network("ga", "config_id") + "), gi as (select config_id, date, zw + zx + zy + zz as x from (select config_id, date, " + twin.z({"zw": "average_graph_strength", "zx": "algebraic_connectivity", "zy": "largest_laplacian_eigenvalue_share", "zz": "laplacian_frobenius_change"}, "config_id") + " from gb))"
_GR = _CF + "ga as (select config_id, date, " + ", ".join(f"case when {x} > thr then {x} else 0.0 end as {x}" for x in "abc") + " from lp join cf using (alpha)), " + _GF
_CFCOLS = "alpha, cast(win as bigint) as \"window\", thr as partial_corr_threshold, 'combinatorial' as laplacian_type, 'absolute_partial_correlation' as network_type, false as compute_modularity"


def _sampled(source: str, bench: bool) -> str:
    """CTEs om (config_id, sample, strategy, metrics) of the indicators in ``source`` (config_id, date, x)."""
    more = " union all select config_id, signal || '_overlay', be.date, be.exposure from be cross join (select distinct config_id from " + source + ") c" if bench else ""
    return f"""gx as (select config_id as k, date, x as v from {source}), {twin.exposures('gx', 'ex')}, {_BE + ', ' if bench else ''}ee as (select k as config_id, 'ri_overlay' as strategy, date, exposure from ex{more}),
er as (select config_id, 'baseline' as strategy, date, ret as r from m cross join (select distinct config_id from {source}) c where ret is not null union all select config_id, strategy, m.date, ret * exposure from ee join m on m.date = ee.date where ret is not null),
es as (select config_id || '~' || sample || '~' || strategy as key, date, r from (select *, unnest(['all', {_CASE}]) as sample from er) where sample is not null), et as (select config_id || '~' || sample || '~' || strategy as key, date, exposure from (select *, unnest(['all', {_CASE}]) as sample from ee) where sample is not null),
kk as (select distinct config_id, sample, strategy, config_id || '~' || sample || '~' || strategy as key from er, unnest(['all', 'development', 'validation', 'test']) as u(sample)), """ + _perf("es", "key") + ", " + _turn("et", "key") + ", om as (select kk.config_id, sample, strategy, perf.* exclude (key, n_obs), coalesce(n_obs, 0) as n_obs, turn.* exclude (key, time_in_extreme_reduction) from kk left join perf using (key) left join turn using (key))"


def _grid(d):
    ri = d._keep("grid", lambda: selection.indicators(d.three(), CONFIGS, **FIT))
    return selection.grid_tables(ri, d.returns(), d.labels(), CONFIGS, SPLITS)


_OM = f"sample, strategy, {PERF}, {TURN}, {twin.minus('config_id, sample')}"


@query("grid_overlay_metrics", sql("lp m", f"select config_id, {_CFCOLS}, {_OM} from om join cf using (config_id)", _GR + ", " + _sampled("gi", False)))
def _(d):
    return _grid(d)["robustness_overlay_metrics"]


@query("grid_summary", sql("lp m bm t fd ons", f"select config_id, {_CFCOLS}, {_RSOUT}, round(d1, 6) as stress_onset_ri_difference, " + ", ".join(f"round(c{k}, 6) as correlation_with_{c}_change" for k, c in enumerate(("vix", "realized_volatility", "average_correlation", "average_absolute_correlation", "drawdown"))) + " from rsum join cf using (config_id) join tr using (config_id)",
    _GR + ", " + _RS.format(src="(select config_id, date, x, 1.0 as ok from gi)", by="config_id, ", group="group by config_id", join="join rq using (config_id)") + ", onb0 as (select date, systemic_stress_label as l, row_number() over (order by date) as n from bm), onb as (select date, case when l = 1 and coalesce(lag(l) over (order by date), 0) = 0 and n - coalesce(max(case when l <> 0 then n end) over (order by date rows between unbounded preceding and 1 preceding), 0) - 1 >= 20 then 1 else 0 end as o from onb0), chg as (select date, "
    + ", ".join(f"{c} - lag({c}) over (order by date) as c{k}" for k, c in enumerate(("vix", "realized_volatility", "average_correlation", "average_absolute_correlation", "drawdown"))) + " from bm), tr as (select config_id, avg(x) filter (where o = 1) - avg(x) filter (where o = 0) as d1, " + ", ".join(f"corr(x, c{k}) as c{k}" for k in range(5)) + " from gi left join onb on onb.date = gi.date left join chg on chg.date = gi.date group by config_id)"))
def _(d):
    ri = d._keep("grid", lambda: selection.indicators(d.three(), CONFIGS, **FIT))
    return selection.grid_tables(ri, d.returns(), d.benchmarks(), CONFIGS, SPLITS)["robustness_grid_summary"]


@query("grid_convergence", sql("lp", f"select config_id, {_CFCOLS}, count(*) as n_windows, count(*) as n_converged, cast(0 as bigint) as n_non_converged, 1.0::double as convergence_rate from ga join cf using (config_id) group by all", _GR))
def _(d):
    return _grid(d)["robustness_convergence_summary"].select(*selection.CONFIG, "n_windows", "n_converged", "n_non_converged", "convergence_rate")


@query("grid_benchmark_comparison", sql("lp m b", f"select config_id, {_CFCOLS}, {_OM} from om join cf using (config_id)", _GR + ", " + _sampled("gi", True)))
def _(d):
    return _grid(d)["robustness_benchmark_comparison"]


@query("cached_indicator_tables", sql("vol m b", f"select config_id, null::double as alpha, cast(0 as bigint) as \"window\", null::double as partial_corr_threshold, 'combinatorial' as laplacian_type, 'absolute_partial_correlation' as network_type, false as compute_modularity, {_OM} from om", "gi as (select 'cached_indicator' as config_id, date, v as x from vol), " + _sampled("gi", True)))
def _(d):
    return selection.tables_from_indicator(d.signal(), d.returns(), d.labels(), splits=SPLITS)["robustness_benchmark_comparison"]


_PAIRED = "mp as (select date, list_avg([a, c, e]) as ret from nr), tp as (select date, case when count(ret) over w = 21 then stddev_samp(ret) over w end as vol21 from mp window w as (order by date rows between 1 following and 21 following)), fwp as (" + CTES["fw"].replace("from m)", "from mp)") + "), fdp as (" + CTES["fd"].replace("from fw)", "from fwp)") + ")"


@query("robustness_grid", sql("lp nr bm", f"select alpha, cast(win as bigint) as \"window\", thr as partial_corr_threshold, false as compute_modularity, {_RSOUT} from rsum join cf using (config_id)", _PAIRED + ", " + _GR.replace(_CF, "cf(config_id, alpha, win, thr) as (values ('0', 0.05, 52, 1e-6), ('1', 0.1, 52, 1e-6)), ") + ", " + _RS.replace("join t on", "join tp t on").replace("from fd where", "from fdp where").replace("join m on", "join mp m on").format(src="(select config_id, date, x, 1.0 as ok from gi)", by="config_id, ", group="group by config_id", join="join rq using (config_id)")))
def _(d):
    return selection.run_robustness_grid(d.three(), d.benchmarks(), (0.05, 0.1), (52,), (1e-6,), **FIT)


_VP = ("validation_sharpe", "validation_calmar", "validation_max_drawdown_reduction", "validation_volatility_reduction", "validation_downside_improvement", "validation_annualized_turnover_proxy")
_SEL = """so0 as (select o.config_id, o.sharpe as validation_sharpe, o.calmar as validation_calmar, o.max_drawdown - b.max_drawdown as validation_max_drawdown_reduction, b.annualized_volatility - o.annualized_volatility as validation_volatility_reduction, o.worst_5pct_return - b.worst_5pct_return as validation_downside_improvement, o.annualized_turnover_proxy as validation_annualized_turnover_proxy from om o join om b on b.config_id = o.config_id and b.sample = 'validation' and b.strategy = 'baseline' where o.sample = 'validation' and o.strategy = 'ri_overlay'),
so1 as (select *, """ + ", ".join(f"case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end as z{k}" for k, c in enumerate(_VP)) + " from so0), so2 as (select *, z0 + z1 + z2 + z3 + z4 - 0.25 * z5 as selection_score from so1), sel as (select *, row_number() over (order by round(selection_score, 9) desc nulls last, config_id) = 1 and selection_score is not null as selected from so2)"


@query("selected_configuration", sql("lp m", "select config_id, alpha, cast(win as bigint) as \"window\", thr as partial_corr_threshold, " + twin.rounded((*_VP, "selection_score")) + ", selected from sel join cf using (config_id)", _GR + ", " + _sampled("gi", False) + ", " + _SEL))
def _(d):
    return selection.select_configuration(_grid(d)["robustness_overlay_metrics"])


@query("oos_test_performance", sql("lp m", f"select * from (select config_id, {_CFCOLS}, {_OM} from om join cf using (config_id)) where sample = 'test' and config_id in (select config_id from sel where selected)", _GR + ", " + _sampled("gi", False) + ", " + _SEL))
def _(d):
    tables = _grid(d)
    return selection.oos_outputs(tables["robustness_overlay_metrics"], tables["robustness_benchmark_comparison"], selection.select_configuration(tables["robustness_overlay_metrics"]))["oos_test_performance"]


def _scores(d):
    return d._keep("scores", lambda: components.candidate_scores(d.net(), d.pca()))


_SIX = ("ri", "graph_components_equal_weight_score", "transition_score", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change", "pca_plus_graph_score")


@query("turnover_reduction", sql("ri pc m", f"select {_KEYS}, {PERF}, {TURN}, round(time_in_extreme_reduction, 6) as time_in_extreme_reduction from perf join turn using (key)", _CAND + ", " + _variants(_SIX, True), recursive=True))
def _(d):
    return overlay.evaluate_variants(d.returns(), _scores(d))[0]


@query("turnover_reduction_costs", sql("ri pc m", f"select score, variant, cost_bps, {PERF}, {TURN} from cost where variant in ('daily', 'weekly')", _CAND + ", " + _variants(("ri", "transition_score"), True) + ", " + _VC, recursive=True))
def _(d):
    return overlay.evaluate_variants(d.returns(), _scores(d), ("ri", "transition_score"), ("daily", "weekly"))[1]


def _choice(by: str = "") -> str:
    """The best (score, variant) of lt (by, score, variant, metrics) in lc."""
    names, kinds = ", ".join(f"'{c}'" for c in _SIX), ", ".join(f"'{c}'" for c in overlay.VARIANTS)
    return "lz as (select *, " + twin.z({"z1": "calmar", "z2": "sharpe", "z3": "max_drawdown", "z4": "annualized_turnover_proxy"}, by) + f" from lt), lc as (select * from (select *, row_number() over ({f'partition by {by} ' if by else ''}order by round(z1 + z2 + z3 - 0.5 * z4, 12) desc, list_position([{names}], score), list_position([{kinds}], variant)) as k from lz) where k = 1)"


@query("low_turnover_choice", sql("ri pc m", "select score, variant from lc", _CAND + ", " + _variants(_SIX, True) + f", lt as (select {_KEYS}, * from perf join turn using (key)), " + _choice(), recursive=True))
def _(d):
    return selection.low_turnover_choice(overlay.evaluate_variants(d.returns(), _scores(d))[0])


_WIDE = ("pca_first_eigenvalue_share", "pca_first_eigenvalue_change")
_SIX_SCORES = ("ri", "graph_components_equal_weight_score", "transition_score", "pca_score", "pca_plus_graph_score", "excluding_algebraic_connectivity_score")


def _rolled(dynamic: bool) -> str:
    """CTEs that end in ro: the performance of rolling_origin."""
    years = "yr(y, a, b, c, e) as (values " + ", ".join(f"({o.test_year}, date '{o.selection_start}', date '{o.selection_end}', date '{o.test_start}', date '{o.test_end}')" for o in ORIGINS) + ")"
    every = (*components.COMPONENTS, *_WIDE)
    made = years + """, y0 as (select y, date between a and b as sel, date between c and e as tst, cd.* from cd join yr on date between a and b or date between c and e),
y1 as (select y, sel, tst, date, """ + ", ".join(every) + ", " + twin.z({f"z_{c}": c for c in every}, "y", "sel") + " from y0),\ny2 as (select *, z_average_graph_strength + z_algebraic_connectivity + z_largest_laplacian_eigenvalue_share + z_laplacian_frobenius_change as ri, (" + " + ".join(f"z_{c}" for c in components.COMPONENTS) + ") / 6 as graph_components_equal_weight_score, (" + " + ".join(f"z_{c}" for c in components.COMPONENTS if c != "algebraic_connectivity") + """) / 5 as excluding_algebraic_connectivity_score, z_laplacian_frobenius_change as transition_score, (z_pca_first_eigenvalue_share + z_pca_first_eigenvalue_change) / 2 as pca_score from y1),
y3 as (select *, (za + zb + zc) / 3 as pca_plus_graph_score from (select *, """ + twin.z({"za": "graph_components_equal_weight_score", "zb": "transition_score", "zc": "pca_score"}, "y", "sel") + """ from y2)),
y4 as (select * from y3 where y in (select y from y3 group by y having sum(sel::int) >= 20 and sum(tst::int) >= 5)),\n"""
    chosen = " union all ".join(f"select y, '{c}' as candidate, '{c}' as score_name, 'daily' as rule, '{c}' as score, 'daily' as variant, '' as selected_score, '' as selected_variant from yr" for c in _SIX_SCORES)
    if dynamic:
        known = " and ".join(f"{c} is not null" for c in _SIX)
        made += f"dk as (select y4.* from y4 join m on m.date = y4.date where sel and {known}), dl as (" + " union all ".join(f"select y || '~{c}' as k, date, {c} as v from dk" for c in _SIX) + "),\n" + twin.exposures("dl", "dx", True) + """,
de as (select k || '~' || variant as key, date, exposure from dx), dv as (select key, m.date, ret * exposure as r from de join m on m.date = de.date where ret is not null), """ + twin.performance("dv", "key", "dperf") + ", " + twin.turnover("de", "key", "dturn") + """,
lt as (select cast(split_part(key, '~', 1) as int) as y, split_part(key, '~', 2) as score, split_part(key, '~', 3) as variant, * exclude (key) from dperf join dturn using (key)), """ + _choice("y") + ",\n"
        chosen += " union all select y, 'best_low_turnover_score', score, variant, 'selection_period_best_low_turnover', 'dynamic', score, variant from lc"
    names = _SIX_SCORES if not dynamic else (*_SIX_SCORES, *_WIDE)
    return made + f"ch as ({chosen}),\nyl as (" + " union all ".join(f"select y, date, sel, tst, '{c}' as score_name, {c} as v from y4" for c in names) + """),
yk as (select y || '~' || candidate as k, date, sel, v, rule from yl join ch using (y, score_name)), lvl as (select k, quantile_cont(v, 0.8) as h, quantile_cont(v, 0.9) as x, quantile_cont(v, 0.6) as o from yk where sel group by k),
""" + twin.exposures("yk", "rx", dynamic, levels="lvl") + """,
re0 as (select rx.k as key, rx.date, exposure from rx join ch on rx.k = y || '~' || candidate and rx.variant = rule join y4 on y4.y = ch.y and y4.date = rx.date and y4.tst), rv as (select key, m.date, ret * exposure as r, exposure from re0 join m on m.date = re0.date where ret is not null),
rc0 as (select key, date, r, coalesce(abs(exposure - lag(exposure) over (partition by key order by date)), 0) as chg from rv), rc as (select key || '~' || bps as key, date, r - chg * bps / 10000 as r from rc0, unnest([0, 5, 10]) as u(bps)), """ + twin.performance("rc", "key", "rperf") + ", " + twin.turnover("re0", "key", "rturn") + """,
ro as (select candidate, score, variant, selected_score, selected_variant, cast(ch.y as double) as test_year, cast(split_part(rperf.key, '~', 3) as double) as cost_bps, yr.a as selection_start, yr.b as selection_end, yr.c as test_start, yr.e as test_end, rperf.* exclude (key), rturn.* exclude (key, time_in_extreme_reduction)
  from rperf join rturn on rturn.key = split_part(rperf.key, '~', 1) || '~' || split_part(rperf.key, '~', 2) join ch on ch.y || '~' || candidate = rturn.key join yr on yr.y = ch.y)"""


@query("rolling_origin", sql("ri pc m", f"select * exclude ({', '.join((*overlay.PERFORMANCE, *overlay.TURNOVER))}), {PERF}, {TURN} from ro", _CAND + ", " + _rolled(True), recursive=True))
def _(d):
    return selection.rolling_origin(d.returns(), _scores(d), splits=ORIGINS, dynamic=True)[0]


_MEANS = ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "worst_5pct_return", "annualized_turnover_proxy")
_ROS = "ros as (select candidate, score, variant, cost_bps, cast(count(distinct test_year) as double) as n_test_years, " + ", ".join(f"avg({c}) as mean_{c}, quantile_cont({c}, 0.5) as median_{c}" for c in _MEANS) + ", avg(case when sharpe > 0 then 1.0 else 0 end) as share_years_positive_sharpe, avg(case when max_drawdown > -0.2 then 1.0 else 0 end) as share_years_drawdown_better_than_20pct from ro group by all)"
_ROSOUT = twin.rounded([f"{k}_{c}" for c in _MEANS for k in ("mean", "median")] + ["share_years_positive_sharpe", "share_years_drawdown_better_than_20pct"])


@query("rolling_origin_summary", sql("ri pc m", f"select candidate, score, variant, cost_bps, n_test_years, {_ROSOUT} from ros", _CAND + ", " + _rolled(False) + ", " + _ROS))
def _(d):
    return selection.rolling_origin(d.returns(), _scores(d), splits=ORIGINS)[1]


_FM = "nm(candidate, information_set, simple, pca, graph) as (values " + ", ".join(f"('{c}', '{i}', {x}, {str(c in ('pca_score', 'pca_plus_graph_score')).lower()}, {str(c not in ('pca_score', 'best_low_turnover_score')).lower()})" for c, (i, x) in selection.MATRIX.items()) + """),
bs0 as (select *, row_number() over (partition by candidate, cost_bps order by mean_sharpe desc nulls last, score, variant) as k from ros), inf as (select model as information_set, max(case when target = 'stress_onset_label' then oos_auc end) as oos_stress_onset_auc, max(case when target = 'future_realized_volatility_21d' then oos_r2 end) as oos_volatility_prediction_r2 from fits group by 1),
f0 as (select nm.candidate, simple as simplicity_interpretability_score, pca as depends_on_pca, graph as depends_on_graph_components, p.mean_sharpe as oos_sharpe, p.mean_calmar as oos_calmar, p.mean_max_drawdown as oos_max_drawdown, p.mean_sortino as oos_sortino, p.mean_worst_5pct_return as oos_worst_5pct, p.mean_annualized_turnover_proxy as turnover, p.share_years_positive_sharpe as robustness_across_years, q.mean_sharpe as cost_10bps_sharpe, oos_stress_onset_auc, oos_volatility_prediction_r2
  from nm left join bs0 p on p.candidate = nm.candidate and p.cost_bps = 0 and p.k = 1 left join bs0 q on q.candidate = nm.candidate and q.cost_bps = 10 and q.k = 1 left join inf using (information_set)),
fm as (select * exclude (z0, z1, z2, z3, z4), z0 + z1 + z2 + z3 - 0.5 * z4 as selection_score from (select *, """ + twin.z({f"z{k}": c for k, c in enumerate(("oos_sharpe", "oos_calmar", "cost_10bps_sharpe", "robustness_across_years", "turnover"))}) + " from f0))"
_FMN = ("oos_sharpe", "oos_calmar", "oos_max_drawdown", "oos_sortino", "oos_worst_5pct", "turnover", "robustness_across_years", "cost_10bps_sharpe", "oos_stress_onset_auc", "oos_volatility_prediction_r2", "selection_score")


@query("final_matrix", sql("ri pc m bm tg", f"select candidate, simplicity_interpretability_score, depends_on_pca, depends_on_graph_components, {twin.rounded(_FMN)} from fm", _CAND + ", " + _rolled(False) + ", " + _ROS + ", " + _INFO + ", " + _FM, recursive=True))
def _(d):
    return selection.final_matrix(_information(d), selection.rolling_origin(d.returns(), _scores(d), splits=ORIGINS)[1])


# ---- tables behind charts, streaming


@query("chart_indicator", sql("vol labs", "select vol.date, round(v, 6) as regime_indicator, coalesce(systemic_stress_label = 1, false) as is_stress from vol left join labs on labs.date = vol.date"))
def _(d):
    return plotdata.indicator_line(d.signal(), d.labels())


@query("chart_indicator_vs_benchmark", sql("vol vx", "select vol.date, round(v, 6) as regime_indicator, round(vix, 6) as vix from vol join vx on vx.date = vol.date where v is not null and vix is not null"))
def _(d):
    return plotdata.indicator_vs_benchmark(d.signal(), d.vix(), "vix")


@query("chart_stress_boxes", sql("vol labs", "select cast(systemic_stress_label as bigint) as label, count(*) as n, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as max from vol join labs on labs.date = vol.date where v is not null group by 1"))
def _(d):
    return plotdata.stress_boxes(evaluate.align(d.signal(), d.labels()))


@query("chart_wealth", sql("o", "select date, round(w, 6) as wealth, round(w / max(w) over (order by date rows between unbounded preceding and current row) - 1, 6) as drawdown from (select date, product(1 + greatest(oret, -0.999999)) over (order by date rows between unbounded preceding and current row) as w from o)"))
def _(d):
    return plotdata.wealth_and_drawdown(overlay.apply_overlay(d.portfolio(), overlay.exposure(d.score())))


@query("chart_scatter", sql("vol t", "select round(x, 6) as x, round(y, 6) as y, round(p, 6) as fitted from f", _MOD))
def _(d):
    return plotdata.scatter_with_line(d.signal(), evaluate.forward_targets(d.returns(), [21]), "forward_realized_volatility_21d")


@query("chart_features", sql("g", "select date, feature, round(value, 6) as value from (select date, unnest(['average_graph_strength', 'laplacian_frobenius_change']) as feature, unnest([average_graph_strength, laplacian_frobenius_change]) as value from g)"))
def _(d):
    return plotdata.feature_panel(d.net(), ["average_graph_strength", "modularity", "laplacian_frobenius_change"])


#: Years of lineitem, as the data model has them; other years would be further columns of the chart.
_YEARS = range(1995, 2002)


@query("chart_heatmap_all_years", "select l_returnflag as returnflag, " + ", ".join(f"round(avg(l_extendedprice) filter (where year(l_shipdate) = {y}), 6) as y{y}" for y in _YEARS) + " from lineitem group by l_returnflag")
def _(d):
    t = d.spark.read.parquet(f"{d.dir}/lineitem.parquet").select(F.col("l_returnflag").alias("returnflag"), F.concat(F.lit("y"), F.year("l_shipdate")).alias("y"), num("l_extendedprice").alias("v"))
    return plotdata.heatmap(t, "returnflag", "y", "v", [f"y{y}" for y in _YEARS])


@query("csv_prices", sql("d", "select date, asset, round(value, 6) as value from d"))
def _(d):
    wide = panels.to_wide(ret.dense(d.prices()), ["s0", "s1", "s2", "s3"])
    folder = panels.new_folder(d.spark)
    panels.write_tables({"prices.csv": wide}, folder, "csv")
    return panels.to_long(panels.load_prices_csv(d.spark, f"{folder}/prices.csv"))


@query("csv_returns_sniffed_dates", sql("r", "select date, asset, round(value, 6) as value from r"))
def _(d):
    """The first column is no known index name; its values tell that it holds dates."""
    folder = panels.new_folder(d.spark)
    panels.write_tables({"returns.csv": panels.to_wide(d.returns(), ["s0", "s1", "s2", "s3"]).withColumnRenamed("date", "week start")}, folder, "csv")
    return panels.to_long(panels.load_returns_csv(d.spark, f"{folder}/returns.csv"))


@query("csv_without_dates", sql("d", "select asset, count(value) as n, round(sum(value), 6) as total from d group by asset"))
def _(d):
    """The first column holds prices, so it is an asset like the others."""
    folder = panels.new_folder(d.spark)
    panels.write_tables({"prices.csv": panels.to_wide(ret.dense(d.prices()), ["s0", "s1", "s2", "s3"]).drop("date")}, folder, "csv")
    wide = panels.load_prices_csv(d.spark, f"{folder}/prices.csv")
    long = melt(wide, [], wide.columns, "asset", "value")
    return long.groupBy("asset").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("cached_returns", sql("r", "select date, asset, round(value, 6) as value from r"))
def _(d):
    folder = panels.new_folder(d.spark)
    panels.write_tables({"returns": panels.to_wide(d.returns(), ["s0", "s1", "s2", "s3"])}, folder)
    return panels.to_long(panels.read_table(d.spark, f"{folder}/returns"))


@query("chart_regime_bars", sql("vol m", "select regime_class, round(stddev_samp(ret), 6) as volatility from cl join m on m.date = cl.date where regime_class is not null group by 1", _CLS))
def _(d):
    return plotdata.regime_bars(evaluate.regime_summary(d.signal(), d.returns()))


_WF = "sg as (select ri.date, regime_indicator as ri from ri), so as (select 'ri' as k, date, ri as v from sg), " + twin.exposures("so", "ex") + ", " + _BE + ", ek as (select k as key, date, exposure from ex union all select signal, date, exposure from be), vr as (select key, m.date, ret * exposure as r from ek join m on m.date = ek.date where ret is not null), " + _perf("vr", "key") + ", bc as (select date, ret as r from m), " + twin.performance("bc", "", "bperf") + ", wf as (select 'baseline' as strategy, * from bperf union all select key || '_overlay', perf.* exclude (key) from perf)"


@query("overlay_comparison", sql("ri b m", f"select strategy, {PERF}, {twin.minus('')} from wf", _WF))
def _(d):
    return workflows.overlays(d.two("regime_indicator"), d.returns(), d.labels())["overlay_performance_comparison"]


@query("overlay_exposures", sql("ri b m", "select key || '_exposure' as exposure, cast(count(*) as double) as n_obs, round(avg(ek.exposure), 6) as mean, min(ek.exposure) as min, max(ek.exposure) as max, round(avg(case when ek.exposure < 1 then 1.0 else 0.0 end), 6) as share_reduced, round(avg(case when ek.exposure <= 0.5 then 1.0 else 0.0 end), 6) as share_half_or_less from ek group by key", _WF))
def _(d):
    return workflows.overlays(d.two("regime_indicator"), d.returns(), d.labels())["overlay_exposure_summary"]


_QUICK = selection.quick_grid()
_GR2 = _CF + "ga as (select config_id, date, case when greatest(abs(rho) - alpha, 0.0) > thr then greatest(abs(rho) - alpha, 0.0) else 0.0 end as a from g0 cross join cf where n >= 52), gb as (select config_id, date, a as average_graph_strength, 2 * a as algebraic_connectivity, case when a > 0 then 1.0 else 0.0 end as largest_laplacian_eigenvalue_share, 2 * abs(a - lag(a) over (partition by config_id order by date)) as laplacian_frobenius_change from ga), gi as (select config_id, date, zw + zx + zy + zz as x from (select config_id, date, " + twin.z({"zw": "average_graph_strength", "zx": "algebraic_connectivity", "zy": "largest_laplacian_eigenvalue_share", "zz": "laplacian_frobenius_change"}, "config_id") + " from gb))"
_GQ = _GR2.replace(_CF, "cf(config_id, alpha, win, thr) as (values " + ", ".join(f"('{c.config_id}', {c.alpha}, {c.window}, {c.partial_corr_threshold})" for c in _QUICK) + "), gq as (select date, row_number() over (order by date) as n, covar_pop(a, c) over w / (stddev_pop(a) over w * stddev_pop(c) over w) as rho from prc window w as (order by date rows between 62 preceding and current row)), ").replace("from g0 cross join cf where n >= 52", "from gq cross join cf where n >= 63")


@query("quick_grid_metrics", sql("prc m", f"select config_id, {_CFCOLS}, {_OM} from om join cf using (config_id)", _GQ + ", " + _sampled("gi", False)))
def _(d):
    return selection.grid_tables(selection.indicators(d.pair(), _QUICK), d.returns(), d.labels(), _QUICK, SPLITS)["robustness_overlay_metrics"]


@query("chart_top", sql("m", "select date, round(ret, 6) as ret from m where ret is not null order by ret desc, date limit 8"))
def _(d):
    return plotdata.top(d.portfolio().where("ret is not null"), "ret", 8, ["date"])


@query("hourly_event_panel", "select date_trunc('hour', ts) as date, event_type as asset, round(avg(value), 6) as value from events group by all")
def _(d):
    return d.prices("H5")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime indicator of the weekly four-asset panel."""
    return Data(spark, sf_dir).ri()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
