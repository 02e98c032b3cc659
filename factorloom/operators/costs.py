"""Drift, turnover, trading cost, net return and risk summaries of a book of daily weights.

Everything here is a join on (datetime, instrument) and an aggregate by date; what depends on
the path of a book beyond the previous date is in ``portfolio``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.library import ieee_div
from factorloom.operators.analytics import _LABELLED_SQL, _TOP_SQL, decay, ic_by_date, ic_summary, labelled, top_weights, trailing
from factorloom.operators.factor_queries import HIST, PANEL_SQL, panel, rounded
from factorloom.sources.panel import bars

#: Costs per unit: of turnover, of volatility traded, of impact (with its exponent), of short weight a period.
KAPPA = {"turnover": 0.0005, "spread": 0.1, "impact": 0.05, "exponent": 1.5, "borrow": 0.001}
FLOOR = 1e-12
ADV_FLOOR = 1e-8
#: Periods in a year of arithmetic and of geometric annualisation.
ARITHMETIC, GEOMETRIC = 238.0, 252.0
SPLIT = "1998-01-01"


def _r(*names: str, keep: str = "") -> str:
    return ", ".join([*filter(None, [keep]), *(f"round(cast({n} as double), 6) + 0.0 as {n}" for n in names)])


def drifted(weights: DataFrame, signed: bool = False) -> DataFrame:
    """instrument, datetime, w, wd: each date's weights beside what the last date's have become.

    ``weights`` has w and ret (the return from its date to the next one).  A long-only book is
    scaled to its own value, a signed one to 1 + sum of w x ret; below FLOOR weights are carried.
    """
    held = weights.where("w <> 0").select("instrument", "datetime", "w", "ret")
    # The calendar has one row per date.
    days = weights.select("datetime").distinct().select("datetime", F.lead("datetime").over(Window.orderBy("datetime")).alias("next"))
    grown = F.col("w") * (1 + F.col("ret"))
    nav = F.sum(F.abs(grown)) if not signed else 1 + F.sum(F.col("w") * F.col("ret"))
    value = held.groupBy("datetime").agg(nav.alias("nav"))
    moved = held.join(value, "datetime").join(days, "datetime").where("next is not null")
    moved = moved.select("instrument", F.col("next").alias("datetime"), F.when(F.col("nav") < FLOOR, F.col("w")).otherwise(grown / F.col("nav")).alias("wd"))
    both = held.select("instrument", "datetime", "w", "ret").join(moved, ["instrument", "datetime"], "full")
    return both.select("instrument", "datetime", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w", "wd", "ret")))


def costs(moves: DataFrame, risk: DataFrame, kappa: dict = KAPPA) -> DataFrame:
    """datetime, turnover, gross, cost of ``moves`` (drifted); ``risk`` has sigma and adv.

    An unknown sigma costs nothing, an unknown adv is the median of its date.
    """
    known = risk.withColumn("mid", F.percentile("adv", 0.5).over(Window.partitionBy("datetime")))
    day = known.groupBy("datetime").agg(F.first("mid").alias("mid"))
    rows = moves.join(known.select("instrument", "datetime", "sigma", "adv"), ["instrument", "datetime"], "left").join(day, "datetime", "left")
    dw = F.abs(F.col("w") - F.col("wd"))
    adv = F.greatest(F.coalesce("adv", "mid", F.lit(ADV_FLOOR)), F.lit(ADV_FLOOR))
    impact = F.pow(dw, F.lit(kappa["exponent"])) / F.pow(adv, F.lit(kappa["exponent"] - 1))
    out = rows.groupBy("datetime").agg(
        (0.5 * F.sum(dw)).alias("turnover"),
        F.sum(F.col("w") * F.col("ret")).alias("gross"),
        F.sum(F.coalesce("sigma", F.lit(0.0)) * dw).alias("spread"),
        F.sum(impact).alias("impact"),
        F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("short"),
    )
    total = sum((F.lit(kappa[k]) * F.col(k) for k in ("turnover", "spread", "impact")), F.lit(kappa["borrow"]) * F.col("short"))
    return out.select("datetime", "turnover", "gross", total.alias("cost"))


def benchmark(rows: DataFrame) -> DataFrame:
    """datetime, bench: the change of the mean price from the date before; one row per date in the window."""
    mean = rows.groupBy("datetime").agg(F.avg("z").alias("level"))
    return mean.select("datetime", (ieee_div(F.col("level"), F.lag("level").over(Window.orderBy("datetime"))) - 1).alias("bench"))


def net_returns(priced: DataFrame, bench: DataFrame, delay: int = 1) -> DataFrame:
    """Adds ``net``: gross less the benchmark ``delay`` dates on, less cost."""
    ahead = bench.select("datetime", F.coalesce(F.lead("bench", delay).over(Window.orderBy("datetime")), F.lit(0.0)).alias("b"))
    return priced.join(ahead, "datetime", "left").withColumn("net", F.col("gross") - F.coalesce("b", F.lit(0.0)) - F.col("cost")).drop("b")


def risk_summary(daily: DataFrame, periods: float = ARITHMETIC) -> DataFrame:
    """arr, ir, mdd, calmar of ``net`` with arithmetic accumulation."""
    grow = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("cum", F.sum("net").over(grow)).withColumn("dd", F.col("cum") - F.max("cum").over(grow))
    out = rows.agg(
        (F.avg("net") * periods).alias("arr"),
        (F.avg("net") / F.when(F.stddev_samp("net") > 0, F.stddev_samp("net")) * periods**0.5).alias("ir"),
        F.min("dd").alias("mdd"),
    )
    return out.withColumn("calmar", F.col("arr") / F.when(F.col("mdd") < 0, -F.col("mdd")))


def prediction_scale(pairs: DataFrame, least: int = 100) -> DataFrame:
    """beta: slope of the label on the prediction; 1 where there are too few rows or it isn't positive."""
    known = pairs.where("pred is not null and label is not null")
    out = known.agg(F.count(F.lit(1)).alias("n"), F.var_pop("pred").alias("v"), F.regr_slope("label", "pred").alias("b"))
    return out.select(F.when((F.col("n") >= least) & (F.col("v") > 0) & (F.col("b") > 0), F.col("b")).otherwise(1.0).alias("beta"))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing(panel(spark, sf_dir)).withColumn("adv", F.col("adv") / 1e6)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = costs(drifted(top_weights(spark, sf_dir)), _risk(spark, sf_dir))
    return net_returns(priced, benchmark(panel(spark, sf_dir)))


def q_drift(spark, d):
    return rounded(drifted(top_weights(spark, d)).select("instrument", "datetime", "w", "wd"), "w", "wd")


def q_drift_signed(spark, d):
    """Half the names short: weights of alternate ranks change their sign."""
    rows = top_weights(spark, d).withColumn("w", F.when(F.col("rk") % 2 == 0, -F.col("w")).otherwise(F.col("w")))
    return rounded(drifted(rows, signed=True).select("instrument", "datetime", "wd"), "wd")


def q_cost(spark, d):
    return rounded(_daily(spark, d), "turnover", "gross", "cost", "net")


def q_risk(spark, d):
    return rounded(risk_summary(_daily(spark, d)), "arr", "ir", "mdd", "calmar")


def q_benchmark(spark, d):
    return rounded(benchmark(panel(spark, d)), "bench")


def q_prediction_scale(spark, d):
    train = labelled(spark, d).where(F.col("datetime") < F.lit(dt.date.fromisoformat(SPLIT)))
    return rounded(prediction_scale(train), "beta")


def q_is_oos_gap(spark, d):
    """In-sample less out-of-sample means of the two correlations."""
    series = ic_by_date(labelled(spark, d))
    early = F.col("datetime") < F.lit(dt.date.fromisoformat(SPLIT))
    part = lambda c, w: F.avg(F.when(w, F.col(c)))
    out = series.agg((part("ic", early) - part("ic", ~early)).alias("gap_ic"), (part("rank_ic", early) - part("rank_ic", ~early)).alias("gap_rank_ic"))
    return rounded(out, "gap_ic", "gap_rank_ic")


def q_model_metrics(spark, d):
    """The correlation and decay blocks of one prediction, side by side."""
    series = ic_by_date(labelled(spark, d))
    return rounded(ic_summary(series).crossJoin(decay(series).select("slope", "first", "last")), "ic", "rank_ic", "icir", "rank_icir", "ic_pos_frac", "slope", "first", "last")


def date_window(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return rows.where(F.col("datetime").between(F.lit(dt.date.fromisoformat(start)), F.lit(dt.date.fromisoformat(end))))


def q_date_window(spark, d):
    """The scan itself is cut: whole months from the window reach the aggregation."""
    out = bars(spark, d, start="1996-01-01", end="1998-12-31").select("instrument", "datetime", "close", "volume")
    return rounded(date_window(out, "1996-01-01", "1998-12-31"), "close")


def universe_spans(rows: DataFrame, margin: int = 12) -> DataFrame:
    """instrument, start, end of membership: ``margin`` months inside the first and last bar."""
    return rows.groupBy("instrument").agg(F.add_months(F.min("datetime"), margin).alias("start"), F.add_months(F.max("datetime"), -margin).alias("end"))


def masked(rows: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are null outside their instrument's spans (of which there may be several)."""
    inside = rows.select("instrument", "datetime").join(spans, "instrument").where("datetime between start and end").select("instrument", "datetime").distinct()
    out = rows.join(inside.withColumn("__in", F.lit(True)), ["instrument", "datetime"], "left")
    return out.withColumns({c: F.when(F.col("__in"), F.col(c)) for c in columns}).drop("__in")


def q_universe_spans(spark, d):
    return universe_spans(bars(spark, d))


def q_universe_mask(spark, d):
    rows = panel(spark, d).select("instrument", "datetime", "close", "volume")
    return rounded(masked(rows, universe_spans(rows), ["close", "volume"]), "close", "volume")


def q_debug_sample(spark, d, n: int = 100):
    """The bars of the first ``n`` instruments, in order of first appearance."""
    rows = bars(spark, d)
    first = rows.groupBy("instrument").agg(F.min("datetime").alias("t"))
    keep = first.orderBy("t", F.length("instrument"), "instrument").limit(n).select("instrument")
    return rounded(rows.join(F.broadcast(keep), "instrument", "left_semi").select("instrument", "datetime", "close"), "close")


_SPANS = ", s as (select instrument as i, cast(min(datetime) + interval 12 month as date) as start, cast(max(datetime) - interval 12 month as date) as end_ from r group by 1)"
_DRIFT = (
    ", days as (select datetime, lead(datetime) over (order by datetime) as next from (select distinct datetime from wt))"
    ", held as (select * from wt where w <> 0)"
)
_MOVED = (
    ", nav as (select datetime, sum(abs(w * (1 + ret))) as nav from held group by 1)"
    ", moved as (select instrument, next as datetime, case when nav < 1e-12 then w else w * (1 + ret) / nav end as wd from held join nav using (datetime) join days using (datetime) where next is not null)"
    ", mvs as (select instrument, datetime, coalesce(w, 0) as w, coalesce(wd, 0) as wd, coalesce(ret, 0) as ret from held full join moved using (instrument, datetime))"
)
_COST = (
    ", rets as (select *, close / lag(close) " + HIST + " - 1 as cret from r)"
    ", risk as (select instrument, datetime, case when count(cret) over p >= 3 then stddev_samp(cret) over p end as sigma, case when count(amount) over p >= 3 then avg(amount) over p end / 1e6 as adv from rets window p as (partition by instrument order by datetime rows between 6 preceding and 1 preceding))"
    ", mids as (select datetime, median(adv) as mid from risk group by 1)"
    ", priced as (select datetime, 0.5 * sum(abs(w - wd)) as turnover, sum(w * ret) as gross, "
    "0.0005 * 0.5 * sum(abs(w - wd)) + 0.1 * sum(coalesce(sigma, 0) * abs(w - wd)) + 0.05 * sum(power(abs(w - wd), 1.5) / power(greatest(coalesce(adv, mid, 1e-8), 1e-8), 0.5)) as cost"
    " from mvs left join risk using (instrument, datetime) left join mids using (datetime) group by datetime)"
    ", bn as (select datetime, level / lag(level) over (order by datetime) - 1 as bench from (select datetime, avg(z) as level from r group by 1))"
    ", ahead as (select datetime, coalesce(lead(bench) over (order by datetime), 0) as b from bn)"
    ", dly as (select datetime, turnover, gross, cost, gross - coalesce(b, 0) - cost as net from priced left join ahead using (datetime))"
)

_Q = {
    "drift": (q_drift, f"{_TOP_SQL}{_DRIFT}{_MOVED} select {_r('w', 'wd', keep='instrument, datetime')} from mvs"),
    "drift_signed": (
        q_drift_signed,
        f"{_TOP_SQL}{_DRIFT}, sg as (select instrument, datetime, case when rk % 2 = 0 then -w else w end as w, ret from held), nav as (select datetime, 1 + sum(w * ret) as nav from sg group by 1), moved as (select instrument, next as datetime, case when nav < 1e-12 then w else w * (1 + ret) / nav end as wd from sg join nav using (datetime) join days using (datetime) where next is not null) select instrument, datetime, round(coalesce(wd, 0), 6) + 0.0 as wd from sg full join moved using (instrument, datetime)",
    ),
    "cost_model": (q_cost, f"{_TOP_SQL}{_DRIFT}{_MOVED}{_COST} select {_r('turnover', 'gross', 'cost', 'net', keep='datetime')} from dly"),
    "risk_summary": (
        q_risk,
        f"{_TOP_SQL}{_DRIFT}{_MOVED}{_COST}, cm as (select *, sum(net) over (order by datetime) as cum from dly), dn as (select *, cum - max(cum) over (order by datetime) as below from cm), f as (select avg(net) * 238 as arr, avg(net) / stddev_samp(net) * sqrt(238) as ir, min(below) as mdd, avg(net) * 238 / nullif(-min(below), 0) as calmar from dn) select {_r('arr', 'ir', 'mdd', 'calmar')} from f",
    ),
    "benchmark_return": (
        q_benchmark,
        f"{PANEL_SQL}, f as (select datetime, level / lag(level) over (order by datetime) - 1 as bench from (select datetime, avg(z) as level from r group by 1)) select {_r('bench', keep='datetime')} from f",
    ),
    "prediction_scale": (
        q_prediction_scale,
        f"{_LABELLED_SQL}, f as (select count(*) as n, var_pop(pred) as v, regr_slope(label, pred) as b from pairs where datetime < date '{SPLIT}') select round(case when n >= 100 and v > 0 and b > 0 then b else 1.0 end, 6) + 0.0 as beta from f",
    ),
    "is_oos_gap": (
        q_is_oos_gap,
        f"{_LABELLED_SQL}, f as (select avg(ic) filter (where datetime < date '{SPLIT}') - avg(ic) filter (where datetime >= date '{SPLIT}') as gap_ic, avg(rank_ic) filter (where datetime < date '{SPLIT}') - avg(rank_ic) filter (where datetime >= date '{SPLIT}') as gap_rank_ic from ics) select {_r('gap_ic', 'gap_rank_ic')} from f",
    ),
    "model_metrics": (
        q_model_metrics,
        f"{_LABELLED_SQL}, p as (select part, avg(ic) as ic from (select *, ntile(5) over (order by datetime) as part from ics) group by part), f as (select avg(ic) as ic, avg(rank_ic) as rank_ic, avg(ic) / stddev_samp(ic) as icir, avg(rank_ic) / stddev_samp(rank_ic) as rank_icir, avg(case when ic > 0 then 1.0 else 0 end) as ic_pos_frac, (select regr_slope(ic, part) from p) as slope, (select arg_min(ic, part) from p) as first, (select arg_max(ic, part) from p) as last from ics) select {_r('ic', 'rank_ic', 'icir', 'rank_icir', 'ic_pos_frac', 'slope', 'first', 'last')} from f",
    ),
    "date_window": (
        q_date_window,
        f"{PANEL_SQL} select instrument, datetime, round(close, 6) + 0.0 as close, volume from r where datetime between date '1996-01-01' and date '1998-12-31'",
    ),
    "universe_spans": (q_universe_spans, f'{PANEL_SQL}{_SPANS} select i as instrument, start, end_ as "end" from s'),
    "universe_mask": (
        q_universe_mask,
        f"{PANEL_SQL}{_SPANS} select instrument, datetime, round(case when datetime between start and end_ then close end, 6) + 0.0 as close, round(case when datetime between start and end_ then volume end, 6) + 0.0 as volume from r join s on instrument = i",
    ),
    "debug_sample": (
        q_debug_sample,
        f"{PANEL_SQL}, k as (select instrument from r group by 1 order by min(datetime), length(instrument), instrument limit 100) select instrument, datetime, round(close, 6) + 0.0 as close from r where instrument in (select instrument from k)",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items()}
