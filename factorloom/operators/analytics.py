"""Evaluation analytics, joins, rankings, aggregations and vector queries, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.library import ieee_div, pct_rank
from factorloom.operators.factor_queries import HIST, PANEL_SQL, _rank_sql, panel, rounded
from factorloom.sources.panel import table
from factorloom.sources.panel import bars as load_bars

SPLITS = 5
TOP_K = 10
KAPPA = {"turnover": 0.0005}


def _hist():
    return Window.partitionBy("instrument").orderBy("datetime")


# Prediction quality -------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, datetime, pred, label: momentum against the return after next."""
    w = _hist()
    out = panel(spark, sf_dir).withColumn("pred", F.col("z") - F.lag("z", 3).over(w))
    return out.withColumn("label", ieee_div(F.lead("z", 2).over(w), F.lead("z", 1).over(w)) - 1).select("instrument", "datetime", "pred", "label")


_LABELLED_SQL = (
    PANEL_SQL
    + f", lab as (select instrument, datetime, z - lag(z, 3) {HIST} as pred, lead(z, 2) {HIST} / lead(z, 1) {HIST} - 1 as label from r)"
    + ", pairs as (select * from lab where pred is not null and label is not null)"
    + ", ranked as (select *, rank() over (partition by datetime order by pred) + (count(*) over (partition by datetime, pred) - 1) / 2.0 as rp,"
    + " rank() over (partition by datetime order by label) + (count(*) over (partition by datetime, label) - 1) / 2.0 as rl from pairs)"
    + ", ics as (select datetime, covar_samp(pred, label) / (stddev_samp(pred) * stddev_samp(label)) as ic,"
    + " covar_samp(rp, rl) / (stddev_samp(rp) * stddev_samp(rl)) as rank_ic from ranked group by datetime"
    + " having count(*) >= 3 and stddev_samp(pred) > 0 and stddev_samp(label) > 0 and stddev_samp(rp) > 0 and stddev_samp(rl) > 0)"
)


def _corr(a: str, b: str):
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def ic_by_date(pairs: DataFrame) -> DataFrame:
    """datetime, ic, rank_ic; dates with under three pairs or a constant side are left out."""
    whole = pairs.where("pred is not null and label is not null")
    for c, r in (("pred", "rp"), ("label", "rl")):
        whole = whole.withColumn(r, pct_rank(F.col(c), "datetime"))
    out = whole.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), _corr("pred", "label").alias("ic"), _corr("rp", "rl").alias("rank_ic"))
    return out.where("n >= 3 and ic is not null and rank_ic is not null").drop("n")


def ic_summary(series: DataFrame) -> DataFrame:
    return series.agg(
        F.avg("ic").alias("ic"),
        F.avg("rank_ic").alias("rank_ic"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_pos_frac"),
    )


def decay(series: DataFrame, splits: int = SPLITS, weight: float = 0.5) -> DataFrame:
    """Means of equal sub-periods (one row per date in the window: small), their trend, and what it leaves of the mean.

    ``change`` is the trend over the whole series relative to the mean, from -1 to 1; ``kept`` is the mean
    less ``weight`` of its fall; ``ratio`` is the last mean over the first.  Nulls for too short a series.
    """
    parts = series.withColumn("part", F.ntile(splits).over(Window.orderBy("datetime"))).groupBy("part").agg(F.avg("ic").alias("ic"), F.sum("ic").alias("s"), F.count("ic").alias("n"))
    known = parts.agg(
        F.regr_slope("ic", F.col("part").cast("double")).alias("slope"), F.max_by("ic", "part").alias("last"), F.min_by("ic", "part").alias("first"),
        (F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("parts"),
    )
    change = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("slope") * (splits - 1) / F.greatest(F.abs("mean"), F.lit(1e-8))))
    ok = F.col("parts") >= splits
    return known.select(
        *(F.when(ok, F.col(c)).alias(c) for c in ("slope", "first", "last")),
        F.when(ok, change).alias("change"),
        F.when(ok, F.col("mean") * (1 - weight * F.greatest(F.lit(0.0), -change))).alias("kept"),
        F.when(ok & (F.col("first") != 0), F.col("last") / F.col("first")).alias("ratio"),
    )


def q_ic_series(spark, d):
    return rounded(ic_by_date(labelled(spark, d)), "ic", "rank_ic")


def q_ic_summary(spark, d):
    return rounded(ic_summary(ic_by_date(labelled(spark, d))), "ic", "rank_ic", "icir", "rank_icir", "ic_pos_frac")


def q_decay(spark, d):
    return rounded(decay(ic_by_date(labelled(spark, d))), "slope", "first", "last", "change", "kept", "ratio")


def q_rho_max(spark, d):
    """Greatest absolute mean correlation of a candidate with the factors of a library."""
    w = _hist()
    zoo = {"f_range": (F.col("high") - F.col("low")) / F.col("open"), "f_mom": F.col("z") - F.lag("z", 5).over(w), "f_vol": F.col("volume")}
    rows = panel(spark, d).select("datetime", (F.col("z") - F.lag("z", 3).over(w)).alias("c"), *(v.alias(k) for k, v in zoo.items()))
    # One pass: a library is a projection, not a join.
    each = rows.groupBy("datetime").agg(*(_corr_masked("c", k).alias(k) for k in zoo))
    means = each.agg(*(F.abs(F.avg(k)).alias(k) for k in zoo))
    return rounded(means.select(F.greatest(*(F.coalesce(k, F.lit(0.0)) for k in zoo)).alias("rho_max")), "rho_max")


def _corr_masked(a: str, b: str):
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def _corr_sql(a, b):
    both = f"filter (where {a} is not null and {b} is not null)"
    return f"case when count(*) {both} >= 3 and stddev_samp({a}) {both} > 0 and stddev_samp({b}) {both} > 0 then covar_samp({a}, {b}) {both} / (stddev_samp({a}) {both} * stddev_samp({b}) {both}) end"


# Execution, cost, book ----------------------------------------------------------------


def q_fill_return(spark, d):
    w = _hist()
    out = panel(spark, d).withColumn("fill", F.lead("open", 1).over(w)).withColumn("ret", ieee_div(F.lead("fill", 1).over(w), F.col("fill")) - 1)
    return rounded(out.select("instrument", "datetime", "fill", "ret"), "fill", "ret")


def q_trade_mask(spark, d, band: float = 0.5):
    """Locks and suspensions, moved to the decision bar; the last bar is refused."""
    w = _hist()
    move = ieee_div(F.col("close"), F.lag("close").over(w)) - 1
    locked = (F.col("high") <= F.col("low")) & (F.col("volume") > 0)
    out = panel(spark, d).withColumns(
        {
            "up": F.coalesce(locked & (move >= 0.98 * band), F.lit(False)),
            "down": F.coalesce(locked & (move <= -0.98 * band), F.lit(False)),
            "halt": F.coalesce(F.col("volume") <= 0, F.lit(True)) | F.col("close").isNull(),
        }
    )
    can = lambda c: F.coalesce(F.lead(~(F.col(c) | F.col("halt")), 1).over(w), F.lit(False)).cast("int")
    return out.select("instrument", "datetime", can("up").alias("can_buy"), can("down").alias("can_sell"))


def trailing(rows: DataFrame, span: int = 6) -> DataFrame:
    """Volatility and average amount of the bars strictly before."""
    w = _hist()
    out = rows.withColumn("ret", ieee_div(F.col("close"), F.lag("close").over(w)) - 1)
    past = w.rowsBetween(-span, -1)
    least = max(2, span // 2)
    return out.select(
        "instrument",
        "datetime",
        F.when(F.count("ret").over(past) >= least, F.stddev_samp("ret").over(past)).alias("sigma"),
        F.when(F.count("amount").over(past) >= least, F.avg("amount").over(past)).alias("adv"),
    )


def q_trailing_risk(spark, d):
    return rounded(trailing(panel(spark, d)), "sigma", "adv")


def top_weights(spark, d, k: int = TOP_K) -> DataFrame:
    """instrument, datetime, w, ret: equal weights of each date's k best scores, zeros kept."""
    w = _hist()
    rows = panel(spark, d).select("instrument", "datetime", "z", (F.col("z") - F.lag("z", 3).over(w)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("datetime").orderBy(F.col("score").desc_nulls_last(), "instrument"))
    rows = rows.withColumn("rk", rank).withColumn("w", F.when((F.col("rk") <= k) & F.col("score").isNotNull(), 1.0 / k).otherwise(0.0))
    return rows.withColumn("ret", F.coalesce(ieee_div(F.lead("z", 2).over(w), F.lead("z", 1).over(w)) - 1, F.lit(0.0)))


_TOP_SQL = (
    PANEL_SQL
    + f", s as (select instrument, datetime, z, z - lag(z, 3) {HIST} as score from r)"
    + ", k as (select *, row_number() over (partition by datetime order by score desc nulls last, instrument) as rk from s)"
    + f", wt as (select *, case when rk <= {TOP_K} and score is not null then {1 / TOP_K} else 0 end as w, coalesce(lead(z, 2) {HIST} / lead(z, 1) {HIST} - 1, 0) as ret from k)"
    + f", mv as (select *, abs(w - coalesce(lag(w) {HIST}, 0)) as dw from wt)"
    + f", net as (select datetime, 0.5 * sum(dw) as turnover, sum(w * ret) as gross, sum(w * ret) - {KAPPA['turnover']} * sum(dw) as net from mv group by datetime)"
)


def book(weights: DataFrame) -> DataFrame:
    """datetime, turnover, gross, net of proportional cost."""
    moved = weights.withColumn("dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(_hist()), F.lit(0.0))))
    return moved.groupBy("datetime").agg(
        (0.5 * F.sum("dw")).alias("turnover"),
        F.sum(F.col("w") * F.col("ret")).alias("gross"),
        (F.sum(F.col("w") * F.col("ret")) - KAPPA["turnover"] * F.sum("dw")).alias("net"),
    )


def q_topk(spark, d):
    return top_weights(spark, d).where("w > 0").select("instrument", "datetime", F.col("rk").cast("long").alias("rk"))


def q_net_return(spark, d):
    return rounded(book(top_weights(spark, d)), "turnover", "gross", "net")


def curve(daily: DataFrame) -> DataFrame:
    """nav, drawdown, excess by date: the window over all dates is as long as the calendar, not the data."""
    grow = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1 + F.col("net")).over(grow))
    return out.withColumn("drawdown", F.col("nav") / F.max("nav").over(grow) - 1).withColumn("excess", F.sum("net").over(grow))


def q_drawdown(spark, d):
    return rounded(curve(book(top_weights(spark, d))).select("datetime", "nav", "drawdown", "excess"), "nav", "drawdown", "excess")


def q_strategy(spark, d, periods: float = 12.0):
    """One computation of the book; the first date's turnover, from nothing, is left out."""
    out = curve(book(top_weights(spark, d)))
    out = out.withColumn("later", F.lag("datetime").over(Window.orderBy("datetime")).isNotNull())
    found = out.agg(
        (F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(periods))).alias("net_ir"),
        (F.pow(F.product(1 + F.col("net")), F.lit(periods) / F.count("net")) - 1).alias("net_arr"),
        F.min("drawdown").alias("mdd"),
        F.avg(F.when(F.col("later"), F.col("turnover"))).alias("turnover"),
        (F.avg(F.col("gross") - F.col("net")) * 1e4).alias("cost_bps"),
    )
    return rounded(found, "net_ir", "net_arr", "mdd", "turnover", "cost_bps")


# Joins, sets, aggregates --------------------------------------------------------------


def _daily(spark, d, name, key, day, value):
    return table(spark, d, name).groupBy(F.col(key).alias("k"), F.to_date(day).alias("day")).agg(F.round(F.sum(value), 2).alias("v"))


def q_join(how: str):
    def run(spark, d):
        a = _daily(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").withColumnRenamed("v", "qty")
        b = _daily(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed("v", "total")
        return a.join(b, ["k", "day"], how)

    return run


_A = "(select l_suppkey as k, cast(l_shipdate as date) as day, round(sum(l_quantity), 2) as qty from lineitem group by 1, 2) a"
_B = "(select o_custkey as k, cast(o_orderdate as date) as day, round(sum(o_totalprice), 2) as total from orders group by 1, 2) b"


def q_asof(spark, d):
    """Latest total on or before each day: one union and one window, no range join."""
    a, b = q_sides(spark, d)
    both = a.select("k", "day", "qty", F.lit(None).cast("double").alias("total"), F.lit(1).alias("side")).unionByName(
        b.select("k", "day", F.lit(None).cast("double").alias("qty"), "total", F.lit(0).alias("side"))
    )
    w = Window.partitionBy("k").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("total", F.last("total", ignorenulls=True).over(w)).where("side = 1").drop("side")


def q_sides(spark, d):
    return (
        _daily(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").withColumnRenamed("v", "qty"),
        _daily(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed("v", "total"),
    )


def q_interval(spark, d):
    """Bars inside their supplier's membership span (a year in from both ends of its ships)."""
    rows = load_bars(spark, d)
    spans = rows.groupBy("instrument").agg(F.add_months(F.min("datetime"), 12).alias("s"), F.add_months(F.max("datetime"), -12).alias("e"))
    return rows.join(spans, "instrument").where("datetime between s and e").select("instrument", "datetime")


def q_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    seen = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("semi").alias("side"))
    return seen.unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("anti").alias("side")))


def q_dedup_last(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


def q_setops(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, t: df.select("k", F.lit(t).alias("op"))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "left")).unionByName(tag(a.union(b).distinct(), "any"))


def q_pivot(spark, d):
    kinds = ["F", "O", "P"]
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", kinds).count()
    return out.select("o_orderpriority", *(F.coalesce(k, F.lit(0)).alias(f"n_{k.lower()}") for k in kinds))


def q_rollup(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    out = rows.rollup("lang").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return rounded(out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "quality", "toxic", "n"), "quality", "toxic")


def q_vector_topk(spark, d, k: int = 5, least: float = 0.1):
    """Cosine neighbours of a stated query set (every hundredth id), against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    e = e.withColumn("n", norm(F.col("v")))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # A hundredth of the rows: broadcast while small, else both sides are dealt in blocks, every pair of blocks once.
    n = q.count()
    if n <= 20_000:
        both = e.join(F.broadcast(q), F.col("vec_id") != F.col("query"))
    else:
        parts = -(-n // 20_000)
        q = q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(parts)))
        both = e.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))).join(q, "block").where("vec_id <> query")
    near = both.withColumn("sim", dot / (F.col("n") * F.col("qn"))).where(F.col("sim") > least)
    w = Window.partitionBy("query").orderBy(F.col("sim").desc(), "vec_id")
    return rounded(near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("query", "vec_id", F.col("rk").cast("long").alias("rk"), "sim"), "sim")


def q_year_ic(spark, d):
    out = ic_by_date(labelled(spark, d)).groupBy(F.year("datetime").alias("year")).agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n"))
    return rounded(out.where("n >= 6"), "ic")


def clean_rank(rows: DataFrame, column: str) -> DataFrame:
    """instrument, datetime, v: missing and infinite values as 0, ranked by date from 0 to 1, centred; a group of one has rank 1."""
    c = F.col(column)
    clean = rows.select("instrument", "datetime", F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c).alias("c"))
    return clean.select("instrument", "datetime", (pct_rank(F.col("c"), "datetime") - 0.5).alias("v"))


def q_clean_rank(spark, d):
    return rounded(clean_rank(panel(spark, d), "x"), "v")


def _r(*names: str, keep: str = "") -> str:
    return ", ".join([*filter(None, [keep]), *(f"round(cast({n} as double), 6) + 0.0 as {n}" for n in names)])


_NAV = ", g as (select *, product(1 + net) over (order by datetime) as nav, sum(net) over (order by datetime) as excess from net), dd as (select *, nav / max(nav) over (order by datetime) - 1 as drawdown from g)"

_Q = {
    "ic_series": (q_ic_series, f"{_LABELLED_SQL} select {_r('ic', 'rank_ic', keep='datetime')} from ics"),
    "ic_summary": (
        q_ic_summary,
        f"{_LABELLED_SQL}, f as (select avg(ic) as ic, avg(rank_ic) as rank_ic, avg(ic) / stddev_samp(ic) as icir, avg(rank_ic) / stddev_samp(rank_ic) as rank_icir, avg(case when ic > 0 then 1.0 else 0 end) as ic_pos_frac from ics) select {_r('ic', 'rank_ic', 'icir', 'rank_icir', 'ic_pos_frac')} from f",
    ),
    "decay_block": (
        q_decay,
        f"{_LABELLED_SQL}, p as (select part, avg(ic) as ic from (select *, ntile({SPLITS}) over (order by datetime) as part from ics) group by part), f as (select regr_slope(ic, part) as slope, arg_max(ic, part) as last, arg_min(ic, part) as first, (select avg(ic) from ics) as mean from p), g as (select *, greatest(-1, least(1, slope * {SPLITS - 1} / greatest(abs(mean), 1e-8))) as change, last / first as ratio from f), h as (select *, mean * (1 - 0.5 * greatest(0, -change)) as kept from g) select {_r('slope', 'first', 'last', 'change', 'kept', 'ratio')} from h",
    ),
    "ic_by_year": (q_year_ic, f"{_LABELLED_SQL}, f as (select year(datetime) as year, avg(ic) as ic, count(*) as n from ics group by 1 having count(*) >= 6) select {_r('ic', keep='year, n')} from f"),
    "rho_max": (
        q_rho_max,
        f"{PANEL_SQL}, f as (select datetime, z - lag(z, 3) {HIST} as c, (high - low) / open as f_range, z - lag(z, 5) {HIST} as f_mom, volume as f_vol from r), e as (select datetime, "
        + ", ".join(f"{_corr_sql('c', k)} as {k}" for k in ("f_range", "f_mom", "f_vol"))
        + " from f group by datetime) select round(greatest(abs(avg(f_range)), abs(avg(f_mom)), abs(avg(f_vol))), 6) + 0.0 as rho_max from e",
    ),
    "clean_rank": (q_clean_rank, f"{PANEL_SQL}, f as (select *, coalesce(x, 0) as c from r) select instrument, datetime, round({_rank_sql('c')} - 0.5, 6) + 0.0 as v from f"),
    "fill_return": (q_fill_return, f"{PANEL_SQL}, f as (select instrument, datetime, lead(open) {HIST} as fill, lead(open, 2) {HIST} / lead(open) {HIST} - 1 as ret from r) select {_r('fill', 'ret', keep='instrument, datetime')} from f"),
    "trade_mask": (
        q_trade_mask,
        f"{PANEL_SQL}, f as (select *, close / lag(close) {HIST} - 1 as move from r), g as (select *, coalesce(high <= low and volume > 0 and move >= 0.49, false) as up, coalesce(high <= low and volume > 0 and move <= -0.49, false) as down, volume <= 0 as halt from f) select instrument, datetime, coalesce(lead(not (up or halt)) {HIST}, false)::int as can_buy, coalesce(lead(not (down or halt)) {HIST}, false)::int as can_sell from g",
    ),
    "trailing_risk": (
        q_trailing_risk,
        f"{PANEL_SQL}, f as (select *, close / lag(close) {HIST} - 1 as ret from r), g as (select instrument, datetime, case when count(ret) over p >= 3 then stddev_samp(ret) over p end as sigma, case when count(amount) over p >= 3 then avg(amount) over p end as adv from f window p as (partition by instrument order by datetime rows between 6 preceding and 1 preceding)) select {_r('sigma', 'adv', keep='instrument, datetime')} from g",
    ),
    "topk_per_date": (q_topk, f"{_TOP_SQL} select instrument, datetime, rk from wt where w > 0"),
    "net_return": (q_net_return, f"{_TOP_SQL} select {_r('turnover', 'gross', 'net', keep='datetime')} from net"),
    "drawdown": (q_drawdown, f"{_TOP_SQL}{_NAV} select {_r('nav', 'drawdown', 'excess', keep='datetime')} from dd"),
    "strategy_metrics": (
        q_strategy,
        f"{_TOP_SQL}{_NAV}, f as (select avg(net) / stddev_samp(net) * sqrt(12) as net_ir, power(product(1 + net), 12.0 / count(*)) - 1 as net_arr, min(drawdown) as mdd, avg(turnover) filter (where datetime > (select min(datetime) from dd)) as turnover, avg(gross - net) * 1e4 as cost_bps from dd) select {_r('net_ir', 'net_arr', 'mdd', 'turnover', 'cost_bps')} from f",
    ),
    "join_outer": (q_join("full"), f"select coalesce(a.k, b.k) as k, coalesce(a.day, b.day) as day, qty, total from {_A} full join {_B} on a.k = b.k and a.day = b.day"),
    "join_inner": (q_join("inner"), f"select a.k, a.day, qty, total from {_A} join {_B} on a.k = b.k and a.day = b.day"),
    "join_left": (q_join("left"), f"select a.k, a.day, qty, total from {_A} left join {_B} on a.k = b.k and a.day = b.day"),
    "join_asof": (q_asof, f"select a.k, a.day, qty, total from {_A} asof left join {_B} on a.k = b.k and a.day >= b.day"),
    "join_interval": (
        q_interval,
        f"{PANEL_SQL}, s as (select instrument as i, cast(min(datetime) + interval 12 month as date) as s, cast(max(datetime) - interval 12 month as date) as e from r group by 1) select instrument, datetime from r join s on instrument = i and datetime between s and e",
    ),
    "semi_anti": (q_semi_anti, "select c_custkey, case when c_custkey in (select o_custkey from orders) then 'semi' else 'anti' end as side from customer"),
    "dedup_last": (q_dedup_last, "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"),
    "setops": (
        q_setops,
        "with a as (select distinct c_nationkey as k from customer), b as (select distinct s_nationkey as k from supplier where s_acctbal > 5000) select k, 'both' as op from (select k from a intersect select k from b) union all select k, 'left' from (select k from a except select k from b) union all select k, 'any' from (select k from a union select k from b)",
    ),
    "pivot": (q_pivot, "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o, count(*) filter (where o_orderstatus = 'P') as n_p from orders group by 1"),
    "rollup_total": (q_rollup, f"with f as (select coalesce(lang, 'all') as lang, avg(quality) as quality, avg(toxic) as toxic, count(*) as n from labels join documents using (doc_id) group by rollup (lang)) select {_r('quality', 'toxic', keep='lang, n')} from f"),
    "vector_topk": (
        q_vector_topk,
        "with e as (select vec_id, embedding::double[] as v from embeddings), n as (select a.vec_id as query, b.vec_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) as sim from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0), k as (select *, row_number() over (partition by query order by sim desc, vec_id) as rk from n where sim > 0.1) select query, vec_id, rk, round(sim, 6) + 0.0 as sim from k where rk <= 5",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items()}
