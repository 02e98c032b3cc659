"""One query per function family of the factor language, over monthly bars, with its SQL check.

The panel carries, besides the bar fields, ``x`` (with nulls and ties), ``y`` and ``z``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.compiler import evaluate
from factorloom.plans.libraries import COMPACT_20, multi_span_66, wide_158
from factorloom.sources.panel import BARS_SQL, bars

PLACES = 6
FLAGSHIP = "RANK(-1 * TS_PCTCHANGE($close, 10)) + ($close > TS_MEAN($close, 5) ? ZSCORE(TS_STD($volume, 10)) : -0.5)"


def panel(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    missing = F.col("volume").cast("long") % 5 == 0
    return bars(spark, sf_dir, grain).select(
        "*",
        F.when(~missing, F.floor(F.col("close") / 5000) / 2).cast("double").alias("x"),
        (F.col("vwap") / 1000).alias("y"),
        (F.col("close") / 10000).alias("z"),
    )


PANEL_SQL = (
    "with "
    + BARS_SQL
    + """, r as (select *, case when cast(volume as bigint) % 5 <> 0 then floor(close / 5000) / 2 end as x,
    vwap / 1000 as y, close / 10000 as z, row_number() over (partition by instrument order by datetime) as rn from bars)"""
)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, PLACES) + 0.0 for n in names})


def factor_query(expressions: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(evaluate(panel(spark, sf_dir), expressions), *expressions)

    return run


def _w(p: int) -> str:
    return f"over (partition by instrument order by datetime rows between {p - 1} preceding and current row)"


HIST, CSW = "over (partition by instrument order by datetime)", "over (partition by datetime)"


def _sql(columns: dict[str, str], source: str = "r", more: str = "") -> str:
    picks = ", ".join(f"round(cast({c} as double), {PLACES}) + 0.0 as {n}" for n, c in columns.items())
    return f"{PANEL_SQL}{more} select instrument, datetime, {picks} from {source}"


def _pairs(columns: dict[str, str], p: int, more: str = "") -> str:
    """Aggregates over the window's rows (``b``, newest last, ``k`` rows ago) of each row ``a``."""
    picks = ", ".join(f"round(cast({c} as double), {PLACES}) + 0.0 as {n}" for n, c in columns.items())
    return (
        f"{PANEL_SQL}{more} select a.instrument, a.datetime, {picks} from r a join "
        f"(select instrument, rn as brn, x as bx, y as by_, z as bz from r) b on a.instrument = b.instrument "
        f"and b.brn between a.rn - {p - 1} and a.rn group by a.instrument, a.datetime, a.rn, a.x, a.y, a.z"
    )


def _rank_sql(x: str) -> str:
    return (
        f"case when {x} is not null then (rank() over (partition by datetime order by {x} nulls last) + "
        f"(count({x}) over (partition by datetime, {x}) - 1) / 2.0) / count({x}) {CSW} end"
    )


def _div(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then case when ({a}) > 0 then 'inf'::double when ({a}) < 0 then '-inf'::double end else ({a}) / ({b}) end"


def _ema(x: str, span: int) -> str:
    q = f"power({(span - 1) / (span + 1)!r}, a.rn - brn)"
    return f"sum({x} * {q}) / sum(case when {x} is not null then {q} end)"


def _corr_w(a: str, b: str, p: int) -> str:
    """Correlation over a window of the rows where both are known."""
    x, y = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    sd = [f"stddev_samp({v}) {_w(p)}" for v in (x, y)]
    return f"case when count({x}) {_w(p)} >= 2 and {sd[0]} > 0 and {sd[1]} > 0 then covar_samp({x}, {y}) {_w(p)} / ({sd[0]} * {sd[1]}) end"


def _family_sql(name: str, p: int) -> str:
    """SQL of one rolling family over ``p`` rows; ``g`` has c1, v1 (the last close, volume), d, dv and wt."""
    w = _w(p)
    up, down, whole = (lambda s: f"sum(case when {s} > 0 then {s} when {s} is not null then 0 end) {w}"), (lambda s: f"sum(case when {s} < 0 then -{s} when {s} is not null then 0 end) {w}"), (lambda s: f"(sum(abs({s})) {w} + 1e-12)")
    sums = {f"{lead}SUM{k}": f"({t}) / {whole(s)}" for lead, s in (("", "d"), ("V", "dv")) for k, t in (("P", up(s)), ("N", down(s)), ("D", f"{up(s)} - {down(s)}"))}
    rise, fall = f"sum(case when close > c1 then 1.0 else 0 end) {w}", f"sum(case when close < c1 then 1.0 else 0 end) {w}"
    imax, imin = f"(arg_max(rn, (high, -rn)) {w} - min(rn) {w} + 1)", f"(arg_min(rn, (low, rn)) {w} - min(rn) {w} + 1)"
    return (sums | {
        "ROC": f"lag(close, {p}) {HIST} / close", "MA": f"avg(close) {w} / close", "STD": f"stddev_samp(close) {w} / close", "BETA": f"regr_slope(close, rn) {w} / close",
        "RSQR": f"regr_r2(close, rn) {w}", "RESI": f"(close - (regr_slope(close, rn) {w} * rn + regr_intercept(close, rn) {w})) / close", "MAX": f"max(high) {w} / close", "MIN": f"min(low) {w} / close",
        "QTLU": f"quantile_cont(close, 0.8) {w} / close", "QTLD": f"quantile_cont(close, 0.2) {w} / close",
        "RANK": f"list_sum(list_transform(list(close) {w}, lambda v: case when v < close then 1.0 when v = close then 0.5 else 0 end)) / count(close) {w} + 0.5 / count(close) {w}",
        "RSV": f"(close - min(low) {w}) / (max(high) {w} - min(low) {w} + 1e-12)", "IMAX": f"{imax} / {p}", "IMIN": f"{imin} / {p}", "IMXD": f"({imax} - {imin}) / {p}",
        "CORR": _corr_w("close", "ln(volume + 1)", p), "CORD": _corr_w("(close / c1)", "ln(volume / v1 + 1)", p),
        "CNTP": f"{rise} / count(*) {w}", "CNTN": f"{fall} / count(*) {w}", "CNTD": f"({rise} - {fall}) / count(*) {w}",
        "VMA": f"avg(volume) {w} / (volume + 1e-12)", "VSTD": f"stddev_samp(volume) {w} / (volume + 1e-12)", "WVMA": f"stddev_samp(wt) {w} / (avg(wt) {w} + 1e-12)",
    })[name]


#: A window length that changes from row to row.
_SPAN = "MIN(FLOOR($volume / 20) + 1, 12)"


def _moving(f: str) -> str:
    return "case w " + " ".join(f"when {k} then {f}(close) {_w(k)}" for k in range(1, 13)) + " end"


_SHAPES = {"MID": "(close - open)", "UP": "(high - greatest(open, close))", "LOW": "(least(open, close) - low)", "SFT": "(2 * close - high - low)"}


def _wide_sql(library: dict[str, str]) -> str:
    fixed = {"KLEN": "(high - low) / open"} | {f"K{n}": f"{t} / open" for n, t in _SHAPES.items()} | {f"K{n}2": f"{t} / (high - low + 1e-12)" for n, t in _SHAPES.items()}
    fixed |= {f"{c.upper()}0": f"{c} / close" for c in ("open", "high", "low", "vwap")}
    split = lambda n: (n.rstrip("0123456789"), int(n[len(n.rstrip("0123456789")) :]))
    more = f", h as (select *, lag(close) {HIST} as c1, lag(volume) {HIST} as v1 from r), g as (select *, close - c1 as d, volume - v1 as dv, abs(close / c1 - 1) * volume as wt from h)"
    return _sql({n: fixed[n] if n in fixed else _family_sql(*split(n)) for n in library}, "g", more)


# name -> (expressions, SQL)
_F: dict[str, tuple[dict[str, str], str | None]] = {
    "cs_rank": ({"v": "RANK($x)"}, _sql({"v": _rank_sql("x")})),
    "cs_zscore": ({"v": "ZSCORE($x)"}, _sql({"v": _div(f"x - avg(x) {CSW}", f"stddev_samp(x) {CSW}")})),
    "cs_scale": ({"v": "SCALE($x, 2)"}, _sql({"v": _div("x * 2", f"sum(abs(x)) {CSW}")})),
    "cs_mean_std_median": (
        {"m": "MEAN($x)", "s": "STD($x)", "d": "MEDIAN($x)", "hi": "MAX($x)", "lo": "MIN($x)"},
        _sql({"m": f"avg(x) {CSW}", "s": f"stddev_samp(x) {CSW}", "d": f"quantile_cont(x, 0.5) {CSW}", "hi": f"max(x) {CSW}", "lo": f"min(x) {CSW}"}),
    ),
    "cs_skew": (
        {"v": "SKEW($z)"},
        _sql(
            {"v": "case when n >= 3 then m3 / power(m2, 1.5) end"},
            "g",
            f", c as (select *, avg(z) {CSW} as mu, count(z) {CSW} as n from r), g as (select *, avg((z - mu) ** 3) {CSW} as m3, avg((z - mu) ** 2) {CSW} as m2 from c)",
        ),
    ),
    "cs_kurt": ({"v": "KURT($z)"}, _sql({"v": f"case when count(z) {CSW} >= 4 then kurtosis_pop(z) {CSW} end"})),
    "cs_ranknorm": ({"v": "RANKNORM($x)"}, _sql({"v": f"({_rank_sql('x')} - 0.5) * 3.46"})),
    "ts_delay": ({"v": "DELAY($x, 3)"}, _sql({"v": f"lag(x, 3) {HIST}"})),
    "ts_delta": ({"v": "DELTA($x, 2)"}, _sql({"v": f"x - lag(x, 2) {HIST}"})),
    "ts_mean_sum": ({"m": "TS_MEAN($x, 5)", "s": "TS_SUM($x, 7)", "c": "SUMAC($x)"}, _sql({"m": f"avg(x) {_w(5)}", "s": f"sum(x) {_w(7)}", "c": f"sum(x) {_w(10)}"})),
    "ts_std_var": (
        {"s": "TS_STD($x)", "v1": "TS_VAR($x, 5)", "v0": "TS_VAR($x, 6, 0)"},
        _sql({"s": f"stddev_samp(x) {_w(20)}", "v1": f"var_samp(x) {_w(5)}", "v0": f"var_pop(x) {_w(6)}"}),
    ),
    "ts_minmax": ({"lo": "TS_MIN($x, 5)", "hi": "TS_MAX($x, 9)"}, _sql({"lo": f"min(x) {_w(5)}", "hi": f"max(x) {_w(9)}"})),
    "ts_median": ({"v": "TS_MEDIAN($x, 6)"}, _sql({"v": f"quantile_cont(x, 0.5) {_w(6)}"})),
    "ts_quantile": (
        {"v": "TS_QUANTILE($x, 8, 0.3)", "p": "PERCENTILE($x, 0.25, 10)", "h": "PERCENTILE($x, 0.75)"},
        _sql({"v": f"quantile_cont(x, 0.3) {_w(8)}", "p": f"quantile_cont(x, 0.25) {_w(10)}", "h": "quantile_cont(x, 0.75) over (partition by instrument)"}),
    ),
    "ts_rank": (
        {"v": "TS_RANK($x, 6)"},
        _pairs({"v": "case when a.x is not null then (count(*) filter (bx < a.x) + (count(*) filter (bx = a.x) + 1) / 2.0) / count(bx) end"}, 6),
    ),
    "ts_zscore": ({"v": "TS_ZSCORE($x, 8)"}, _sql({"v": _div(f"x - avg(x) {_w(8)}", f"stddev_samp(x) {_w(8)}")})),
    "ts_skew": (
        {"v": "TS_SKEW($z, 12)"},
        _pairs({"v": "case when count(bz) >= 3 then (avg(bz ** 3) - 3 * avg(bz) * avg(bz ** 2) + 2 * avg(bz) ** 3) / power(avg(bz ** 2) - avg(bz) ** 2, 1.5) end"}, 12),
    ),
    "ts_kurt": ({"v": "TS_KURT($z, 12)"}, _sql({"v": f"case when count(z) {_w(12)} >= 4 then kurtosis_pop(z) {_w(12)} end"})),
    "ts_argmax_argmin": ({"hi": "TS_ARGMAX($z, 7)", "lo": "TS_ARGMIN($z, 7)"}, _pairs({"hi": "a.rn - arg_max(brn, (bz, -brn))", "lo": "a.rn - arg_min(brn, (bz, brn))"}, 7)),
    "ts_highday_lowday": ({"hi": "HIGHDAY($z, 9)", "lo": "LOWDAY($z, 9)"}, _pairs({"hi": "1 + a.rn - arg_max(brn, (bz, -brn))", "lo": "1 + a.rn - arg_min(brn, (bz, brn))"}, 9)),
    "ts_corr": (
        {"v": "TS_CORR($z, $y, 10)"},
        _sql({"v": f"case when count(*) {_w(10)} >= 2 and stddev_samp(z) {_w(10)} > 0 and stddev_samp(y) {_w(10)} > 0 then covar_samp(z, y) {_w(10)} / (stddev_samp(z) {_w(10)} * stddev_samp(y) {_w(10)}) end"}),
    ),
    "ts_cov": ({"v": "TS_COVARIANCE($x, $y, 10)"}, _sql({"v": f"case when count(x) {_w(10)} >= 2 then covar_samp(x, y) {_w(10)} end"})),
    "ts_regbeta": ({"v": "REGBETA($z, $y, 8)"}, _sql({"v": f"case when rn >= 8 then regr_slope(z, y) {_w(8)} end"})),
    "ts_regresi": ({"v": "REGRESI($z, $y, 8)"}, _sql({"v": f"case when rn >= 8 then z - (regr_slope(z, y) {_w(8)} * y + regr_intercept(z, y) {_w(8)}) end"})),
    "ts_prod": ({"v": "PROD($x / 4, 4)"}, _sql({"v": f"case when count(x) {_w(4)} = count(*) {_w(4)} then product(x / 4) {_w(4)} end"})),
    "ts_count": ({"v": "COUNT($x > 2, 6)"}, _sql({"v": f"sum(case when x > 2 then 1 else 0 end) {_w(6)}"})),
    "ts_sumif": ({"v": "SUMIF($y, 6, $x > 2)"}, _sql({"v": f"sum(case when x > 2 then y else 0 end) {_w(6)}"})),
    "ts_filter": ({"v": "FILTER($x, $y > 30)"}, _sql({"v": "case when y > 30 then x else x * 0 end"})),
    "ts_pctchange": ({"v": "TS_PCTCHANGE($x, 2)"}, _sql({"v": "coalesce(" + _div("x", "l") + " - 1, 0)"}, "g", f", g as (select *, lag(x, 2) {HIST} as l from r)")),
    "ts_mad": ({"v": "TS_MAD($z * 10000, 7)"}, _pairs({"v": "mad(bz * 10000)"}, 7)),
    "sma": ({"m": "SMA($x, 5)", "e": "SMA($x, 5, 2)"}, _pairs({"m": "avg(bx) filter (brn > a.rn - 5)", "e": "sum(bx * power(0.6, a.rn - brn)) / sum(case when bx is not null then power(0.6, a.rn - brn) end)"}, 9999)),
    "ema": ({"v": "EMA($x, 6)"}, _pairs({"v": _ema("bx", 6)}, 9999)),
    "wma": ({"v": "WMA($x, 6)"}, _pairs({"v": "case when count(bx) = count(*) then sum(bx * power(0.9, a.rn - brn)) / sum(power(0.9, a.rn - brn)) end"}, 6)),
    "decaylinear": ({"v": "DECAYLINEAR($x, 5)"}, _pairs({"v": "case when count(bx) = count(*) then sum(bx * (least(a.rn, 5) - (a.rn - brn))) / 15.0 end"}, 5)),
    "macd": ({"v": "MACD($z)"}, _pairs({"v": f"{_ema('bz', 12)} - {_ema('bz', 26)}"}, 9999)),
    "rsi": (
        {"v": "RSI($z)"},
        f"{PANEL_SQL}, g as (select instrument, datetime, rn, z - lag(z) {HIST} as d from r), u as (select *, case when d > 0 then d else 0 end as up, case when d < 0 then -d else 0 end as dn from g),"
        " e as (select a.instrument, a.datetime, sum(b.up * power(13.0 / 15, a.rn - b.rn)) as up, sum(b.dn * power(13.0 / 15, a.rn - b.rn)) as dn from u a join u b on a.instrument = b.instrument and b.rn <= a.rn group by 1, 2)"
        " select instrument, datetime, round(case when dn = 0 then case when up > 0 then 100.0 end else 100 - 100 / (1 + up / dn) end, 6) + 0.0 as v from e",
    ),
    "ts_argmax_null": (
        {"hi": "TS_ARGMAX($x, 5)", "lo": "LOWDAY($x, 5)"},
        _pairs({"hi": "a.rn - coalesce(min(brn) filter (where bx is null), arg_max(brn, (bx, -brn)))", "lo": "1 + a.rn - coalesce(min(brn) filter (where bx is null), arg_min(brn, (bx, brn)))"}, 5),
    ),
    "ts_sequence": (
        {"b": "REGBETA($z, SEQUENCE(6), 6)", "c": "TS_CORR($z, SEQUENCE(6), 6)", "e": "REGRESI($z, SEQUENCE(6), 6)"},
        _sql({"b": f"case when rn >= 6 then regr_slope(z, rn) {_w(6)} end", "c": f"case when rn >= 2 and stddev_samp(z) {_w(6)} > 0 then covar_samp(z, rn) {_w(6)} / (stddev_samp(z) {_w(6)} * stddev_samp(rn) {_w(6)}) end",
              "e": f"case when rn >= 6 then z - (regr_slope(z, rn) {_w(6)} * rn + regr_intercept(z, rn) {_w(6)}) end"}),
    ),
    "bollinger": (
        {"m": "BB_MIDDLE($close, 10)", "u": "BB_UPPER($close, 10)", "l": "BB_LOWER($close, 10)"},
        _sql({"m": f"avg(close) {_w(10)}", "u": f"avg(close) {_w(10)} + stddev_samp(close) {_w(10)}", "l": f"avg(close) {_w(10)} - stddev_samp(close) {_w(10)}"}),
    ),
    "bollinger_dynamic": (
        {"m": f"BB_MIDDLE($close, {_SPAN})", "u": f"BB_UPPER($close, {_SPAN})"},
        _sql({"m": _moving("avg"), "u": f"{_moving('avg')} + {_moving('stddev_samp')}"}, "g", ", g as (select *, least(floor(volume / 20) + 1, 12)::int as w from r)"),
    ),
    "ew_math": (
        {"e": "EXP(-$z)", "s": "SQRT($x - 2)", "l": "LOG($y)", "i": "INV($x)", "p": "POW($z, 2)", "f": "FLOOR($y)", "g": "SIGN($x - 2)", "a": "ABS($x - 2)"},
        _sql({"e": "exp(-z)", "s": "case when x >= 2 then sqrt(x - 2) end", "l": "ln(y + 1)", "i": _div("1.0", "x"), "p": "z * z", "f": "floor(y)", "g": "sign(x - 2)", "a": "abs(x - 2)"}),
    ),
    "ew_maxmin": (
        {"hi": "MAX($x, $z, 1)", "lo": "MIN($x, $y)"},
        _sql({"hi": "case when x is not null then greatest(x, z, 1) end", "lo": "case when x is not null then least(x, y) end"}),
    ),
    "logic_where": (
        {"v": "$x > 2 && $y > 30 || $z < 1 ? $y : -$z", "n": "$x && true ? 1 : 0"},
        _sql({"v": "case when coalesce(x > 2, false) and y > 30 or z < 1 then y else -z end", "n": "case when coalesce(x <> 0, true) then 1 else 0 end"}),
    ),
    "cmp_ops": (
        {"gt": "$x > 2", "lt": "$x < 2", "ge": "$x >= 2", "le": "$x <= 2", "eq": "$x == 2", "ne": "$x != 2"},
        _sql({n: f"case when coalesce(x {o} 2, {d}) then 1 else 0 end" for n, o, d in (("gt", ">", "false"), ("lt", "<", "false"), ("ge", ">=", "false"), ("le", "<=", "false"), ("eq", "=", "false"), ("ne", "<>", "true"))}),
    ),
    "dsl_flagship": (
        {"v": FLAGSHIP},
        _sql(
            {"v": _rank_sql("neg") + f" + case when coalesce(close > m5, false) then {_div(f'vs - avg(vs) {CSW}', f'stddev_samp(vs) {CSW}')} else -0.5 end"},
            "h",
            f", g as (select *, lag(close, 10) {HIST} as l10, avg(close) {_w(5)} as m5, stddev_samp(volume) {_w(10)} as vs from r), h as (select *, -1 * coalesce(close / l10 - 1, 0) as neg from g)",
        ),
    ),
    "alpha158": (wide_158(), _wide_sql(wide_158())),
    "alpha66": (multi_span_66(), _wide_sql(multi_span_66())),
    "alpha158_20": (
        COMPACT_20,
        _sql(
            {
                "ROC0": "(close - open) / open", "ROC1": "ret", **{f"ROC{p}": f"(close - lag(close, {p}) {HIST}) / lag(close, {p}) {HIST}" for p in (5, 10, 20)},
                "VRATIO5": f"volume / avg(volume) {_w(5)}", "VRATIO10": f"volume / avg(volume) {_w(10)}", "VSTD5_RATIO": f"stddev_samp(volume) {_w(5)} / avg(volume) {_w(5)}",
                "RANGE": "(high - low) / open", "VOLATILITY5": f"stddev_samp(close) {_w(5)} / close", "VOLATILITY10": f"stddev_samp(close) {_w(10)} / close", "RET_VOL5": f"stddev_samp(ret) {_w(5)}",
                **{f"RSV{p}": f"(close - min(low) {_w(p)}) / (max(high) {_w(p)} - min(low) {_w(p)} + 1e-12)" for p in (5, 10)},
                "HIGH_RATIO5": f"close / max(high) {_w(5)} - 1", "LOW_RATIO5": f"close / min(low) {_w(5)} - 1",
                "SHADOW_RATIO": "(high - close) / (close - low + 1e-12)", "BODY_RATIO": "(close - open) / (high - low + 1e-12)",
                **{f"MA_RATIO{p}_{2 * p}": f"avg(close) {_w(p)} / avg(close) {_w(2 * p)} - 1" for p in (5, 10)},
            },
            "g",
            f", g as (select *, close / lag(close) {HIST} - 1 as ret from r)",
        ),
    ),
}


def scan_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir), "open", "high", "low", "close", "volume", "amount", "vwap")


def queries() -> dict:
    return {"scan_bars": scan_bars} | {name: factor_query(e) for name, (e, _) in _F.items()}


def oracles() -> dict[str, str]:
    cols = {f: f for f in ("open", "high", "low", "close", "volume", "amount", "vwap")}
    return {"scan_bars": _sql(cols)} | {name: sql for name, (_, sql) in _F.items() if sql}
