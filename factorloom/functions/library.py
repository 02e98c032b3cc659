"""Functions of the factor language: element-wise, cross-sectional (by datetime) and rolling (by instrument).

NULL stands for a missing value throughout; NaN never arises.  Rolling windows count
rows, newest last, and are shorter at the start of an instrument's history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.plans.parser import Call, Num

INF = float("inf")
#: Weights below this share of the newest are under the precision of a double.
EWM_TAIL = 1e-18


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def cs():
    """All instruments of one datetime."""
    return Window.partitionBy("datetime")


def history():
    """One instrument's rows in time order."""
    return Window.partitionBy("instrument").orderBy("datetime")


def rows(p: int):
    if p < 1:
        raise ValueError("a window needs at least one row")
    return history().rowsBetween(-(int(p) - 1), 0)



def ieee_div(a, b) -> Column:
    a, b = _lit(a).cast("double"), _lit(b).cast("double")
    return F.when(b == 0, F.when(a > 0, INF).when(a < 0, -INF)).otherwise(F.try_divide(a, b))


def _number(c) -> Column:
    return _lit(c).cast("double")


def _truth(c) -> Column:
    return F.coalesce(_lit(c).cast("boolean"), F.lit(True))


def _finite_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def _strict(pick):
    def apply(*xs):
        if len(xs) == 1:
            return (F.max if pick is F.greatest else F.min)(xs[0]).over(cs())
        ok = _number(xs[0]).isNotNull()
        for x in xs[1:]:
            ok &= _number(x).isNotNull()
        return F.when(ok, pick(*map(_number, xs)))

    return apply


def _log1p(x) -> Column:
    x = _number(x)
    return F.when(x == -1, -INF).when(x > -1, F.log1p(x))


SCALAR = {
    "ADD": lambda a, b: _number(a) + _number(b),
    "SUBTRACT": lambda a, b: _number(a) - _number(b),
    "MULTIPLY": lambda a, b: _number(a) * _number(b),
    "DIVIDE": ieee_div,
    "NEG": lambda a: -_number(a),
    "GT": lambda a, b: F.coalesce(a > b, F.lit(False)),
    "LT": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "GE": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "LE": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "EQ": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "NE": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "AND": lambda a, b: _truth(a) & _truth(b),
    "OR": lambda a, b: _truth(a) | _truth(b),
    "WHERE": lambda c, a, b: F.when(_truth(c), _number(a)).otherwise(_number(b)),
    "FILTER": lambda x, c: _number(x) * _truth(c).cast("double"),
    "ABS": F.abs,
    "EXP": lambda x: F.exp(_number(x)),
    "SQRT": lambda x: F.when(_number(x) >= 0, F.sqrt(_number(x))),
    "LOG": _log1p,
    "INV": lambda x: ieee_div(F.lit(1.0), x),
    "POW": lambda x, n: _finite_nan(F.pow(_number(x), _number(n))),
    "FLOOR": lambda x: F.floor(x).cast("double"),
    "SIGN": F.signum,
}


def _count(x, p):
    return F.count(x).over(rows(p))


def pct_rank(x: Column, *by: str) -> Column:
    """Average-tie percentile rank among non-null values of a group."""
    below = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*by)))


def _list(x, p) -> Column:
    """The window's values, nulls kept."""
    return F.transform(F.collect_list(F.struct(_number(x).alias("v"))).over(rows(p)), lambda s: s["v"])


def _full(values: Column, result) -> Column:
    """``result`` unless a value of the window is null, which poisons it."""
    return F.when(~F.exists(values, lambda v: v.isNull()), result)


def _ts_rank(x, p=5):
    got = F.collect_list(x).over(rows(p))
    below = F.size(F.filter(got, lambda e: e < x)) + (F.size(F.filter(got, lambda e: e == x)) + 1) / 2
    return F.when(x.isNotNull(), below / F.size(got))


def _ago(pick):
    def apply(x, p=5):
        got = _list(x, p)
        # A null counts as the extreme; of ties the oldest is it.
        at = F.coalesce(
            F.when(F.exists(got, lambda v: v.isNull()), F.array_position(F.transform(got, lambda v: v.isNull()), True)),
            F.array_position(got, pick(got)),
        )
        return (F.size(got) - at).cast("double")

    return apply


def _index(pick):
    """Place of the extreme in its window, the oldest row being 1; of ties the oldest."""
    return lambda x, p=5: F.array_position(F.collect_list(x).over(rows(p)), pick(F.collect_list(x).over(rows(p)))).cast("double")


def _corr(a, b, p=5):
    a2, b2 = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    w = rows(p)
    spread = F.stddev_samp(a2).over(w) * F.stddev_samp(b2).over(w)
    return F.when(F.count(a2).over(w) >= 2, F.try_divide(F.covar_samp(a2, b2).over(w), spread))


def _cov(a, b, p=5):
    ok = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(rows(p)) >= 2
    return F.when(ok, F.covar_samp(a, b).over(rows(p)))


def _regression(y, x, p):
    """Slope and intercept over full windows, nulls as 0; of the least norm where x is constant."""
    y, x, w = F.coalesce(_number(y), F.lit(0.0)), F.coalesce(_number(x), F.lit(0.0)), rows(p)
    flat = F.min(x).over(w) == F.max(x).over(w)
    mean = F.avg(y).over(w)
    slope = F.when(flat, x * mean / (x * x + 1)).otherwise(F.regr_slope(y, x).over(w))
    cut = F.when(flat, mean / (x * x + 1)).otherwise(F.regr_intercept(y, x).over(w))
    return F.row_number().over(history()) >= p, y, x, slope, cut


def _regbeta(y, x, p=5):
    full, _, _, slope, _ = _regression(y, x, p)
    return F.when(full, slope)


def _regresi(y, x, p=5):
    full, y, x, slope, cut = _regression(y, x, p)
    return F.when(full, y - (slope * x + cut))


def _ewm(x, alpha: float):
    """Exponentially weighted mean, adjusted, missing values keeping their place.

    The window ends where weights fall under a double's precision, so work per row is
    bounded however long a history is.
    """
    if alpha >= 1:
        return x
    q = 1 - alpha
    span = math.ceil(math.log(EWM_TAIL) / math.log(q))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def step(acc, v):
        return F.struct(
            (acc["n"] * q + F.coalesce(v, F.lit(0.0))).alias("n"), (acc["d"] * q + F.when(v.isNull(), 0.0).otherwise(1.0)).alias("d")
        )

    return F.aggregate(_list(x, span), zero, step, lambda acc: F.try_divide(acc["n"], acc["d"]))


def _weighted(x, p, weights: list[float], renormalised: bool):
    """Newest value under the first weight."""
    got = F.reverse(_list(x, p))
    w = F.slice(F.array(*map(F.lit, weights)), 1, F.size(got))
    total = F.aggregate(F.zip_with(got, w, lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    if renormalised:
        total = total / F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    return _full(got, total)


def _middle(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def _mad(x, p=5):
    got = _list(x, p)
    return _full(got, _middle(F.transform(got, lambda v: F.abs(v - _middle(got)))))


def _quantile(x, p=5, q=0.5):
    if 0 < p < 1:
        p, q = q, p
    return F.percentile(x, float(q)).over(rows(p))


def _lagged(x, p):
    if p < 0:
        raise ValueError("a negative period looks ahead")
    return F.lag(x, int(p)).over(history())


def _z(x, w):
    return ieee_div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


#: Longest window of a length that changes from row to row.
LONGEST = 250


def _moments(x, p) -> tuple[Column, Column]:
    """Mean and deviation of the last ``p`` rows; ``p`` may be a column, then it is cut to 1 .. LONGEST."""
    if not isinstance(p, Column):
        return F.avg(x).over(rows(p)), F.stddev_samp(x).over(rows(p))
    n = F.least(F.greatest(F.floor(p), F.lit(1)), F.lit(LONGEST)).cast("int")
    got = _list(x, LONGEST)
    tail = F.filter(F.slice(got, F.greatest(F.size(got) - n + 1, F.lit(1)), n), lambda v: v.isNotNull())
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = F.when(F.size(tail) > 0, total(tail) / F.size(tail))
    square = total(F.transform(tail, lambda v: (v - mean) * (v - mean)))
    known = n.isNotNull()
    return F.when(known, mean), F.when(known & (F.size(tail) > 1), F.sqrt(square / (F.size(tail) - 1)))


def _band(sign):
    def apply(x, p=20):
        mean, sd = _moments(x, p)
        return mean + sign * sd if sign else mean

    return apply


def _bool_sum(x, p):
    return F.sum(_truth(x).cast("double")).over(rows(p))


WINDOWED = {
    "RANK": lambda x: pct_rank(x, "datetime"),
    "MEAN": lambda x: F.avg(x).over(cs()),
    "STD": lambda x: F.stddev_samp(x).over(cs()),
    "MEDIAN": lambda x: F.percentile(x, 0.5).over(cs()),
    "SKEW": lambda x: F.when(F.count(x).over(cs()) >= 3, F.skewness(x).over(cs())),
    "KURT": lambda x: F.when(F.count(x).over(cs()) >= 4, F.kurtosis(x).over(cs())),
    "ZSCORE": lambda x: _z(x, cs()),
    "SCALE": lambda x, target=1: ieee_div(x * float(target), F.sum(F.abs(x)).over(cs())),
    "MAX": _strict(F.greatest),
    "MIN": _strict(F.least),
    "RANKNORM": lambda x: (pct_rank(x, "datetime") - 0.5) * 3.46,
    "DELAY": _lagged,
    "DELTA": lambda x, p=1: x - _lagged(x, p),
    "TS_MEAN": lambda x, p=5: F.avg(x).over(rows(p)),
    "TS_SUM": lambda x, p=5: F.sum(x).over(rows(p)),
    "SUMAC": lambda x, p=10: F.sum(x).over(rows(p)),
    "TS_STD": lambda x, p=20: F.stddev_samp(x).over(rows(p)),
    "TS_VAR": lambda x, p=5, ddof=1: (F.var_samp if ddof else F.var_pop)(x).over(rows(p)),
    "TS_MAX": lambda x, p=5: F.max(x).over(rows(p)),
    "TS_MIN": lambda x, p=5: F.min(x).over(rows(p)),
    "TS_MEDIAN": lambda x, p=5: F.percentile(x, 0.5).over(rows(p)),
    "TS_QUANTILE": _quantile,
    "PERCENTILE": lambda x, q, p=None: F.percentile(x, float(q)).over(rows(p) if p else Window.partitionBy("instrument")),
    "TS_RANK": _ts_rank,
    "TS_ZSCORE": lambda x, p=5: _z(x, rows(p)),
    "TS_SKEW": lambda x, p=5: F.when(_count(x, p) >= 3, F.skewness(x).over(rows(p))),
    "TS_KURT": lambda x, p=5: F.when(_count(x, p) >= 4, F.kurtosis(x).over(rows(p))),
    "TS_ARGMAX": _ago(F.array_max),
    "TS_ARGMIN": _ago(F.array_min),
    "HIGHDAY": lambda x, p=5: _ago(F.array_max)(x, p) + 1,
    "LOWDAY": lambda x, p=5: _ago(F.array_min)(x, p) + 1,
    "IDXMAX": _index(F.array_max),
    "IDXMIN": _index(F.array_min),
    "TS_CORR": _corr,
    "TS_COVARIANCE": _cov,
    "REGBETA": _regbeta,
    "REGRESI": _regresi,
    "PROD": lambda x, p=5: F.when(_count(x, p) == F.count(F.lit(1)).over(rows(p)), F.product(x).over(rows(p))),
    "COUNT": lambda c, p=20: _bool_sum(c, p),
    "COUNTIF": lambda c, p=20: _bool_sum(c, p),
    "SUMIF": lambda x, p, c: F.sum(x * _truth(c).cast("double")).over(rows(p)),
    "TS_MAD": _mad,
    "SMA": lambda x, m, n=None: F.avg(x).over(rows(m)) if n is None else _ewm(x, n / m),
    "EMA": lambda x, p: _ewm(x, 2 / (p + 1)),
    "WMA": lambda x, p=20: _weighted(x, p, [0.9**k for k in range(p)], True),
    "DECAYLINEAR": lambda x, p=5: _decay(x, p),
    "ROWID": lambda: F.row_number().over(history()).cast("double"),
    "REGSLOPE": lambda y, x, p: F.regr_slope(y, x).over(rows(p)),
    "REGR2": lambda y, x, p: F.regr_r2(y, x).over(rows(p)),
    "REGREST": lambda y, x, p: y - (F.regr_slope(y, x).over(rows(p)) * x + F.regr_intercept(y, x).over(rows(p))),
    "BB_MIDDLE": _band(0),
    "BB_UPPER": _band(1),
    "BB_LOWER": _band(-1),
}


def _decay(x, p):
    """Weights 1..p over their sum, the oldest value of the window first; a short window is not renormalised."""
    got = _list(x, p)
    w = F.slice(F.array(*(F.lit(k / (p * (p + 1) / 2)) for k in range(1, p + 1))), 1, F.size(got))
    return _full(got, F.aggregate(F.zip_with(got, w, lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v))


def _rsi(x, p=Num(14.0)):
    step = Call("DELTA", (x, Num(1.0)))
    up = Call("EMA", (Call("WHERE", (Call("GT", (step, Num(0.0))), step, Num(0.0))), p))
    down = Call("EMA", (Call("WHERE", (Call("LT", (step, Num(0.0))), Call("ABS", (step,)), Num(0.0))), p))
    return Call("SUBTRACT", (Num(100.0), Call("DIVIDE", (Num(100.0), Call("ADD", (Num(1.0), Call("DIVIDE", (up, down))))))))


#: Functions that are expressions of others.
COMPOSED = {
    "MACD": lambda x, s=Num(12.0), l=Num(26.0): Call("SUBTRACT", (Call("EMA", (x, s)), Call("EMA", (x, l)))),  # noqa: E741
    "RSI": _rsi,
    "TS_PCTCHANGE": lambda x, p=Num(1.0): Call("ZERO", (Call("SUBTRACT", (Call("DIVIDE", (x, Call("DELAY", (x, p)))), Num(1.0))),)),
}
COMPOSED |= {
    name: (lambda f: lambda x, p: Call(f, (x, Call("ROWID", ()), p)))(inner)
    for name, inner in {"TS_SLOPE": "REGSLOPE", "TS_RSQUARE": "REGR2", "TS_RESI": "REGREST"}.items()
}
#: A sequence 1..n against a window of n rows: only differences of its values count, so the row number stands for it.
COMPOSED["SEQUENCE"] = lambda n=Num(1.0): Call("ROWID", ())
SCALAR["ZERO"] = lambda x: F.coalesce(_number(x), F.lit(0.0))
