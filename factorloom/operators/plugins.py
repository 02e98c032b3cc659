"""Components named by a dotted path, and grouped kernels of a user's own.

A kernel is a function of a pandas frame that its caller passes or names; text is never executed.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from factorloom.operators.factor_queries import HIST, PANEL_SQL, panel, rounded


def component(path: str):
    """What ``package.module.name`` or ``package.module:name`` stands for."""
    module, _, name = path.partition(":") if ":" in path else path.rpartition(".")
    if not module:
        raise ValueError(f"{path!r} names no module")
    try:
        return getattr(importlib.import_module(module), name)
    except AttributeError:
        raise ValueError(f"{module} has no {name!r}") from None


def apply_kernel(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame] | str, schema: str, by: str = "instrument", order: str = "datetime") -> DataFrame:
    """``kernel`` applied to the ordered rows of every group; one group at a time is in a task's memory."""
    run = component(kernel) if isinstance(kernel, str) else kernel
    return rows.groupBy(by).applyInPandas(lambda frame: run(frame.sort_values(order)), schema)


def rolling_mean(frame: pd.DataFrame) -> pd.DataFrame:
    """The kernel of the query: a five-row mean."""
    return frame.assign(v=frame["close"].rolling(5, min_periods=1).mean())[["instrument", "datetime", "v"]]


def q_kernel(spark, d):
    rows = panel(spark, d).select("instrument", "datetime", "close")
    return rounded(apply_kernel(rows, "factorloom.operators.plugins:rolling_mean", "instrument string, datetime date, v double"), "v")


def queries() -> dict:
    return {"user_kernel": q_kernel}


def oracles() -> dict[str, str]:
    return {"user_kernel": f"{PANEL_SQL} select instrument, datetime, round(avg(close) {HIST[:-1]} rows between 4 preceding and current row), 6) + 0.0 as v from r"}
