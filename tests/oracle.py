"""Side-by-side comparison of a query with its DuckDB SQL."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def check(got: pd.DataFrame, want: pd.DataFrame, places: int = 6) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    cols = sorted(got.columns)
    frames = []
    for df in (got, want):
        df = df[cols].copy()
        for c in cols:
            if pd.api.types.is_numeric_dtype(df[c]):
                df[c] = df[c].astype("float64")
            else:
                df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else v if isinstance(v, float) else str(v))
        keys = [c for c in cols if df[c].dtype == object] + [c for c in cols if df[c].dtype != object]
        frames.append(df.sort_values(keys, kind="stable").reset_index(drop=True))
    a, b = frames
    for c in cols:
        if a[c].dtype == object or b[c].dtype == object:
            bad = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (pd.isna(x) and pd.isna(y))]
        else:
            bad = np.flatnonzero(~np.isclose(a[c], b[c], rtol=1e-12, atol=1.1 * 10**-places, equal_nan=True))
        if len(bad):
            return f"{c}: {len(bad)} of {len(a)} differ, first {a.loc[bad[0]].to_dict()} / {b.loc[bad[0]].to_dict()}"
    return None
