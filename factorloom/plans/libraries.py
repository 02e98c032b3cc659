"""Ready-made factor libraries: name -> expression."""

from __future__ import annotations

# The twenty compact factors.
COMPACT_20 = {
    "ROC0": "($close-$open)/$open",
    "ROC1": "$close/DELAY($close, 1)-1",
    "ROC5": "($close-DELAY($close, 5))/DELAY($close, 5)",
    "ROC10": "($close-DELAY($close, 10))/DELAY($close, 10)",
    "ROC20": "($close-DELAY($close, 20))/DELAY($close, 20)",
    "VRATIO5": "$volume/TS_MEAN($volume, 5)",
    "VRATIO10": "$volume/TS_MEAN($volume, 10)",
    "VSTD5_RATIO": "TS_STD($volume, 5)/TS_MEAN($volume, 5)",
    "RANGE": "($high-$low)/$open",
    "VOLATILITY5": "TS_STD($close, 5)/$close",
    "VOLATILITY10": "TS_STD($close, 10)/$close",
    "RET_VOL5": "TS_STD($close/DELAY($close, 1)-1, 5)",
    "RSV5": "($close-TS_MIN($low, 5))/(TS_MAX($high, 5)-TS_MIN($low, 5)+1e-12)",
    "RSV10": "($close-TS_MIN($low, 10))/(TS_MAX($high, 10)-TS_MIN($low, 10)+1e-12)",
    "HIGH_RATIO5": "$close/TS_MAX($high, 5)-1",
    "LOW_RATIO5": "$close/TS_MIN($low, 5)-1",
    "SHADOW_RATIO": "($high-$close)/($close-$low+1e-12)",
    "BODY_RATIO": "($close-$open)/($high-$low+1e-12)",
    "MA_RATIO5_10": "TS_MEAN($close, 5)/TS_MEAN($close, 10)-1",
    "MA_RATIO10_20": "TS_MEAN($close, 10)/TS_MEAN($close, 20)-1",
}

SPANS = (5, 10, 20, 30, 60)


def wide_158() -> dict[str, str]:
    """Nine bar shapes, four price ratios and 29 rolling families over five spans."""
    eps = "1e-12"
    top, bottom = "MAX($open,$close)", "MIN($open,$close)"
    shapes = {"MID": "$close-$open", "UP": f"$high-{top}", "LOW": f"{bottom}-$low", "SFT": "2*$close-$high-$low"}
    out = {"KLEN": "($high-$low)/$open"}
    for name, text in shapes.items():
        out[f"K{name}"] = f"({text})/$open"
        out[f"K{name}2"] = f"({text})/($high-$low+{eps})"
    out |= {f"{f.upper()}0": f"${f}/$close" for f in ("open", "high", "low", "vwap")}
    move, vmove = "DELTA($close,1)", "DELTA($volume,1)"
    weight = "(ABS($close/DELAY($close,1)-1)*$volume)"
    # Rows present in the window, fewer than its span at the start.
    present = "COUNT($close==$close,{p})"
    # The rolling families.
    rolling = {
        "ROC": "DELAY($close,{p})/$close",
        "MA": "TS_MEAN($close,{p})/$close",
        "STD": "TS_STD($close,{p})/$close",
        "BETA": "TS_SLOPE($close,{p})/$close",
        "RSQR": "TS_RSQUARE($close,{p})",
        "RESI": "TS_RESI($close,{p})/$close",
        "MAX": "TS_MAX($high,{p})/$close",
        "MIN": "TS_MIN($low,{p})/$close",
        "QTLU": "TS_QUANTILE($close,{p},0.8)/$close",
        "QTLD": "TS_QUANTILE($close,{p},0.2)/$close",
        "RANK": "TS_RANK($close,{p})",
        "RSV": f"($close-TS_MIN($low,{{p}}))/(TS_MAX($high,{{p}})-TS_MIN($low,{{p}})+{eps})",
        "IMAX": "IDXMAX($high,{p})/{p}",
        "IMIN": "IDXMIN($low,{p})/{p}",
        "IMXD": "(IDXMAX($high,{p})-IDXMIN($low,{p}))/{p}",
        "CORR": "TS_CORR($close,LOG($volume),{p})",
        "CORD": "TS_CORR($close/DELAY($close,1),LOG($volume/DELAY($volume,1)),{p})",
        "CNTP": f"COUNT($close>DELAY($close,1),{{p}})/{present}",
        "CNTN": f"COUNT($close<DELAY($close,1),{{p}})/{present}",
        "CNTD": f"(COUNT($close>DELAY($close,1),{{p}})-COUNT($close<DELAY($close,1),{{p}}))/{present}",
        "VMA": "TS_MEAN($volume,{p})/($volume+1e-12)",
        "VSTD": "TS_STD($volume,{p})/($volume+1e-12)",
        "WVMA": f"TS_STD({weight},{{p}})/(TS_MEAN({weight},{{p}})+{eps})",
    }
    for lead, step in (("", move), ("V", vmove)):
        whole = f"(TS_SUM(ABS({step}),{{p}})+{eps})"
        up, down = f"TS_SUM(MAX({step},0),{{p}})", f"TS_SUM(MAX(-({step}),0),{{p}})"
        rolling |= {f"{lead}SUMP": f"{up}/{whole}", f"{lead}SUMN": f"{down}/{whole}", f"{lead}SUMD": f"({up}-{down})/{whole}"}
    return out | {f"{n}{p}": t.replace("{p}", str(p)) for n, t in rolling.items() for p in SPANS}


#: Spans of the third library, and of its moving families alone.
NEAR, FAR = (5, 10, 20, 30, 60), (3, 7, 15, 40, 120)


def multi_span_66() -> dict[str, str]:
    """Nine families over five spans, three of them over five more, and six bar shapes."""
    # Families of the third library.
    moving = {"ROC": "DELAY($close,{p})/$close", "MA": "TS_MEAN($close,{p})/$close", "STD": "TS_STD($close,{p})/$close"}
    other = {
        "MAX": "TS_MAX($high,{p})/$close",
        "MIN": "TS_MIN($low,{p})/$close",
        "RSV": "($close-TS_MIN($low,{p}))/(TS_MAX($high,{p})-TS_MIN($low,{p})+1e-12)",
        "VMA": "TS_MEAN($volume,{p})/($volume+1e-12)",
        "VSTD": "TS_STD($volume,{p})/($volume+1e-12)",
        "CORR": "TS_CORR($close,LOG($volume),{p})",
    }
    out = {f"{n}{p}": t.replace("{p}", str(p)) for p in NEAR for n, t in (moving | other).items()}
    out |= {f"{n}{p}": t.replace("{p}", str(p)) for p in FAR for n, t in moving.items()}
    shapes = wide_158()
    return out | {n: shapes[n] for n in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")}


LIBRARIES = {"compact_20": lambda: dict(COMPACT_20), "wide_158": wide_158, "multi_span_66": multi_span_66}
