"""Per-symbol state over a stream of bars: averages, relative strength, held signal, drawdown.

Row windows do not exist on streams, so the few numbers that the recursions need
are kept per symbol.  Results equal the batch operators for bars in time order; a
bar older than the last one seen cannot be applied any more and is flagged late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.ema import span
from tickloom.operators.signals import Trend

OUTPUT = ("symbol string, ts timestamp, close double, ema_fast double, ema_slow double, rsi double, raw_dir int, "
          "signal int, peak double, drawdown double, alert boolean, late boolean")
STATE = ("n long, last_us long, prev double, fast double, slow double, atr double, up double, dn double, held int, "
         "since long, peak double")


def fresh() -> dict:
    """The numbers of a symbol without a bar."""
    return {"n": 0, "last_us": -1, "prev": 0.0, "fast": 0.0, "slow": 0.0, "atr": 0.0, "up": 0.0, "dn": 0.0, "held": 0, "since": -(10**9), "peak": 0.0}


def _advance(s: dict, row, p: Trend, rsi_len: int, limit: float) -> tuple:
    """One bar: update the state in place and return the output fields."""
    c, h, low = row.close, row.high, row.low
    first = s["n"] == 0
    ref = c if first else s["prev"]
    tr = max(h - low, abs(h - ref), abs(low - ref))

    def smooth(name, x, a):
        s[name] = x if first else (1 - a) * s[name] + a * x

    smooth("fast", c, span(p.fast))
    smooth("slow", c, span(p.slow))
    smooth("atr", tr, span(p.atr_len))
    rsi = None
    if not first:
        gain, loss, a = max(c - s["prev"], 0.0), max(s["prev"] - c, 0.0), 1.0 / rsi_len
        start = s["n"] == 1
        s["up"] = gain if start else (1 - a) * s["up"] + a * gain
        s["dn"] = loss if start else (1 - a) * s["dn"] + a * loss
        rsi = 100.0 - 100.0 / (1.0 + s["up"] / (s["dn"] + 1e-9))
    strength = (s["fast"] - s["slow"]) / (s["atr"] + 1e-9)
    raw = 1 if strength > p.threshold and c > s["slow"] else -1 if strength < -p.threshold and c < s["slow"] else 0
    if raw != s["held"] and s["n"] - s["since"] >= p.gap:
        s["held"], s["since"] = raw, s["n"]
    s["peak"] = c if first else max(s["peak"], c)
    dd = c / s["peak"] - 1.0 if s["peak"] else 0.0
    s["prev"], s["n"] = c, s["n"] + 1
    return s["fast"], s["slow"], rsi, raw, s["held"], s["peak"], dd, dd < -limit, False


def stateful_signals(bars: DataFrame, p: Trend = Trend(), rsi_len: int = 14, limit: float = 0.3) -> DataFrame:
    """Averages, RSI, held trend signal and drawdown alert per symbol over a stream of bars.

    ``limit`` is the drawdown of the close from its peak that raises an alert.  A
    symbol's rows of one micro-batch are sorted in its task; bound them at the
    source (files or offsets per batch).
    """
    names = [f.split()[0] for f in STATE.split(", ")]
    fields = ["ema_fast", "ema_slow", "rsi", "raw_dir", "signal", "peak", "drawdown", "alert", "late"]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks)).sort_values("ts", kind="stable")
        s = dict(zip(names, state.get)) if state.exists else fresh()
        out = []
        for row in pdf.itertuples():
            us = int(row.ts.value // 1000)
            if us <= s["last_us"]:
                out.append((None, None, None, None, s["held"], s["peak"], None, False, True))
                continue
            s["last_us"] = us
            out.append(_advance(s, row, p, rsi_len, limit))
        state.update(tuple(s[n] for n in names))
        res = pd.DataFrame(out, columns=fields)
        res.insert(0, "close", pdf["close"].to_numpy())
        res.insert(0, "ts", pdf["ts"].to_numpy())
        res.insert(0, "symbol", key[0])
        res["raw_dir"] = res["raw_dir"].astype("Int32")
        yield res

    return bars.groupBy("symbol").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
