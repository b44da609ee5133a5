"""Seeded price walks and per-symbol reference computations in pandas for the tests."""

import numpy as np
import pandas as pd


def walk(symbols=("A", "B"), n=300, seed=7, step_s=1800):
    """Random-walk bars; symbols have different lengths."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, s in enumerate(symbols):
        m = n - 37 * k
        c = 100 + np.cumsum(rng.normal(0, 1, m))
        o = np.r_[c[0], c[:-1]]
        h = np.maximum(o, c) + rng.random(m)
        lo = np.minimum(o, c) - rng.random(m)
        ts = pd.date_range("2024-01-01", periods=m, freq=f"{step_s}s")
        frames.append(pd.DataFrame({"symbol": s, "ts": ts, "open": o, "high": h, "low": lo, "close": c,
                                    "volume": rng.integers(1, 100, m).astype(float), "bar": np.arange(m)}))
    return pd.concat(frames, ignore_index=True)


def to_pandas(df, *order):
    return df.toPandas().sort_values(list(order or ("symbol", "bar"))).reset_index(drop=True)


def debounce_loop(raw, gap):
    """Bar-by-bar state machine: hold a direction for at least gap bars."""
    held, since, out = 0, None, []
    for i, d in enumerate(raw):
        if d != held and (since is None or i - since >= gap):
            held, since = d, i
        out.append(held)
    return out
