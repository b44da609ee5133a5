"""Zero prices, volumes and peaks give nulls, never an error (ANSI division)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features, indicators, metrics, quality, regimes, signals
from tickloom.operators.barriers import Barriers, barrier_outcomes
from tickloom.operators.blocks import blocked, core
from tickloom.operators.episodes import trade_log
from tickloom.operators.ledger import ledger
from tickloom.plans.inputs import price_probability


@pytest.fixture(scope="module")
def zeros(spark):
    """Sixty bars of which the first, a middle one and the last have all values zero, and a symbol of zeros only."""
    rows = []
    for s in ("A", "Z"):
        for i in range(60):
            x = 0.0 if s == "Z" or i in (0, 30, 59) else 100.0 + (i * 7) % 11
            rows.append((s, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=30 * i), x, x * 1.01, x * 0.99, x, 0.0 if x == 0 else 5.0, i))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume", "bar"]))


def traded(bars):
    return bars.withColumns({"side": F.when(F.col("bar") % 10 < 5, 1).otherwise(-1), "size": F.lit(1000.0)})


JOBS = {
    "full_pack": features.full_pack, "micro_pack": features.micro_pack, "light_pack": features.light_pack, "basic_pack": features.basic_pack,
    "atr_regime": regimes.atr_regime, "detect_regime": regimes.detect_regime, "dynamic_regime": regimes.dynamic_regime,
    "volatility_regime": regimes.volatility_regime, "trend_report": quality.trend_report, "value_report": quality.value_report,
    "density": quality.density, "trend_signal": signals.trend_signal, "meanrev_signal": signals.meanrev_signal,
    "breakout_signal": signals.breakout_signal,
    "atr": lambda d: core(indicators.add_atr(blocked(d, back=15), 14, "half", "atr")),
    "ledger": lambda d: ledger(traded(d)), "no_equity": lambda d: ledger(traded(d), equity0=0.0),
    "extended_pack": lambda d: metrics.extended_pack(ledger(traded(d))),
    "equity_metrics": lambda d: metrics.equity_metrics(d.withColumn("equity", F.col("close"))),
    "equity_positive": lambda d: metrics.equity_metrics_variant(d.withColumn("equity", F.col("close")), "positive"),
    "trade_log": lambda d: trade_log(traded(d), "side"),
    "barriers": lambda d: barrier_outcomes(traded(d), Barriers(take=0.01, stop=0.01, max_hold=5)),
    "probability": lambda d: d.withColumn("p", price_probability()),
}


@pytest.mark.parametrize("name", list(JOBS))
def test_zeros_end_no_job(zeros, name):
    rows = JOBS[name](zeros).collect()
    assert rows and all(x is None or not isinstance(x, float) or abs(x) != float("inf") for r in rows for x in r)
