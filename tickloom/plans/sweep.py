"""Parameter sweeps: many parameter rows evaluated in one job.

Indicators are computed once per distinct length; a bar is then joined with the
grid by exploding a literal array, so every (symbol, combination) is an
independent series that Spark spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import risk_notional, sweep_score
from tickloom.operators import indicators as I
from tickloom.operators.barriers import Barriers, outcomes_by_rule
from tickloom.operators.blocks import blocked, core
from tickloom.operators.debounce import debounce
from tickloom.operators.ema import Ema, add_emas, ema_back
from tickloom.operators.filters import top_k
from tickloom.operators.ledger import ledger
from tickloom.operators.metrics import core_pack, trade_performance
from tickloom.session import cut

# Accepted names of the mean-reversion parameters and their defaults.
ALIASES = {"boll_window": "bb_len", "boll_mult": "bb_k", "min_gap_bars": "gap", "min_gap": "gap"}
DEFAULTS = {"rsi_len": 14, "rsi_low": 15.0, "rsi_high": 85.0, "bb_len": 20, "bb_k": 2.0, "gap": 15}


def grid_rows(grid: Mapping[str, Sequence[Any]], defaults: Mapping[str, Any] = DEFAULTS) -> list[dict[str, Any]]:
    """All combinations of the lists, completed by the defaults; unknown names are refused."""
    named = {ALIASES.get(k, k): list(v) for k, v in grid.items()}
    unknown = [k for k in named if k not in defaults]
    if unknown:
        raise ValueError(f"unknown parameter(s) {', '.join(unknown)}")
    keys = list(named)
    return [{**defaults, **dict(zip(keys, values)), "combo": i} for i, values in enumerate(product(*named.values()))]


def grid_column(rows: Sequence[Mapping[str, Any]]) -> Column:
    """The grid as a literal array of structs (numbers as double or int, text as string)."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def meanrev_sweep(bars: DataFrame, grid: Mapping[str, Sequence[Any]], notional: float = 10_000.0,
                  equity0: float = 1_000_000.0) -> DataFrame:
    """One metrics row with ``score`` per symbol and parameter combination."""
    rows = [{**r, "rsi_low": float(r["rsi_low"]), "rsi_high": float(r["rsi_high"]), "bb_k": float(r["bb_k"])} for r in grid_rows(grid)]
    rsis, bands = sorted({r["rsi_len"] for r in rows}), sorted({r["bb_len"] for r in rows})
    rows = [{**r, "ri": rsis.index(r["rsi_len"]), "bi": bands.index(r["bb_len"])} for r in rows]
    d = blocked(bars.select("symbol", "ts", "bar", "close"), back=max(ema_back([1.0 / n for n in rsis], 1), max(bands)))
    d = I.rsi_inputs(d).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_gain", "_loss")})
    d = add_emas(d, [Ema(f"_{p}{n}", x, 1.0 / n, 1) for n in rsis for p, x in (("u", "_gain"), ("d", "_loss"))])
    d = d.withColumns({f"_m{n}": I.rolling("close", n, "mean") for n in bands} | {f"_s{n}": I.rolling("close", n, "std_pop") for n in bands})
    d = d.withColumns({
        "rsi": F.array(*[I.rsi_of(f"_u{n}", f"_d{n}") for n in rsis]),
        "mid": F.array(*[F.col(f"_m{n}") for n in bands]), "dev": F.array(*[F.col(f"_s{n}") for n in bands]),
    })
    d = core(d).withColumn("g", F.explode(grid_column(rows)))
    rsi, mid, dev, c = F.get("rsi", F.col("g.ri")), F.get("mid", F.col("g.bi")), F.get("dev", F.col("g.bi")), F.col("close")
    long = (rsi < F.col("g.rsi_low")) & (c <= mid - F.col("g.bb_k") * dev)
    short = (rsi > F.col("g.rsi_high")) & (c >= mid + F.col("g.bb_k") * dev)
    d = d.select("symbol", "bar", "close", F.col("g.combo").alias("combo"), F.col("g.gap").alias("gap"),
                 F.when(long, 1).when(short, -1).otherwise(0).alias("raw_dir"))
    keys = ("symbol", "combo")
    d = debounce(cut(d), "gap", out="side", keys=keys).withColumn("size", F.lit(notional))
    m = core_pack(ledger(d, equity0=equity0, keys=keys), keys)
    params = F.element_at(F.filter(grid_column(rows), lambda g: g["combo"] == F.col("combo")), 1)
    return m.withColumn("_g", params).select(
        "symbol", "combo", *[F.col(f"_g.{k}").alias(k) for k in DEFAULTS], *[c for c in m.columns if c not in keys]
    ).withColumn("score", sweep_score())


def probability_sweep(bars: DataFrame, variations: Sequence[Mapping[str, Any]], p: str = "p", vol: str = "vol",
                      equity0: float = 1_000_000.0) -> DataFrame:
    """One-factor sweep of thresholds and risk for a given probability.

    ``variations`` rows: kind, param, value, th_long, th_short, risk.  Returns metrics and ``score`` per row.
    """
    rows = [{**v, "combo": i} for i, v in enumerate(variations)]
    d = bars.withColumn("g", F.explode(grid_column(rows)))
    q = F.col(p)
    side = F.when(q >= F.col("g.th_long"), 1).when(q <= F.col("g.th_short"), -1).otherwise(0)
    # risk enters linearly: size at risk 1, scaled and limited again
    size = F.least(risk_notional(vol, p, equity0, 1.0, 1e9) * F.col("g.risk"), F.lit(equity0))
    d = d.select("symbol", "bar", "close", F.col("g.combo").alias("combo"), side.alias("side"),
                 F.coalesce(size, F.lit(0.0)).alias("size"))
    keys = ("symbol", "combo")
    m = core_pack(ledger(d, equity0=equity0, keys=keys), keys)
    g = F.element_at(F.filter(grid_column(rows), lambda x: x["combo"] == F.col("combo")), 1)
    return m.withColumn("_g", g).select(
        "symbol", "combo", *[F.col(f"_g.{k}").alias(k) for k in ("kind", "param", "value")],
        *[c for c in m.columns if c not in keys]
    ).withColumn("score", sweep_score())


def around(base_long: float, base_short: float, risk: float, deltas: Sequence[float] = (-0.03, -0.01, 0.0, 0.01, 0.03),
           risks: Sequence[float] = (0.0005, 0.001, 0.002)) -> list[dict[str, Any]]:
    """Variations around calibrated thresholds, one factor at a time."""
    rows = []
    for d in deltas:
        rows.append(dict(kind="threshold", param="th_long", value=round(base_long + d, 4), th_long=round(base_long + d, 4), th_short=base_short, risk=risk))
        rows.append(dict(kind="threshold", param="th_short", value=round(base_short + d, 4), th_long=base_long, th_short=round(base_short + d, 4), risk=risk))
    for x in risks:
        rows.append(dict(kind="risk", param="per_trade_risk", value=x, th_long=base_long, th_short=base_short, risk=x))
    return rows


def barrier_sweep(bars: DataFrame, rules: Mapping[str, Barriers], side: str = "side") -> DataFrame:
    """Trade statistics per symbol and barrier rule; all rules share one range join."""
    return trade_performance(outcomes_by_rule(bars, rules, side), "ret", ("symbol", "rule"))


def best_configs(results: DataFrame, k: int = 5, group: Sequence[str] = ("symbol", "kind", "param")) -> DataFrame:
    """Top-k rows per group by score."""
    return top_k(results, k, group, "score", tie=["combo"])


def nested_top(best: DataFrame, value: str = "value") -> DataFrame:
    """Top-k rows as one JSON document per symbol: kind -> param -> list of rows."""
    lists = best.groupBy("symbol", "kind", "param").agg(
        F.sort_array(F.collect_list(F.struct("rank", value, "score"))).alias("items")
    )
    kinds = lists.groupBy("symbol", "kind").agg(F.collect_list(F.struct("param", "items")).alias("ps"))
    # map columns cannot be sorted, entry lists can; maps are built at the very end
    docs = kinds.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("kind", F.sort_array("ps").alias("ps")))).alias("ks"))
    tree = F.map_from_entries(F.transform("ks", lambda k: F.struct(k["kind"], F.map_from_entries(k["ps"]))))
    return docs.select("symbol", F.to_json(tree).alias("items"))
