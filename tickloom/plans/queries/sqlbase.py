"""Shared SQL fragments: the same inputs as ``plans.inputs``, for the SQL side."""

from __future__ import annotations


def bars_cte(interval: str = "30 minutes", by: str = "event_type", name: str = "b") -> str:
    """CTEs ending in ``name``: indexed bars of the events."""
    return f"""bars0 AS (
  SELECT {by} AS symbol, time_bucket(INTERVAL '{interval}', ts) AS ts, arg_min(value, (ts, event_id)) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar FROM bars0)"""


DAILY = """daily0 AS (
  SELECT p_brand AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar FROM daily0)"""


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column without negative zero."""
    return f"(round({expr}, {digits}) + 0.0) AS {name}"


def frame(n: int, fn: str, m: int | None = None, key: str = "symbol", x: str | None = None) -> str:
    """``fn`` over the last n rows, null below m values (default n)."""
    x = x or fn[fn.index("(") + 1 : fn.index(")")].split(",")[0]
    w = f"(PARTITION BY {key} ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {n if m is None else m} THEN {fn} OVER {w} END"


def lag(x: str, k: int = 1, key: str = "symbol") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {key} ORDER BY bar)"


def ema_cte(src: str, out: str, specs: list[tuple[str, str, float]], first: int = 0, key: str = "symbol") -> str:
    """Recursive CTE ``out`` (key, bar, one column per spec) from ``src``; specs are (name, column, alpha)."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x, _ in specs)
    step = ", ".join(f"{1 - a!r} * e.{n} + {a!r} * s.{x} AS {n}" for n, x, a in specs)
    on = " AND ".join(f"s.{k.strip()} = e.{k.strip()}" for k in key.split(","))
    ks = ", ".join(f"s.{k.strip()}" for k in key.split(","))
    return f"""{out} AS (
  SELECT {key}, bar, {seed} FROM {src} WHERE bar = {first}
  UNION ALL
  SELECT {ks}, s.bar, {step} FROM {out} e JOIN {src} s ON {on} AND s.bar = e.bar + 1)"""


def debounce_cte(src: str, out: str, gap: int | str, key: str = "symbol", raw: str = "raw_dir") -> str:
    """Recursive state machine ``out`` (key, bar, dir, at) over ``src``."""
    ks = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"s.{k} = e.{k}" for k in ks)
    sel = ", ".join(f"s.{k}" for k in ks)
    ch = f"(s.{raw} <> e.dir AND s.bar - e.at >= {gap})"
    return f"""{out} AS (
  SELECT {key}, bar, {raw} AS dir, CASE WHEN {raw} <> 0 THEN bar ELSE -1000000 END AS at FROM {src} WHERE bar = 0
  UNION ALL
  SELECT {sel}, s.bar, CASE WHEN {ch} THEN s.{raw} ELSE e.dir END, CASE WHEN {ch} THEN s.bar ELSE e.at END
  FROM {out} e JOIN {src} s ON {on} AND s.bar = e.bar + 1)"""
