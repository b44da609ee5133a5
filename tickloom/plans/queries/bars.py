"""Bars, data checks and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import quality, relations
from tickloom.operators.blocks import index_bars, prefix
from tickloom.operators.resample import dense_grid, resample, resample_cascade, resample_right
from tickloom.plans.inputs import bars, daily, event_signals, orders_daily, table, ticks
from tickloom.plans.queries.sqlbase import DAILY, bars_cte, r
from tickloom.session import shared_dir
from tickloom.sources import checked_write

OHLC = "symbol, ts, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))


def a1_resample(interval):
    return lambda spark, sf: resample(ticks(spark, sf), interval, order=["ts", "seq"], price="price")


def a1_sql(interval):
    return f"WITH {bars_cte(interval)} SELECT {OHLC} FROM b"


def a2_right(spark, sf):
    ten = resample(ticks(spark, sf), "10min", order=["ts", "seq"], price="price")
    return resample_right(ten, "30min", zone="Europe/Moscow")


def a2_pass_through(spark, sf):
    ten = resample(ticks(spark, sf), "10min", order=["ts", "seq"], price="price")
    return resample_right(ten, "10min")


A2 = f"""WITH {bars_cte('10 minutes')},
q AS (SELECT *, time_bucket(INTERVAL '30 minutes', ts - INTERVAL 1 MICROSECOND) + INTERVAL '30 minutes' AS lab FROM b)
SELECT symbol, lab + INTERVAL 3 HOUR AS ts, {r('arg_min(open, ts)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')},
       {r('arg_max(close, ts)', 'close')}, {r('sum(volume)', 'volume')} FROM q GROUP BY symbol, lab"""


def a3_cascade(spark, sf):
    return resample_cascade(ticks(spark, sf), ["10min", "30min", "1h"], order=["ts", "seq"], price="price")


A3 = " UNION ALL ".join(
    f"SELECT '{n}' AS interval, {OHLC} FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '{i}', ts) AS ts,"
    f" arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,"
    f" count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"
    for n, i in (("10min", "10 minutes"), ("30min", "30 minutes"), ("1h", "1 hour"))
)


def a4_dense(spark, sf):
    return dense_grid(resample(ticks(spark, sf), "30min", order=["ts", "seq"], price="price"), "30min", slice_days=7)


A4 = f"""WITH {bars_cte()}, s AS (SELECT symbol, min(ts) lo, max(ts) hi FROM b GROUP BY 1),
g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL '30 minutes')) AS ts FROM s)
SELECT g.symbol, g.ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')},
       coalesce(volume, 0.0) AS volume FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.ts = b.ts"""


def a5_summary(spark, sf):
    return quality.summary(resample(ticks(spark, sf), "30min", order=["ts", "seq"], price="price"))


A5 = f"""WITH {bars_cte()} SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
 {r('arg_min(close, ts)', 'first_close')}, {r('arg_min(volume, ts)', 'first_volume')}, {r('arg_max(close, ts)', 'last_close')},
 {r('arg_max(volume, ts)', 'last_volume')} FROM b GROUP BY symbol"""


def _raw_quotes(spark, sf):
    """Line items as untidy bars: repeated days, prices in unrelated columns, arrival by order key."""
    from tickloom.plans.inputs import table

    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("open"), (F.col("l_extendedprice") / 20.0).alias("high"),
        (F.col("l_extendedprice") / 40.0).alias("low"), (F.col("l_extendedprice") / 30.0).alias("close"),
        (F.col("l_quantity") - F.col("l_linenumber") * 2).alias("volume"),
    )


RAW = """q AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS open, l_extendedprice / 20.0 AS high,
 l_extendedprice / 40.0 AS low, l_extendedprice / 30.0 AS close, l_quantity - l_linenumber * 2 AS volume FROM lineitem)"""


def a6_bar_report(spark, sf):
    raw = _raw_quotes(spark, sf)
    rows_in = raw.groupBy("symbol").agg(F.count_if(F.col("volume") > 40).alias("rows_in"))
    return quality.bar_report(raw, rows_in)


A6 = f"""WITH {RAW} SELECT symbol, count(*) AS rows_out, count(*) - count(DISTINCT ts) AS duplicate_ts,
 count_if(low > high) AS low_above_high, count_if(open < low OR open > high) AS open_outside,
 count_if(close < low OR close > high) AS close_outside, count_if(volume < 0) AS negative_volume,
 count_if(volume > 40) AS rows_in, coalesce(count(*) / nullif(count_if(volume > 40), 0) > 10, false) AS ratio_suspicious
FROM q GROUP BY symbol"""


def of_write(bars_of, report):
    """A report that reads what a checked write left instead of the bars."""
    def run(spark, sf):
        path = f"{shared_dir(spark)}/tickloom/checked-{uuid.uuid4().hex}"
        checked_write.write_checked(bars_of(spark, sf), path)
        return report(spark, path)

    return run


A6W = f"SELECT * EXCLUDE (rows_in, ratio_suspicious) FROM ({A6})"


def a6_disorder(spark, sf):
    o = orders_seq(spark, sf)
    return quality.arrival_disorder(o, "seq", width=4096)


def orders_seq(spark, sf):
    from tickloom.plans.inputs import table

    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq")
    )


A6B = """SELECT symbol, count_if(ts < p) AS unsorted FROM (SELECT o_orderpriority AS symbol, o_orderdate AS ts,
 lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) GROUP BY symbol"""

A7 = f"""WITH {DAILY}, d AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rr FROM b)
SELECT symbol, count(*) AS n_rows, count_if(close IS NULL) AS null_close, count_if(volume IS NULL) AS null_volume,
 count_if(isinf(close)) AS inf_close, count_if(close <= 0) AS nonpositive_close, {r('min(close)', 'min_close')},
 {r('max(close)', 'max_close')}, {r('avg(close)', 'mean_close')}, {r('min(volume)', 'min_volume')}, {r('max(volume)', 'max_volume')},
 {r('avg(volume)', 'mean_volume')}, {r('avg(rr)', 'mean_ret')}, {r('stddev_samp(rr)', 'std_ret')}, {r('min(rr)', 'min_ret')},
 {r('max(rr)', 'max_ret')}, count_if(abs(rr) > 0.1) AS jumps FROM d GROUP BY symbol"""

A8 = f"""WITH {bars_cte('4 hours')}, d AS (SELECT symbol, count(*) AS n_rows, date_diff('day', min(ts), max(ts)) AS days FROM b GROUP BY 1)
SELECT symbol, n_rows, days::INT AS days, {r('n_rows / greatest(days, 1)', 'bars_per_day')}, n_rows / greatest(days, 1) < 20 AS low_density FROM d"""

A9 = f"""WITH {DAILY}, d AS (SELECT *, lag(close) OVER w AS p, close / lag(close) OVER w - 1 AS rr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
e AS (SELECT *, lag(rr) OVER (PARTITION BY symbol ORDER BY bar) AS rp FROM d)
SELECT symbol, {r('corr(close, p)', 'autocorr_close')}, {r('corr(rr, rp)', 'autocorr_ret')},
 {r('arg_max(close, bar) / arg_min(close, bar) - 1', 'total_trend')}, {r('stddev_samp(rr)', 'volatility')} FROM e GROUP BY symbol"""


def u2_dedup(spark, sf):
    o = event_signals(spark, sf)
    day = o.withColumn("day", F.date_trunc("day", "ts")).select("symbol", "day", "score", "seq")
    return relations.dedup(day, ["symbol", "day"], ["seq"], "last")


def u1_union(spark, sf):
    a, b = daily(spark, sf), orders_daily(spark, sf)
    u = a.drop("volume").unionByName(b, allowMissingColumns=True)
    return u.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("volume").alias("n_vol"), F.round(F.sum("close"), 2).alias("s"))


ORD = """o0 AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
 FROM orders GROUP BY 1, 2)"""


def u3_common(spark, sf):
    h1 = resample(ticks(spark, sf), "1h", order=["ts", "seq"], price="price")
    m30 = resample(ticks(spark, sf), "30min", order=["ts", "seq"], price="price")
    return relations.common_times(h1, m30)


def u3_all(spark, sf):
    h1 = resample(ticks(spark, sf), "1h", order=["ts", "seq"], price="price")
    m30 = resample(ticks(spark, sf), "30min", order=["ts", "seq"], price="price")
    return relations.all_times(h1, m30)


T1H = "SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts FROM events"
T30 = "SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts FROM events"


def null_rows(s, sf):
    """Positions and running sums where symbols and times are missing: no row may vanish."""
    e = table(s, sf, "events")
    t = e.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("symbol"),
                 F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    return prefix(index_bars(t, order=["ts", "seq"]), {"odd": ("sum", F.col("seq") % 2)}).select("symbol", "seq", "bar", "odd")


QUERIES = {
    "a1_resample_10min": a1_resample("10min"),
    "a1_resample_30min": a1_resample("30min"),
    "a1_resample_4h": a1_resample("4H"),
    "a1_daily_by_brand": daily,
    "a2_resample_right": a2_right,
    "a2_pass_through": a2_pass_through,
    "a3_cascade": a3_cascade,
    "a4_dense_grid": a4_dense,
    "a5_summary": a5_summary,
    "a6_bar_report": a6_bar_report,
    "a6_arrival_disorder": a6_disorder,
    "a7_value_report": lambda s, sf: quality.value_report(daily(s, sf)),
    "a8_density": lambda s, sf: quality.density(bars(s, sf, "4h")),
    "a6_report_of_write": of_write(_raw_quotes, checked_write.bar_report),
    "a7_report_of_write": of_write(daily, checked_write.value_report),
    "a8_report_of_write": of_write(lambda s, sf: bars(s, sf, "4h"), checked_write.density),
    "a9_trend_report": lambda s, sf: quality.trend_report(daily(s, sf)),
    "u1_union": u1_union,
    "u2_dedup_last": u2_dedup,
    "u3_common_times": u3_common,
    "u3_all_times": u3_all,
}

SQL = {
    "a1_resample_10min": a1_sql("10 minutes"),
    "a1_resample_30min": a1_sql("30 minutes"),
    "a1_resample_4h": a1_sql("4 hours"),
    "a1_daily_by_brand": f"WITH {DAILY} SELECT {OHLC}, bar FROM b",
    "a2_resample_right": A2,
    "a2_pass_through": a1_sql("10 minutes"),
    "a3_cascade": A3,
    "a4_dense_grid": A4,
    "a5_summary": A5,
    "a6_bar_report": A6,
    "a6_arrival_disorder": A6B,
    "a7_value_report": A7,
    "a8_density": A8,
    "a6_report_of_write": A6W,
    "a7_report_of_write": A7,
    "a8_report_of_write": A8,
    "a9_trend_report": A9,
    "u1_union": f"""WITH {DAILY}, {ORD} SELECT symbol, count(*) AS n, 0::BIGINT AS n_vol, {r('sum(close)', 's', 2)} FROM b GROUP BY 1
 UNION ALL SELECT symbol, count(*), count(volume), round(sum(close), 2) FROM o0 GROUP BY 1""",
    "u2_dedup_last": """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, round(arg_max(value, event_id), 6) AS score,
 max(event_id) AS seq FROM events GROUP BY 1, 2""",
    "u3_common_times": f"{T1H} INTERSECT {T30}",
    "u3_all_times": f"{T1H} UNION {T30}",
}

QUERIES["p19_null_rows"] = null_rows
SQL["p19_null_rows"] = """WITH t AS (SELECT nullif(event_type, 'view') AS symbol, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, event_id AS seq FROM events)
SELECT symbol, seq, row_number() OVER w - 1 AS bar, sum(seq % 2) OVER w AS odd FROM t WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)
UNION ALL SELECT symbol, seq, NULL, seq % 2 FROM t WHERE ts IS NULL"""
