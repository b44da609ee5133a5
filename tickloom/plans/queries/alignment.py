"""Joins, time alignment, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import timeparse as tp
from tickloom.operators import asof
from tickloom.operators import labels as lb
from tickloom.operators import quality
from tickloom.operators import relations as rel
from tickloom.operators.resample import resample
from tickloom.plans.inputs import bars, event_signals, price_probability, table, ticks, trades
from tickloom.plans.queries.sqlbase import bars_cte, r
from tickloom.session import shared_dir
from tickloom.sources import files, sinks

B = bars_cte()
Q, S = {}, {}


def scratch(spark, name):
    return f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


def j1(s, sf):
    sig = table(s, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderstatus") == "O", "BUY").otherwise("SELL").alias("side"),
        (F.col("o_totalprice") / 1e6).alias("signal_conf"), F.col("o_orderkey").alias("seq"))
    return rel.match_trades(trades(s, sf), sig, ["signal_conf"], ["seq"]).select("trade_no", "symbol", "ts", "side", "signal_conf")


Q["j1_match_trades"] = j1
S["j1_match_trades"] = f"""WITH g AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, arg_min(o_totalprice / 1e6, o_orderkey) AS c FROM orders GROUP BY 1, 2, 3),
t AS (SELECT o_orderkey AS trade_no, o_orderpriority AS symbol, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side FROM orders)
SELECT trade_no, symbol, ts, side, {r('c', 'signal_conf')} FROM t LEFT JOIN g USING (symbol, ts, side)"""


def j2(s, sf):
    left = event_signals(s, sf).select("symbol", "ts", "seq")
    right = resample(ticks(s, sf), "4h", order=["ts", "seq"], price="price").select("symbol", "ts", F.col("close").alias("risk"))
    right = right.filter(F.hour("ts") >= 8)
    return asof.asof_backward(left, right, ["risk"], width_s=86400, defaults={"risk": 1.0})


Q["j2_asof_backward"] = j2
S["j2_asof_backward"] = f"""WITH {bars_cte('4 hours')}, q AS (SELECT symbol, ts, close FROM b WHERE hour(ts) >= 8)
SELECT e.event_type AS symbol, e.ts, e.event_id AS seq, q.ts AS match_ts, {r('coalesce(q.close, 1.0)', 'risk')} FROM events e ASOF LEFT JOIN q ON e.event_type = q.symbol AND e.ts >= q.ts"""


def j3(s, sf):
    left = event_signals(s, sf).select("symbol", "ts", "seq", "side")
    right = bars(s, sf, "1h").select("symbol", "ts", "bar", "close")
    return asof.asof_forward(left, right, ["bar", "close"], width_s=6 * 3600)


Q["j3_asof_forward"] = j3
S["j3_asof_forward"] = f"""WITH {bars_cte('1 hour')} SELECT e.event_type AS symbol, e.ts, e.event_id AS seq, sign(e.value - 50)::INT AS side, b.ts AS match_ts, b.bar, {r('b.close', 'close')}
FROM events e ASOF LEFT JOIN b ON e.event_type = b.symbol AND e.ts <= b.ts"""


def j4(s, sf):
    f = bars(s, sf).select("symbol", "ts", "close")
    y = lb.add_direction(bars(s, sf), 3).filter("y_dir is not null").select("symbol", "ts", "y_dir")
    return lb.align(f, y)


Q["j4_align_labels"] = j4
S["j4_align_labels"] = f"WITH {B}, y AS (SELECT *, sign(lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar) - close)::INT AS y_dir FROM b) SELECT symbol, ts, {r('close', 'close')}, y_dir FROM y WHERE y_dir IS NOT NULL"

Q["j5_union_axis"] = lambda s, sf: asof.union_axis(bars(s, sf, "1h").select("symbol", "ts", "close"), ["close"], width_s=86400).drop("match_ts")
S["j5_union_axis"] = f"""WITH {bars_cte('1 hour')}, a AS (SELECT t.ts, s.symbol FROM (SELECT DISTINCT ts FROM b) t, (SELECT DISTINCT symbol FROM b) s)
SELECT a.symbol, a.ts, {r('b.close', 'close')} FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts >= b.ts"""


def j6(s, sf):
    g = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a in (100.0, 150.0) for b in (250.0, 300.0, 350.0)]))
    d = bars(s, sf).withColumn("g", g)
    return d.groupBy("symbol", "g.lo", "g.hi").agg(F.count_if(F.col("close") > F.col("g.hi")).alias("n_hi"), F.count_if(F.col("close") < F.col("g.lo")).alias("n_lo"))


Q["j6_parameter_grid"] = j6
S["j6_parameter_grid"] = f"""WITH {B}, l(lo) AS (VALUES (100.0::DOUBLE), (150.0::DOUBLE)), h(hi) AS (VALUES (250.0::DOUBLE), (300.0::DOUBLE), (350.0::DOUBLE))
SELECT symbol, lo, hi, count_if(close > hi) AS n_hi, count_if(close < lo) AS n_lo FROM b, l, h GROUP BY ALL"""


def universe_parts(s, sf):
    p = table(s, sf, "part").select(F.col("p_partkey").cast("string").alias("symbol"))
    sold = table(s, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("symbol"))
    return sold, p


Q["j8_with_data"] = lambda s, sf: rel.with_data(*universe_parts(s, sf))
S["j8_with_data"] = "SELECT p_partkey::VARCHAR AS symbol FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"
Q["j8_without_data"] = lambda s, sf: rel.without_data(*universe_parts(s, sf))
S["j8_without_data"] = "SELECT p_partkey::VARCHAR AS symbol FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"

Q["a19_average_per_time"] = lambda s, sf: rel.average_per_time(bars(s, sf), ["close", "volume"])
S["a19_average_per_time"] = f"WITH {B} SELECT ts, {r('avg(close)', 'close')}, {r('avg(volume)', 'volume')}, count(*) AS n_symbols FROM b GROUP BY ts"

PIVOTED = ["click", "error", "purchase", "view"]  # the other symbols are counted
Q["a20_pivot_symbols"] = lambda s, sf: rel.pivot_symbols(bars(s, sf).withColumn("side", F.signum(F.col("close") - F.col("open")).cast("int")), PIVOTED)
S["a20_pivot_symbols"] = f"WITH {B} SELECT ts, {', '.join(f'''coalesce(max(CASE WHEN symbol = '{e}' THEN sign(close - open)::INT END), 0) AS {e}''' for e in PIVOTED)}, count_if(symbol NOT IN ({', '.join(repr(e) for e in PIVOTED)})) AS n_other FROM b GROUP BY ts"

# prediction reports
PB = "pb AS (SELECT *, close / (close + open) AS p FROM b)"


def with_p(s, sf):
    return bars(s, sf).withColumn("p", price_probability())


Q["a18_prediction_stats"] = lambda s, sf: quality.prediction_stats(with_p(s, sf))
S["a18_prediction_stats"] = f"""WITH {B}, {PB} SELECT symbol, count(p) AS n, {r('min(p)', 'min_p')}, {r('max(p)', 'max_p')}, {r('avg(p)', 'mean_p')}, {r('stddev_samp(p)', 'std_p')},
 {', '.join(f'count_if(p >= {t / 100}) AS ge_{t}' for t in (50, 55, 60, 65, 70))} FROM pb GROUP BY 1"""
Q["a18_prediction_histogram"] = lambda s, sf: quality.prediction_histogram(with_p(s, sf))
S["a18_prediction_histogram"] = f"WITH {B}, {PB} SELECT symbol, (CASE WHEN p <= 0 THEN 0 ELSE least(ceil(p * 10) - 1, 9) END)::INT AS bin, count(*) AS n FROM pb GROUP BY 1, 2"
Q["a26_feature_distribution"] = lambda s, sf: quality.feature_distribution(
    with_p(s, sf).withColumns({"inv": F.try_divide(F.lit(1.0), F.col("close") - F.col("open")), "inf": F.when(F.col("bar") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("close"))}),
    ["close", "inv", "inf"])
S["a26_feature_distribution"] = f"""WITH {B}, x AS (SELECT symbol, 'close' AS feature, close AS x FROM b UNION ALL SELECT symbol, 'inv', 1 / nullif(close - open, 0) FROM b
 UNION ALL SELECT symbol, 'inf', CASE WHEN bar % 10 = 0 THEN 'infinity'::DOUBLE ELSE close END FROM b)
SELECT symbol, feature, count(*) AS n_rows, count_if(x IS NULL) AS n_null, count_if(isinf(x)) AS n_inf, {r('min(x) FILTER (NOT isinf(x))', 'min_x')}, {r('max(x) FILTER (NOT isinf(x))', 'max_x')},
 {r('avg(x) FILTER (NOT isinf(x))', 'mean_x')} FROM x GROUP BY 1, 2"""
Q["a26_confidence_share"] = lambda s, sf: quality.high_confidence_share(with_p(s, sf))
S["a26_confidence_share"] = f"WITH {B}, {PB} SELECT symbol, count(p) AS n, {r('avg((p > 0.6)::INT)', 'above_60')}, {r('avg((p > 0.7)::INT)', 'above_70')} FROM pb GROUP BY 1"

# sources: the tables are written in the layout to be read, then read back
OHLC = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
BAR6 = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def s1(s, sf):
    path = scratch(s, "csv")
    sinks.write_bars(bars(s, sf).select(*BAR6).withColumn("file", F.concat("symbol", F.lit(".csv"))).drop("symbol"), path, "csv", by=["file"])
    raw = s.read.option("header", True).csv(path)
    raw = raw.select(*[c for c in raw.columns if c != "file"], files.symbol_from_path(r"file=([^/]+)\.csv/").alias("symbol"))
    return files.normalize_bars(raw)


Q["s1_csv_folder"] = s1
S["s1_csv_folder"] = f"WITH {B} SELECT symbol, ts, {OHLC} FROM b"


def s2(s, sf):
    done = bars(s, sf, "1h").filter(F.col("symbol").isin("click", "view")).select(*BAR6)
    return rel.prefer(done, bars(s, sf, "30min").select(*BAR6)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


Q["s2_processed_or_raw"] = s2
S["s2_processed_or_raw"] = f"""SELECT event_type AS symbol, count(DISTINCT time_bucket(CASE WHEN event_type IN ('click', 'view') THEN INTERVAL '1 hour' ELSE INTERVAL '30 minutes' END, ts)) AS n FROM events GROUP BY 1"""


def s3(s, sf):
    e = table(s, sf, "events")
    odd = e.select(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Candle_Begin_Time"),
                   F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Last"),
                   F.when(F.col("event_id") % 4 > 0, F.col("user_id").cast("string")).alias("Qty"), F.col("event_id").alias("id"))
    return files.normalize_bars(odd).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("sum_close"), F.sum("volume").alias("sum_volume"), F.min("ts").alias("first_ts"), F.round(F.sum("high"), 2).alias("sum_high"))


Q["s3_normalize_bars"] = s3
S["s3_normalize_bars"] = f"""SELECT event_type AS symbol, count(*) AS n, {r('sum(value)', 'sum_close', 2)}, sum(CASE WHEN event_id % 4 > 0 THEN user_id ELSE 0 END)::DOUBLE AS sum_volume, date_trunc('second', min(ts)) AS first_ts, {r('sum(value)', 'sum_high', 2)}
FROM events WHERE event_id % 11 <> 0 GROUP BY 1"""


def s4(s, sf):
    e = table(s, sf, "events")
    odd = e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("TradeDate"),
                   F.regexp_replace(F.date_format("ts", "HH:mm:ss"), "^0", "").alias("SysTime"), F.col("value").alias("price"))
    return tp.resolve_time(odd).select("id", "ts")


Q["s4_time_resolution"] = s4
S["s4_time_resolution"] = "SELECT event_id AS id, date_trunc('second', ts) AS ts FROM events"


def s5(s, sf):
    e = table(s, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    num = F.when(F.col("event_id") % 2 == 0, F.unix_millis("t")).otherwise(F.unix_seconds("t"))
    return e.select(F.col("event_id").alias("id"), tp.parse_epoch(num).alias("ts"))


Q["s5_epoch_magnitude"] = s5
S["s5_epoch_magnitude"] = "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS ts FROM events"


def s6(s, sf):
    path = scratch(s, "cp1251")
    p = table(s, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("акция "), F.col("p_brand")).alias("name"))
    files.allow_encoding(s, "windows-1251")
    p.write.option("header", True).option("encoding", "windows-1251").csv(path)
    d = files.read_bar_csv(s, path, encoding="windows-1251", pattern=r"(part-\d)")
    return d.select(F.col("id").cast("long").alias("id"), "name")


Q["s6_encoding"] = s6
S["s6_encoding"] = "SELECT p_partkey AS id, 'акция ' || p_brand AS name FROM part"


def payloads(s, sf):
    """Exchange-style pages of at most 500 candles with localised numbers."""
    num = lambda c: F.regexp_replace(F.format_number(c, 2), "[.]", "#")
    loc = lambda c: F.regexp_replace(F.regexp_replace(num(c), ",", " "), "#", ",")
    b = bars(s, sf).withColumn("page", F.floor(F.col("bar") / 500))
    row = F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), loc("open"), loc("close"), loc("high"), loc("low"), F.col("volume").cast("string"))
    pages = b.groupBy("symbol", "page").agg(F.sort_array(F.collect_list(row)).alias("data"))
    names = F.array(*[F.lit(c) for c in ("begin", "open", "close", "high", "low", "volume")])
    return pages.select("symbol", "page", F.to_json(F.struct(F.struct(names.alias("columns"), F.col("data")).alias("candles"))).alias("value"))


def s7(s, sf):
    path = scratch(s, "candles")
    payloads(s, sf).select("symbol", "value").write.partitionBy("symbol").text(path)
    return files.parse_candles(s.read.text(path).select("value", "symbol")).drop("pos")


Q["s7_candle_payloads"] = s7
S["s7_candle_payloads"] = f"WITH {B} SELECT symbol, ts, {OHLC} FROM b"


def boards(s, sf):
    t = ticks(s, sf)
    e = lambda k: resample(t.filter(F.col("seq") % 3 == k), "1h", order=["ts", "seq"], price="price").withColumn("page", F.floor(F.hour("ts") / 12))
    return [e(0), e(1), e(2)]


def board_sql(pick):
    return f"""WITH q AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, event_id % 3 AS brd, arg_max(value, (events.ts, event_id)) AS close FROM events GROUP BY 1, 2, 3)
SELECT symbol, ts, {r(f'{pick}(close, brd)', 'close')} FROM q GROUP BY symbol, ts"""


Q["s8_board_merge_first"] = lambda s, sf: rel.merge_sources(boards(s, sf), keep="first", page="page").select("symbol", "ts", "close")
S["s8_board_merge_first"] = board_sql("arg_min")
Q["s8_page_merge_last"] = lambda s, sf: rel.merge_sources(boards(s, sf), keep="last", page="page").select("symbol", "ts", "close")
S["s8_page_merge_last"] = board_sql("arg_max")


def s9(s, sf):
    old = bars(s, sf, "1h").filter(F.col("ts") < "2024-01-20").select(*BAR6)
    new = resample(ticks(s, sf).filter(F.col("seq") % 2 == 0), "1h", order=["ts", "seq"], price="price").filter(F.col("ts") >= "2024-01-15")
    return files.merge_append(old, new)


Q["s9_merge_append"] = s9
S["s9_merge_append"] = f"""WITH {bars_cte('1 hour')}, n AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (events.ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
u AS (SELECT symbol, ts, open, high, low, close, volume FROM n WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM b WHERE ts < TIMESTAMP '2024-01-20'
 AND (symbol, ts) NOT IN (SELECT (symbol, ts) FROM n WHERE ts >= TIMESTAMP '2024-01-15'))
SELECT symbol, ts, {OHLC} FROM u"""


def s9_thirds(s, sf):
    """Old bars of every second tick up to two thirds of the table's time, new ones of all ticks from one third on."""
    t = ticks(s, sf)
    e = t.agg(F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi"))
    e = e.selectExpr("lo + (hi - lo) div 3 AS a", "lo + 2 * (hi - lo) div 3 AS z")
    at = F.unix_seconds("ts")
    old = resample(t.filter(F.col("seq") % 2 == 0), "1h", order=["ts", "seq"], price="price").crossJoin(e).filter(at < F.col("z")).drop("a", "z")
    new = resample(t, "1h", order=["ts", "seq"], price="price").crossJoin(e).filter(at >= F.col("a")).drop("a", "z")
    return files.merge_append(old, new).select(*BAR6)


Q["s9_merge_append_thirds"] = s9_thirds
S["s9_merge_append_thirds"] = f"""WITH e0 AS (SELECT floor(epoch(min(ts)))::BIGINT AS lo, floor(epoch(max(ts)))::BIGINT AS hi FROM events), e AS (SELECT lo + (hi - lo) // 3 AS a, lo + 2 * (hi - lo) // 3 AS z FROM e0),
k AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (events.ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2),
h AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (events.ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
n AS (SELECT k.* FROM k, e WHERE epoch(ts) >= a),
u AS (SELECT * FROM n UNION ALL SELECT h.* FROM h, e WHERE epoch(ts) < z AND (symbol, ts) NOT IN (SELECT (symbol, ts) FROM n))
SELECT symbol, ts, {OHLC} FROM u"""


def s10(s, sf):
    path = scratch(s, "parquet")
    d = bars(s, sf).select(*BAR6)
    d.withColumn("file", F.concat("symbol", F.lit("_1m_2024.parquet"))).drop("symbol").write.partitionBy("file").parquet(path)
    return files.read_bar_parquet(s, f"{path}/file=*", pattern=r"file=([^/_]+)_[^/]*\.parquet").drop("file")


Q["s10_parquet_glob"] = s10
S["s10_parquet_glob"] = S["s1_csv_folder"]

Q["s11_universe"] = lambda s, sf: files.in_universe(bars(s, sf), ["click", "signup"]).select("symbol", "bar", "close")
S["s11_universe"] = f"WITH {B} SELECT symbol, bar, {r('close', 'close')} FROM b WHERE symbol IN ('click', 'signup')"


def s12(s, sf):
    path = scratch(s, "bars")
    d = bars(s, sf, "1h").select(*BAR6).withColumn("interval", F.lit("1h"))
    sinks.write_bars(d.unionByName(bars(s, sf, "4h").select(*BAR6).withColumn("interval", F.lit("4h"))), path)
    return s.read.parquet(path).select("interval", *BAR6)


Q["s12_partitioned_sink"] = s12
S["s12_partitioned_sink"] = f"""SELECT '1h' AS interval, * FROM (WITH {bars_cte('1 hour')} SELECT symbol, ts, {OHLC} FROM b) UNION ALL
SELECT '4h', * FROM (WITH {bars_cte('4 hours')} SELECT symbol, ts, {OHLC} FROM b)"""


def s12b(s, sf):
    path = scratch(s, "report")
    sinks.write_report(quality.density(bars(s, sf, "4h")), path)
    return s.read.schema("symbol string, n_rows long, days int, bars_per_day double, low_density boolean").json(path)


Q["s12_report_json"] = s12b
S["s12_report_json"] = f"""WITH {bars_cte('4 hours')}, d AS (SELECT symbol, count(*) AS n_rows, date_diff('day', min(ts), max(ts)) AS days FROM b GROUP BY 1)
SELECT symbol, n_rows, days::INT AS days, {r('n_rows / greatest(days, 1)', 'bars_per_day')}, n_rows / greatest(days, 1) < 20 AS low_density FROM d"""


def s12c(s, sf):
    from tickloom.plans.queries.trading import d20_base
    from tickloom.plans.sweep import best_configs, nested_top

    best = best_configs(d20_base(s, sf).withColumn("score", F.round("score", 3)), 2)
    return nested_top(best.withColumn("score", F.col("score").cast("decimal(18,3)")))


Q["s12_nested_top_json"] = s12c


def calendar(s, sf):
    o = table(s, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count(F.lit(1)).alias("n"))
    m = per.select("o_custkey", F.explode(tp.month_ranges(F.col("a"), F.col("b"))).alias("m"))
    return m.select("o_custkey", "m.first", "m.last", tp.last_business_day(F.col("m.last")).alias("business"))


Q["f_calendar_ranges"] = calendar
S["f_calendar_ranges"] = """WITH p AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
m AS (SELECT o_custkey, a, b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM p),
x AS (SELECT o_custkey, greatest(m, a) AS first, least(last_day(m), b) AS last FROM m)
SELECT o_custkey, first, last, CASE dayofweek(last) WHEN 0 THEN last - 2 WHEN 6 THEN last - 1 ELSE last END::DATE AS business FROM x"""

QUERIES, SQL = Q, S
