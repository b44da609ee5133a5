"""Structured Streaming queries over the events and bars; each runs what is available and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import labels as lb
from tickloom.plans import learning as ml
from tickloom.plans.inputs import bars, risk_scores, table
from tickloom.plans.queries.sqlbase import bars_cte, r
from tickloom.plans.queries.signals import TREND, TREND_SQL
from tickloom.session import cut, shared_dir
from tickloom.streaming import bars as sb
from tickloom.streaming import online_fit
from tickloom.streaming.ordered import ordered_signals, rocksdb_state
from tickloom.streaming.stateful import stateful_signals
from tickloom.streaming.upsert import newest_model, refresh_batch, run_upsert
from tickloom.streaming.versions import run_versions

B = bars_cte()
Q, S = {}, {}


def place(spark, name):
    return f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


def tick_stream(s, sf):
    """The events table as a file stream of ticks."""
    schema = table(s, sf, "events").schema
    e = sb.file_stream(s, sf, schema, glob="events.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                    F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def tick_batch(s, sf):
    e = table(s, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                    F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def closed(s, sf, build, name):
    """The bars that the stream emitted, and a closing pass for the windows still open at its end."""
    return sb.with_open_bars(finish(s, build(tick_stream(s, sf)), name), tick_batch(s, sf), build)


def finish(s, stream, name):
    return sb.run_available(stream, place(s, name), place(s, name + "-cp"))


Q["r1_file_stream"] = lambda s, sf: finish(s, tick_stream(s, sf), "r1")
S["r1_file_stream"] = f"SELECT event_type AS symbol, ts, {r('value', 'price')}, 1.0::DOUBLE AS volume, event_id AS seq FROM events"


def r2(s, sf):
    t = tick_stream(s, sf)
    return finish(s, sb.drop_repeats(t.union(tick_stream(s, sf)), ["symbol", "seq"], "40 days"), "r2")


Q["r2_drop_repeats"] = r2
S["r2_drop_repeats"] = S["r1_file_stream"]

OHLC = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
Q["r3_stream_bars"] = lambda s, sf: closed(s, sf, sb.stream_bars, "r3")
S["r3_stream_bars"] = f"WITH {B} SELECT symbol, ts, {OHLC} FROM b"

Q["r4_sliding_bars"] = lambda s, sf: closed(s, sf, lambda t: sb.stream_bars(t, "2 hours", "1 hour"), "r4")
S["r4_sliding_bars"] = f"""WITH x AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS w, value, ts AS t, event_id FROM events, (VALUES (0), (1)) v(k)),
b AS (SELECT symbol, w AS ts, arg_min(value, (t, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (t, event_id)) AS close, count(*)::DOUBLE AS volume FROM x GROUP BY 1, 2)
SELECT symbol, ts, {OHLC} FROM b"""

Q["r4_session_bars"] = lambda s, sf: closed(s, sf, lambda t: sb.session_bars(t, "45 minutes"), "r4s")
S["r4_session_bars"] = f"""WITH x AS (SELECT event_type AS symbol, ts, value, event_id, (ts > lag(ts) OVER w + INTERVAL '45 minutes')::INT AS brk FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
y AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS k FROM x),
b AS (SELECT symbol, min(ts) AS ts0, max(ts) + INTERVAL '45 minutes' AS end_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
 count(*)::DOUBLE AS volume, count(*) AS n_ticks FROM y GROUP BY symbol, k)
SELECT symbol, ts0 AS ts, end_ts, {OHLC}, n_ticks FROM b"""


def r5(s, sf):
    hour = tick_stream(s, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return run_upsert(hour, place(s, "r5"), place(s, "r5-cp")).select("symbol", "ts", "price", "seq")


Q["r5_upsert_newest"] = r5
S["r5_upsert_newest"] = f"SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, {r('arg_max(value, event_id)', 'price')}, max(event_id) AS seq FROM events GROUP BY 1, 2"


def in_two_arrivals(s, sf, build, name):
    """Land the earlier half of the bars, run, land the later half, run again on the same checkpoint."""
    landing, out, cp = place(s, "landing"), place(s, name), place(s, name + "-cp")
    d = cut(bars(s, sf).drop("bar"))
    edges = d.agg(F.min("ts"), F.max("ts")).first()
    mid = edges[0] + (edges[1] - edges[0]) / 2
    for half in (F.col("ts") < mid, F.col("ts") >= mid):
        d.filter(half).write.mode("append").parquet(landing)
        result = sb.run_available(build(sb.file_stream(s, landing, d.schema)), out, cp)
    return result


def r5_versions(s, sf):
    hour = tick_stream(s, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return run_versions(hour, place(s, "r5v"), place(s, "r5v-cp")).select("symbol", "ts", "price", "seq")


Q["r5_versioned_upsert"] = r5_versions
S["r5_versioned_upsert"] = S["r5_upsert_newest"]


def r6_ordered(s, sf):
    """All bars in an order that has nothing to do with time, then a heartbeat that moves the watermark past them."""
    landing, out, cp = place(s, "landing"), place(s, "r6o"), place(s, "r6o-cp")
    d = cut(bars(s, sf).drop("bar"))
    last = d.agg(F.max("ts").alias("ts"))
    build = lambda: ordered_signals(sb.file_stream(s, landing, d.schema), "60 days", TREND)
    d.repartition(3, F.xxhash64("symbol", "ts")).write.parquet(landing)
    with rocksdb_state(s):
        sb.run_available(build(), out, cp)
        beat = last.select(F.lit("(heartbeat)").alias("symbol"), (F.col("ts") + F.expr("interval 61 days")).alias("ts"),
                           *[F.lit(1.0).alias(c) for c in d.columns if c not in ("symbol", "ts")])
        beat.select(*d.columns).write.mode("append").parquet(landing)
        result = sb.run_available(build(), out, cp)
    return result.filter("symbol <> '(heartbeat)'")


Q["r6_ordered_signals"] = lambda s, sf: r6_ordered(s, sf).select("symbol", "ts", "raw_dir", "signal", "late")
Q["r6_stateful_signals"] = lambda s, sf: in_two_arrivals(s, sf, lambda b: stateful_signals(b, TREND), "r6").select("symbol", "ts", "raw_dir", "signal", "late")
S["r6_stateful_signals"] = f"""WITH RECURSIVE {B}, {TREND_SQL} SELECT b.symbol, b.ts, tr.raw_dir, td.dir AS signal, false AS late FROM b JOIN tr USING (symbol, bar) JOIN td USING (symbol, bar)"""
S["r6_ordered_signals"] = S["r6_stateful_signals"]

Q["r7_drawdown_alert"] = lambda s, sf: in_two_arrivals(s, sf, lambda b: stateful_signals(b, TREND, limit=0.9), "r7").select("symbol", "ts", "peak", "drawdown", "alert")
S["r7_drawdown_alert"] = f"""WITH {B}, x AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY bar) AS pk FROM b)
SELECT symbol, ts, {r('pk', 'peak')}, {r('close / pk - 1', 'drawdown')}, close / pk - 1 < -0.9 AS alert FROM x"""


def r8(s, sf):
    """Refit on labelled bars as they arrive, then score the bar stream with the newest model."""
    feats = ["ret_3", "ret_12", "rsi_14", "zscore_24"]
    d = cut(lb.add_labels(X.basic_pack(bars(s, sf)), 3).withColumn("label", F.col("y_up").cast("double")).filter("label is not null")
            .select("symbol", "ts", *feats, "label"))
    land, tab, models = place(s, "r8-land"), place(s, "r8-rows"), place(s, "r8-models")
    d.write.parquet(land)
    stream = lambda: sb.file_stream(s, land, d.schema, files_per_batch=1)
    fit = lambda rows: ml.pipeline(feats, "logistic").fit(rows.select(*feats, "label"))
    q = stream().writeStream.foreachBatch(refresh_batch(tab, models, fit)).option("checkpointLocation", place(s, "r8-cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    model = newest_model(s, models)
    return finish(s, ml.probability(model, stream(), "p").select("symbol", "ts", "p"), "r8")


Q["r8_model_refresh"] = r8


def r8_online(s, sf):
    """Learn labelled bars batch by batch, each read once, then score the bar stream with what was learned."""
    feats = ["ret_3", "ret_12", "rsi_14", "zscore_24"]
    d = lb.add_labels(X.basic_pack(bars(s, sf)), 3).withColumn("label", F.col("y_up").cast("double")).filter("label is not null")
    land, models = place(s, "r8o-land"), place(s, "r8o-models")
    d.select("symbol", "ts", *feats, "label").write.parquet(land)
    stream = lambda: sb.file_stream(s, land, s.read.parquet(land).schema, files_per_batch=1)
    q = stream().writeStream.foreachBatch(online_fit.learn_batch(models, feats)).option("checkpointLocation", place(s, "r8o-cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    return finish(s, online_fit.probability(online_fit.newest(s, models), stream()).select("symbol", "ts", "p"), "r8o")


Q["r8_online_refresh"] = r8_online


def r9(s, sf):
    day = risk_scores(s, sf).select(F.dayofmonth("ts").alias("dom"), "risk_score").groupBy("dom").agg(F.avg("risk_score").alias("risk"))
    t = tick_stream(s, sf).withColumn("dom", F.dayofmonth("ts"))
    return finish(s, sb.with_static(t, day.filter("dom % 2 = 0"), ["dom"], {"risk": 1.0}).select("symbol", "seq", "risk"), "r9")


Q["r9_static_join"] = r9
S["r9_static_join"] = f"""WITH d AS (SELECT o_orderdate AS ts, avg((o_orderstatus = 'F')::INT) AS rs FROM orders GROUP BY 1), m AS (SELECT day(ts) AS dom, avg(rs) AS risk FROM d GROUP BY 1)
SELECT event_type AS symbol, event_id AS seq, {r('coalesce(risk, 1.0)', 'risk')} FROM events LEFT JOIN m ON day(events.ts) = dom AND dom % 2 = 0"""

QUERIES, SQL = Q, S
