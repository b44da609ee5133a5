"""Minimum gap between signal changes.

After a change at bar i the next one may happen at bar i+gap at the earliest, so
the signal depends on everything before it.  What a block of bars does to the
state (direction, bars still to wait) is a small map, though: it is worked out for
every possible entry state, the maps of 256 blocks are composed into one, these are
chained (one row per two million bars), and each block then runs once with its true
entry state.  No list holds more than 256 blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, join_safe
from tickloom.session import cut

SIGNAL_BLOCK = 8192
FAN = 256


def _step(state: Column, run: Column, gap: Column) -> Column:
    """State after a run (beg, end, dir) of equal raw direction."""
    at = F.greatest(run["beg"], state["free"])
    flips = (run["dir"] != state["dir"]) & (at <= run["end"])
    return F.struct(
        F.when(flips, run["dir"]).otherwise(state["dir"]).alias("dir"),
        F.when(flips, at + gap).otherwise(state["free"]).alias("free"),
    )


def debounce(df: DataFrame, gap: int | str, raw: str = "raw_dir", out: str = "signal", keys: Sequence[str] = KEYS,
             size: int = SIGNAL_BLOCK) -> DataFrame:
    """Add ``out``: the raw direction with at least ``gap`` bars between changes.

    Needs the position ``bar``; null raw directions count as 0.  ``gap`` is a number
    or the name of a column that is constant per key (parameter sweeps).
    """
    return debounce_many(df, {out: (raw, gap)}, keys, size)


def debounce_many(df: DataFrame, signals: Mapping[str, tuple[str, int | str]], keys: Sequence[str] = KEYS,
                  size: int = SIGNAL_BLOCK) -> DataFrame:
    """Several held signals, ``{out: (raw, gap)}``, in one pass over the bars."""
    keys = list(keys)
    plain = {o: r for o, (r, g) in signals.items() if isinstance(g, int) and g <= 1}
    held = {o: rg for o, rg in signals.items() if o not in plain}
    df = df.withColumns({o: F.coalesce(F.col(r), F.lit(0)).cast("int") for o, r in plain.items()}) if plain else df
    if not held:
        return df
    blk, sid = [*keys, "_blk"], [*keys, "_sid", "_blk"]
    d = df.withColumn("_blk", F.floor(F.col("bar") / size).cast("long"))

    # runs of equal raw direction inside a block, per signal; rows without a position take no part
    def entry(i: int, raw: str, gap: int | str) -> Column:
        wait = F.greatest(F.col(gap), F.lit(1)).cast("int") if isinstance(gap, str) else F.lit(gap)
        return F.struct(F.lit(i).alias("sid"), F.coalesce(F.col(raw), F.lit(0)).cast("int").alias("dir"), wait.alias("gap"))

    w = Window.partitionBy(*blk).orderBy("bar")
    now = [entry(i, raw, gap) for i, (raw, gap) in enumerate(held.values())]
    r = d.filter(F.col("bar").isNotNull()).select(*blk, "bar", F.array(*now).alias("_now"))
    r = r.withColumns({"_old": F.lag("_now").over(w), "_last": F.max("bar").over(Window.partitionBy(*blk))})
    changed = F.filter("_now", lambda x: F.col("_old").isNull() | (F.get("_old", x["sid"])["dir"] != x["dir"]))
    r = r.select(*blk, "bar", "_last", F.explode(changed).alias("x"))
    r = r.select(*blk, "bar", "_last", F.col("x.sid").alias("_sid"), F.col("x.dir").alias("dir"), F.col("x.gap").alias("gap"))
    nxt = F.lead("bar").over(Window.partitionBy(*sid).orderBy("bar"))
    r = r.withColumn("end", F.coalesce(nxt - 1, F.col("_last")))
    runs = r.groupBy(*sid).agg(
        F.sort_array(F.collect_list(F.struct(F.col("bar").alias("beg"), "end", "dir"))).alias("runs"),
        F.first("gap").alias("gap"),
    )
    runs = cut(runs)  # read twice: once for the maps, once for the final run
    entries = _block_entries(runs, [*keys, "_sid"], size)
    g = F.col("gap")
    start = F.struct(F.col("e_dir").alias("dir"), (F.col("e_wait") + F.col("_blk") * size).alias("free"),
                     F.array().cast("array<struct<bar:bigint,dir:int>>").alias("flips"))

    def play(acc: Column, run: Column) -> Column:
        after = _step(acc, run, g)
        flip = F.struct((after["free"] - g).alias("bar"), after["dir"].alias("dir"))
        more = F.when(after["dir"] != acc["dir"], F.array_append(acc["flips"], flip)).otherwise(acc["flips"])
        return F.struct(after["dir"].alias("dir"), after["free"].alias("free"), more.alias("flips"))

    flips = F.aggregate("runs", start, play)["flips"]
    # the entry direction holds from the first bar of the block unless that bar changes it
    first = F.struct((F.col("_blk") * size).alias("bar"), F.col("e_dir").alias("dir"))
    flips = F.when(F.get(flips, 0)["bar"] == F.col("_blk") * size, flips).otherwise(F.array_prepend(flips, first))
    marks = join_safe(runs, entries, sid).select(*sid, F.explode(flips).alias("f"))
    marks = marks.groupBy(*blk, F.col("f.bar").alias("bar")).agg(
        *[F.max(F.when(F.col("_sid") == i, F.col("f.dir"))).alias(f"_m_{o}") for i, o in enumerate(held)]
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    full = join_safe(d, marks, [*blk, "bar"])
    full = full.withColumns({o: F.last(f"_m_{o}", ignorenulls=True).over(upto) for o in held})
    return full.drop("_blk", *[f"_m_{o}" for o in held])


def _block_entries(runs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """State (e_dir, e_wait) with which every block is entered."""
    blk = [*keys, "_blk"]
    gap = F.col("gap")
    base = F.col("_blk") * size
    states = F.flatten(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)),
        lambda d: F.transform(F.sequence(F.lit(0), gap - 1),
                              lambda k: F.struct(d.alias("dir"), (base + k).alias("free"))),
    ))

    def advance(acc: Column, run: Column) -> Column:
        nxt = F.transform(acc, lambda s: _step(s, run, gap))
        # a run this long ends in the same state whatever came before
        return F.when(run["end"] - run["beg"] + 1 >= 2 * gap - 1, F.slice(nxt, 1, 1)).otherwise(nxt)

    ends = F.aggregate("runs", states, advance)
    after = base + size
    rel = F.transform(ends, lambda s: F.struct(s["dir"].alias("dir"), F.greatest(s["free"] - after, F.lit(0)).cast("int").alias("wait")))
    maps = runs.select(*blk, "gap", rel.alias("m")).withColumn(
        "m", F.when(F.size(F.array_distinct("m")) == 1, F.slice("m", 1, 1)).otherwise(F.col("m"))
    )
    # blocks fold into super-blocks of FAN; only those are chained, and each is then followed from its entry
    top = [*keys, "_sup"]
    sup = maps.withColumn("_sup", F.floor(F.col("_blk") / FAN)).groupBy(*top).agg(
        F.sort_array(F.collect_list(F.struct("_blk", "m"))).alias("bs"), F.first("gap").alias("gap"))
    every = F.flatten(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)),
        lambda d: F.transform(F.sequence(F.lit(0), gap - 1), lambda k: F.struct(d.alias("dir"), k.cast("int").alias("wait")))))
    whole = F.aggregate("bs", every, lambda acc, b: F.transform(acc, lambda s: _lookup(b["m"], s, gap)))
    sup = sup.withColumn("m", whole).withColumn(
        "m", F.when(F.size(F.array_distinct("m")) == 1, F.slice("m", 1, 1)).otherwise(F.col("m")))
    entries = _chain(sup.select(*top, "gap", "m"), keys)
    met = join_safe(sup.select(*top, "gap", "bs"), entries, top, "inner")
    start = F.struct(F.col("e_dir").alias("dir"), F.col("e_wait").alias("wait"))
    return met.select(*keys, F.explode(_follow("bs", start, gap, "_blk")).alias("x")).select(*keys, "x.*")


def _lookup(m: Column, state: Column, gap: Column) -> Column:
    """The state after a block with map ``m``; entry states are ordered by direction, then wait."""
    # element_at counts from 1
    i = F.when(F.size(m) == 1, 1).otherwise((state["dir"] + 1) * gap + state["wait"] + 1)
    return F.element_at(m, i.cast("int"))


def _follow(blocks: str, start: Column, gap: Column, name: str) -> Column:
    """The entry state of every block of an ascending list."""
    def step(acc: Column, b: Column) -> Column:
        s = acc["s"]
        here = F.struct(b[name].alias(name), s["dir"].alias("e_dir"), s["wait"].alias("e_wait"))
        return F.struct(_lookup(b["m"], s, gap).alias("s"), F.array_append(acc["o"], here).alias("o"))

    init = F.struct(start.alias("s"), F.array().cast(f"array<struct<{name}:bigint,e_dir:int,e_wait:int>>").alias("o"))
    return F.aggregate(blocks, init, step)["o"]


def _chain(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Entry states of super-blocks: one after a constant map knows its own, others follow from the last known one."""
    w = Window.partitionBy(*keys).orderBy("_sup")
    maps = maps.withColumn("_p", F.lag("m").over(w))
    known = F.col("_p").isNull() | (F.size("_p") == 1)
    maps = maps.withColumn("_seg", F.sum(known.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seed = F.struct(F.lit(0).alias("dir"), F.lit(0).alias("wait"))
    chain = maps.groupBy(*keys, "_seg").agg(
        F.sort_array(F.collect_list(F.struct("_sup", "m"))).alias("bs"),
        F.min_by(F.coalesce(F.col("_p")[0], seed), "_sup").alias("s0"), F.first("gap").alias("gap"),
    )
    return chain.select(*keys, F.explode(_follow("bs", F.col("s0"), F.col("gap"), "_sup")).alias("x")).select(*keys, "x.*")
