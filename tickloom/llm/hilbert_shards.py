"""Shards along a Hilbert curve through several metadata dimensions, for pruning files by any of them.

1. ``fit``: each dimension is quantised into ``2^bits`` cells of about equal rows. The distinct values are
   counted (map-side combined), put in order by ranges and numbered through the ranges' sums; a value's cell is
   its rows before it x cells / rows. Only the lowest value of each cell comes to the driver (dimensions x cells).
2. ``curve``: the cell numbers become an index along the curve, one table lookup per bit level
   (orientation, corner) -> (digit, next orientation). The table follows from the Gray code.
3. ``assign``: rows are numbered in the order (index, hash of the row, row) and the run is cut into shards. Equal rows are
   one row with a count until the very end. Offsets come from counts per (index, part of the hash), so no task numbers
   more than a 256th of a cell; blocks of a row's copies are spread again before they become rows.
   Laws: ``rows`` (numbers of rows differ by one at most) or ``bytes`` (a row goes where its middle byte falls).
4. ``write``: full rows are routed by the shards' first keys, a literal of one entry per shard, and written once;
   ``manifest`` and ``matching`` tell which shards a predicate needs.

Only DataFrame functions; texts are read once and never shuffled by ``assign`` if the caller leaves them out.
Null values of a dimension are its first cell, null sizes are 0. Repeated rows are placed one by one; rows without an id
are rows like others. An empty table gives an empty result. Columns of maps cannot be ordered and are not supported.
The result does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.columns import partitions
from tickloom.session import cut

MAX_BITS = 16  # of all dimensions together: at most 65,536 cells are counted in one window
PARTS = 256
BLOCK = 65_536


class Layout(NamedTuple):
    dims: tuple[str, ...]
    bits: int
    bounds: tuple[tuple[tuple[float | str, int], ...], ...]  # per dimension: lowest value, cell
    n_rows: int


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return (x >> by | x << (n - by)) & ((1 << n) - 1)


def steps(n: int) -> list[int]:
    """For each orientation (entry corner, direction) and corner of an n-dimensional cube: next orientation x 2^n + digit."""
    def gray(i):
        return i ^ i >> 1

    def ones(i):  # trailing one bits
        return (~i & i + 1).bit_length() - 1

    digit_of = {gray(w): w for w in range(1 << n)}
    table = []
    for entry in range(1 << n):
        for axis in range(n):
            for corner in range(1 << n):
                w = digit_of[_rotate(corner ^ entry, axis + 1, n)]
                first = gray(2 * ((w - 1) // 2)) if w else 0
                turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                table.append((((entry ^ _rotate(first, n - (axis + 1) % n, n)) * n + (axis + turn + 1) % n) << n) + w)
    return table


def curve(cells: Sequence[Column], bits: int) -> Column:
    """Hilbert index of integer cell coordinates below ``2^bits``."""
    n = len(cells)
    corners = F.array(*[
        sum((F.shiftright(c, level).bitwiseAND(F.lit(1)) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
        for level in reversed(range(bits))])
    table = F.lit(steps(n))

    def step(at: Column, corner: Column) -> Column:
        found = F.get(table, at["state"] * (1 << n) + corner)
        return F.struct((at["index"] * (1 << n) + found.bitwiseAND(F.lit((1 << n) - 1))).alias("index"), F.shiftright(found, n).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(corners, start, step)["index"]


def _key(kind: T.DataType, c: Column) -> Column:
    """A dimension's value as a double or a string, in the same order."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return c.cast("string")


def _keys(docs: DataFrame, dims: Sequence[str]) -> list[Column]:
    return [_key(docs.schema[d].dataType, F.col(f"`{d}`")) for d in dims]


def fit(docs: DataFrame, dims: Sequence[str], bits: int = 4) -> Layout:
    """Cells of about equal rows for each dimension, from all rows."""
    if not dims or len(set(dims)) != len(dims) or bits < 1 or len(dims) * bits > MAX_BITS:
        raise ValueError(f"give different dimensions with at most {MAX_BITS} bits together")
    num = [not isinstance(docs.select(k).schema[0].dataType, T.StringType) for k in _keys(docs, dims)]
    values = F.array(*[
        F.struct(F.lit(i).alias("dim"), (k if is_num else F.lit(None).cast("double")).alias("num"),
                 (F.lit(None).cast("string") if is_num else k).alias("str"))
        for i, (k, is_num) in enumerate(zip(_keys(docs, dims), num))])
    counted = cut(docs.select(F.explode(values).alias("v")).groupBy("v.dim", "v.num", "v.str").agg(F.count("*").alias("m")))
    order = ["dim", "num", "str"]
    ranged = cut(counted.repartitionByRange(partitions(docs), *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("dim", "part").agg(F.sum("m").alias("rows"))  # one row per range and dimension
    by_dim = Window.partitionBy("dim")
    sums = sums.select("dim", "part", F.sum("rows").over(by_dim).alias("n"),
                       F.coalesce(F.sum("rows").over(by_dim.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("dim", "part").orderBy("num", "str").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("m").over(inside), F.lit(0))
    cells = ranged.join(sums, ["dim", "part"]).select("dim", "n", F.struct("num", "str").alias("value"), before.alias("before"))
    cells = cells.withColumn("cell", F.floor(F.col("before") * (1 << bits) / F.col("n")).cast("int"))
    found = cells.groupBy("dim", "cell").agg(F.min("value").alias("low"), F.max("n").alias("n")).orderBy("dim", "cell").collect()
    bounds = []
    for i, is_num in enumerate(num):
        low = [(r.low.num if is_num else r.low.str, r.cell) for r in found if r.dim == i]
        bounds.append(tuple(x for x in low if x[0] is not None))
    return Layout(tuple(dims), bits, tuple(bounds), found[0].n if found else 0)


def _found(key: Column, bounds: Sequence[tuple[Column, int]]) -> Column:
    """The number of the greatest bound not above the key, by halving; 0 for keys below all bounds and nulls."""
    def tree(lo: int, hi: int) -> Column:  # bounds[lo - 1] <= key < bounds[hi]
        if lo == hi:
            return F.lit(bounds[lo - 1][1] if lo else 0)
        mid = (lo + hi) // 2
        return F.when(key >= bounds[mid][0], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def index(docs: DataFrame, layout: Layout) -> Column:
    """The place of a row of ``docs`` along the curve."""
    return curve([_found(k, [(F.lit(v), c) for v, c in b]) for k, b in zip(_keys(docs, layout.dims), layout.bounds)], layout.bits)


def assign(docs: DataFrame, layout: Layout, shards: int, law: str = "rows", size_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` (all columns) plus struct ``_shard``: shard, slot (from 0 in each shard), curve, tie (hash of the row).

    An earlier ``_shard`` column is replaced.
    """
    if law not in ("rows", "bytes") or law == "bytes" and size_col is None:
        raise ValueError("the law is rows, or bytes with a size column")
    docs = docs.drop("_shard")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0)) if size_col else F.lit(1)
    same = (docs.select(row.alias("row"), index(docs, layout).alias("curve"), size.cast("long").alias("size"))
            .withColumn("tie", F.xxhash64("row"))
            .groupBy("curve", F.pmod("tie", F.lit(PARTS)).alias("part"), "tie", "row", "size").agg(F.count("*").alias("m")))
    sums = [F.sum(F.col("m")).alias("rows"), F.sum(F.col("m") * F.col("size")).alias("bytes")]
    same = cut(same)
    slices = same.groupBy("curve", "part").agg(*sums)

    def running(name: str, w) -> Column:
        return F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    along = Window.partitionBy(F.lit(1)).orderBy("curve")  # the cells of the curve, at most 2^MAX_BITS
    cells = slices.groupBy("curve").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    cells = cells.select("curve", *(running(c, along).alias(f"{c}_before") for c in ("rows", "bytes")))
    in_cell = Window.partitionBy("curve").orderBy("part")
    slices = slices.select("curve", "part", *(running(c, in_cell).alias(c) for c in ("rows", "bytes"))).join(cells, "curve")
    slices = slices.select("curve", "part", *((F.col(c) + F.col(f"{c}_before")).alias(f"{c}_start") for c in ("rows", "bytes")))
    in_slice = Window.partitionBy("curve", "part").orderBy("tie", "row")
    placed = cut(same.withColumn("bytes", F.col("m") * F.col("size")).join(slices, ["curve", "part"]).select(
        "row", "curve", "tie", "size", "m", (F.col("rows_start") + running("m", in_slice)).alias("at"),
        (F.col("bytes_start") + running("bytes", in_slice)).alias("byte")))
    single = placed.where(F.col("m") <= BLOCK).withColumn("block", F.lit(0).cast("long"))
    copies = placed.where(F.col("m") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {BLOCK}"))))
    if not copies.isEmpty():
        single = single.unionByName(copies.repartition(partitions(docs)))
    k = F.explode(F.sequence(F.col("block") * BLOCK, F.least("m", (F.col("block") + 1) * BLOCK) - 1))
    out = single.withColumn("k", k).select("row", "curve", "tie", "size", (F.col("at") + F.col("k")).alias("at"),
                                           (F.col("byte") + F.col("k") * F.col("size")).alias("byte"))
    n, s = max(layout.n_rows, 1), shards
    if law == "rows":
        out = out.withColumn("shard", F.expr(f"cast(at * {s} div {n} as int)"))
        out = out.withColumn("slot", F.expr(f"at - (cast(shard as long) * {n} + {s - 1}) div {s}"))
    else:
        total = max(same.agg(F.sum(F.col("m") * F.col("size"))).first()[0] or 0, 1)
        out = out.withColumn("shard", F.expr(f"cast(least({s - 1}, (2 * byte + size) * {s} div (2 * {total})) as int)"))
        first = out.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
        out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.struct("shard", "slot", "curve", "tie").alias("_shard"))


def write(docs: DataFrame, path: str, layout: Layout, shards: int, law: str = "rows", size_col: str | None = None, files: int | None = None) -> DataFrame:
    """Write the rows in folders ``shard=k``, ordered along the curve inside each file; returns the manifest.

    ``docs`` must not have a column named shard. Copies of one row that a cut would part go to the last of their
    shards. ``files`` partitions are written (default: the session's), each a range of the curve.
    """
    if "shard" in docs.columns:
        raise ValueError("a column is named shard")
    tie = F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    names = [*layout.dims, *([size_col] if size_col and size_col not in layout.dims else [])]
    keys = docs.select(*(F.col(f"`{c}`") for c in names), tie.alias("_row_hash"))
    # the place in order is (curve, hash of these columns), so the same hash is taken of the full rows
    key = F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in names), tie.alias("_row_hash")))
    starts = (assign(keys, layout, shards, law, size_col).groupBy("_shard.shard").agg(F.min(F.struct("_shard.curve", "_shard.tie")).alias("first"))
              .orderBy("shard").collect())
    at = F.struct(F.col("_place.curve").alias("curve"), F.col("_place.tie").alias("tie"))
    shard = _found(at, [(F.struct(F.lit(r.first.curve).cast("long").alias("curve"), F.lit(r.first.tie).cast("long").alias("tie")), r.shard) for r in starts])
    rows = docs.withColumn("_place", F.struct(index(docs, layout).alias("curve"), key.alias("tie"))).withColumn("shard", shard)
    rows = rows.repartitionByRange(files or partitions(docs), "shard", "_place").sortWithinPartitions("shard", "_place")
    rows.drop("_place").write.partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession, path, layout.dims)


def manifest(spark: SparkSession, path: str, dims: Sequence[str]) -> DataFrame:
    """shard, n_rows and the least and greatest value of every dimension (``min_x``, ``max_x``); nulls are not in them."""
    docs = spark.read.parquet(path)
    return docs.groupBy("shard").agg(
        F.count("*").alias("n_rows"), *(f(f"`{d}`").alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))


def matching(shards: DataFrame, **ranges: tuple) -> DataFrame:
    """The rows of a manifest that may hold values in all ranges (low, high), both ends included, None open."""
    for d, (lo, hi) in ranges.items():
        if lo is not None:
            shards = shards.where(F.col(f"max_{d}") >= F.lit(lo))
        if hi is not None:
            shards = shards.where(F.col(f"min_{d}") <= F.lit(hi))
    return shards


def size_and_checksum(text_col: str = "text") -> Mapping[str, Column]:
    """Columns ``size`` (UTF-8 bytes of the text, null: none, plus 16) and ``text_crc32`` (of those bytes)."""
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return {"size": (F.octet_length(data) + 16).cast("long"), "text_crc32": F.crc32(data)}
