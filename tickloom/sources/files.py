"""Reading bar, signal and candle files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.timeparse import locale_number, resolve_time
from tickloom.operators.filters import normalise_side
from tickloom.operators.relations import dedup, prefer
from tickloom.schema import BAR_SCHEMA

# Accepted column names per bar field, first match wins.
FIELD_NAMES = {
    "open": ["open", "o", "price_open", "openprice"],
    "high": ["high", "h", "price_high", "highprice"],
    "low": ["low", "l", "price_low", "lowprice"],
    "close": ["close", "c", "last", "price", "settle", "closeprice", "pr_close", "value"],
    "volume": ["volume", "vol", "qty", "turnover", "val"],
}
# The default universe.
UNIVERSE = ["GAZP", "ROSN", "SBER", "LKOH", "GMKN", "YNDX", "NVTK", "NLMK", "MTSS", "TATN", "CHMF", "SNGS", "PIKK", "PLZL",
            "MGNT", "VKCO", "OZON"]

CANDLES = T.StructType([T.StructField("candles", T.StructType([
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
]))])


def universe(symbols: Sequence[str]) -> list[str]:
    """The given symbols; ``all`` stands for the default list."""
    return list(UNIVERSE) if list(symbols) == ["all"] else list(symbols)


def in_universe(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Rows of the listed symbols; a literal list, so it prunes partitions and reaches the scan."""
    return df.filter(F.col("symbol").isin(universe(symbols)))


def symbol_from_path(pattern: str) -> Column:
    """First capture group of ``pattern`` in the path of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


# Encodings Spark accepts without further settings.
STANDARD_ENCODINGS = {"us-ascii", "iso-8859-1", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32"}


def allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Let the session use Java charsets such as windows-1251 when one is asked for."""
    if encoding.lower() not in STANDARD_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_bar_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: T.StructType | None = None,
                 pattern: str = r"([^/]+)\.csv(?:/[^/]*)?$") -> DataFrame:
    """All per-symbol CSV files of a folder in one scan; the symbol is the file (or folder) name.

    Without ``schema`` every column is read as text: nothing is guessed twice over
    the data, ``normalize_bars`` casts what it needs.
    """
    allow_encoding(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select("*", symbol_from_path(pattern).alias("symbol")) if "symbol" not in df.columns else df


def read_bar_parquet(spark: SparkSession, glob: str, pattern: str = r"([^/_]+)_[^/]*\.parquet") -> DataFrame:
    """Parquet files by glob with the symbol taken from names like ``ABC_1m_2024-01-01.parquet``."""
    return spark.read.parquet(glob).select("*", symbol_from_path(pattern).alias("symbol"))


def _pick(df: DataFrame, field: str) -> str | None:
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[n] for n in FIELD_NAMES[field] if n in lower), None)


def normalize_bars(df: DataFrame) -> DataFrame:
    """Loosely named tables to symbol, ts, open, high, low, close, volume.

    Close falls back to open; open, high and low to close; volume to 0.  Rows
    without a usable close or time are dropped.
    """
    df = resolve_time(df)
    names = {f: _pick(df, f) for f in FIELD_NAMES}
    close = names["close"] or names["open"]
    if close is None:
        raise ValueError("cannot find a close or price column")
    num = lambda c: F.col(c).try_cast("double")
    value = lambda f: num(names[f]) if names[f] else num(close)
    vol = F.coalesce(num(names["volume"]), F.lit(0.0)) if names["volume"] else F.lit(0.0)
    symbol = [F.col("symbol")] if "symbol" in df.columns else []
    return df.select(
        *symbol, "ts", value("open").alias("open"), value("high").alias("high"), value("low").alias("low"),
        num(close).alias("close"), vol.alias("volume"),
    ).filter(F.col("close").isNotNull() & ~F.isnan("close"))


def normalize_signals(df: DataFrame) -> DataFrame:
    """Signal tables: resolved time, lower-case names, side from side/score/signal."""
    df = df.toDF(*[c.lower() for c in df.columns])
    for c in ("score", "signal", "side", "conf"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    return normalise_side(resolve_time(df))


def read_processed_or_raw(spark: SparkSession, processed: str, raw: str) -> DataFrame:
    """Bars of the processed folder where a symbol has them, raw bars of the other symbols."""
    return prefer(spark.read.schema(BAR_SCHEMA).parquet(processed), spark.read.schema(BAR_SCHEMA).parquet(raw))


def parse_candles(df: DataFrame, payload: str = "value") -> DataFrame:
    """Candle payloads (column names + rows of mixed scalars) to bars.

    One payload per row; other columns stay.  Positions come from the payload's own
    column list, numbers may be localised, rows without full prices are dropped.
    """
    keep = [c for c in df.columns if c != payload]
    j = df.select(*keep, F.from_json(payload, CANDLES)["candles"].alias("c"))
    rows = j.select(*keep, F.col("c.columns").alias("names"), F.posexplode("c.data").alias("pos", "row"))
    at = lambda n: F.try_element_at("row", F.array_position("names", n).cast("int"))
    has = lambda n: F.array_position("names", n) > 0
    field = lambda n: F.when(has(n), at(n))
    out = rows.select(
        *keep, "pos", F.try_to_timestamp(field("begin"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        *[locale_number(field(n)).alias(n) for n in ("open", "high", "low", "close", "volume")],
    )
    return out.na.drop(subset=["ts", "open", "high", "low", "close"])


def read_candles(spark: SparkSession, path: str, pattern: str = r"([^/_]+)_[^/]*\.json$") -> DataFrame:
    """A landing folder of candle payload files, one document per file."""
    df = spark.read.text(path, wholetext=True)
    return parse_candles(df.select("value", symbol_from_path(pattern).alias("symbol")))


def merge_append(old: DataFrame, new: DataFrame, ts: str = "ts") -> DataFrame:
    """Union in which a newer row replaces an older one of the same symbol and time."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return dedup(both, ["symbol", ts], ["_gen"]).drop("_gen")
