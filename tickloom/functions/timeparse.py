"""Timestamps and numbers in the shapes market files use."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and formats accepted for bar and signal times.
TIME_COLUMNS = ["dt", "datetime", "datetime_iso", "datetime_utc", "timestamp", "time", "date", "begin", "end",
                "candle_begin_time", "candle_end_time"]
CLOCK_COLUMNS = ["time", "tradetime", "systime"]
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy",
                "yyyyMMdd HH:mm:ss", "yyyyMMdd"]


def parse_epoch(x: Column) -> Column:
    """Epoch seconds, or milliseconds when the number is above 1e12."""
    v = x.cast("double")
    ms = F.when(v > 1e12, v).otherwise(v * 1000.0)
    return F.timestamp_millis(F.round(ms).cast("long"))


# A text that a format letter can stand for; a year may have a sign and more digits.
_SHAPES = {"yyyy": "[+-]?[0-9]{4,}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}


def text_shape(fmt: str) -> str | None:
    """Regular expression that every text of the format matches, so that others need not be tried; None for letters not known here."""
    out = ""
    for quoted, letters, other in re.findall(r"'([^']+)'|(yyyy|MM|dd|HH|mm|ss|[A-Za-z]+)|(.)", fmt):
        if letters and letters not in _SHAPES:
            if set(letters) - set("SXxZ"):
                return None
            out += ".*"  # fractions and zones
        else:
            out += _SHAPES[letters] if letters else "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in quoted or other)
    return f"^{out}$"


def parse_text(x: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Time of the first format that fits.

    A format that does not fit costs an exception per row, many times the price of a parse, so only
    texts of its shape are given to it.
    """
    s = F.trim(x.cast("string"))

    def parsed(fmt: str) -> Column:
        time, shape = F.try_to_timestamp(s, F.lit(fmt)), text_shape(fmt)
        return time if shape is None else F.when(s.rlike(shape), time)

    return F.coalesce(*[parsed(f) for f in formats])


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def parse_time(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return parse_epoch(F.col(name)) if _numeric(df, name) else parse_text(F.col(name))


def resolve_time(df: DataFrame, out: str = "ts") -> DataFrame:
    """Find the time column of a loosely named table and parse it.

    Order: trade date + clock time, then the known names, then any name that
    contains time/date/dt.  A candidate counts when more than half of its rows
    parse (one aggregate over all candidates; the data decides the plan).
    """
    lower = {c.lower(): c for c in df.columns}
    cands: list[tuple[str, Column, float]] = []
    clock = next((c for c in CLOCK_COLUMNS if c in lower), None)
    if "tradedate" in lower and clock:
        d = F.trim(F.col(lower["tradedate"]).cast("string"))
        t = F.trim(F.col(lower[clock]).cast("string"))
        both = lambda x: parse_text(F.concat_ws(" ", d, x))
        cands.append(("combined", F.coalesce(both(t), both(F.lpad(t, 8, "0"))), 0.0))
    named = [c for c in ["ts", *TIME_COLUMNS] if c in lower]
    loose = [c for c in lower if c not in named and any(k in c for k in ("time", "date", "dt"))]
    cands += [(c, parse_time(df, lower[c]), 0.5) for c in named + loose]
    if not cands:
        raise ValueError("no recognizable datetime column")
    shares = df.agg(*[F.avg(e.isNotNull().cast("double")).alias(f"s{i}") for i, (_, e, _) in enumerate(cands)]).first()
    for i, (_, expr, need) in enumerate(cands):
        if (shares[i] or 0.0) > need:
            return df.withColumn(out, expr).filter(F.col(out).isNotNull())
    raise ValueError("no recognizable datetime column")


def locale_number(x: Column) -> Column:
    """Numbers written like ``1 234,5``; null when they do not parse."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("string"), "[  ]", ""), ",", ".")
    return plain.try_cast("double")


def clock_text(ts: Column, zone: str | None = None) -> Column:
    """Time of day as HH:mm:ss, in ``zone`` when given."""
    return F.date_format(F.from_utc_timestamp(ts, zone) if zone else ts, "HH:mm:ss")


def last_business_day(d: Column) -> Column:
    """The day itself, or the Friday before a weekend day."""
    day = F.to_date(d)
    back = F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0)
    return F.date_sub(day, back)


def month_ranges(start: Column, end: Column) -> Column:
    """Array of (first day, last day) pairs of the months that cover [start, end], clipped to it."""
    firsts = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(
        firsts,
        lambda m: F.struct(
            F.greatest(m, F.to_date(start)).alias("first"), F.least(F.last_day(m), F.to_date(end)).alias("last")
        ),
    )
