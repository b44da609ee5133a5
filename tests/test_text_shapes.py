"""Only texts of a format's shape reach the parser; the times found are those of trying every format."""

import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import timeparse as tp

TEXTS = ["2024-01-05 06:07:08", " 2024-01-05 06:07:08 ", "2024-01-05T06:07:08", "2024-01-05t06:07:08", "2024-01-05 06:07:08.5", "2024-01-05 06:07:08.123456",
         "2024-01-05 06:07:08.1234567", "2024-01-05 06:07:08.", "2024-01-05T06:07:08Z", "2024-01-05T06:07:08+03:00", "2024-01-05t06:07:08z",
         "2024-01-05T06:07:08+0300", "2024-01-05 06:07", "2024-01-05", "05.01.2024 06:07:08", "05.01.2024", "20240105 06:07:08", "20240105",
         "+12024-01-05", "-2024-01-05", "+2024-01-05", "12024-01-05", "020240105", "-20240105", "+120240105", "05.01.+12024", "0000-01-05", "2024-02-30", "2024-13-01",
         "2024-1-5", "2024-01-05 6:07:08", "0:00:11", "24:00:00", "2024-01-05 24:00:00", "2024-01-05\n", "２０２４-01-05", "n/a", "", None]


def plain(x):
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)) for f in tp.TIME_FORMATS])


def test_same_times_as_every_format_tried(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = d.select("t", F.unix_micros(tp.parse_text(F.col("t"))).alias("a"), F.unix_micros(plain(F.col("t"))).alias("b")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]
    assert sum(r.a is not None for r in rows) > 12


def test_clock_texts_reach_no_parser():
    shapes = [tp.text_shape(f) for f in tp.TIME_FORMATS]
    fits = lambda t: sum(bool(re.search(s, t)) for s in shapes)
    assert fits("0:00:11") == fits("10:00:11") == fits("2024-01-05 0:00:11") == 0 and fits("2024-01-05") == 1


@pytest.mark.parametrize("fmt", ["d.M.yyyy", "MMM dd", "hh:mm a"])
def test_unknown_letters_are_always_tried(fmt):
    assert tp.text_shape(fmt) is None
