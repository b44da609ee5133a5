"""Shards along the curve against plain loops over collected rows."""

import datetime
import itertools
import zlib
from collections import Counter

import pytest
from conftest import SF
from llm_frames import documents, odd_texts
from pyspark.sql import functions as F

from tickloom.llm import hilbert_shards as H
from tickloom.llm import queries


def curve_index(x, bits):
    """Index by transposing coordinates: undo the Gray code level by level, then interleave (an independent method)."""
    x, n, m = list(x), len(x), 1 << bits - 1
    q = m
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def null_first(v):
    return (v is not None, v if v is not None else 0)


def cells(values, bits):
    """Rows before a value x cells / rows."""
    counts, before, out = Counter(values), 0, {}
    for v in sorted(counts, key=null_first):
        out[v] = before * (1 << bits) // len(values)
        before += counts[v]
    return out


@pytest.mark.parametrize("n,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), [f"x{i}" for i in range(n)])
    at = {r.i: r[:n] for r in points.withColumn("i", H.curve([F.col(c).cast("int") for c in points.columns], bits)).collect()}
    assert sorted(at) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))
    # the independent method walks the same unit steps, in some orientation of the cube
    other = {curve_index(p, bits): p for p in at.values()}
    assert sorted(other) == sorted(at) and all(sum(abs(a - b) for a, b in zip(other[i], other[i + 1])) == 1 for i in range(len(at) - 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 11 else None, t, ["en", "de", None, "fr"][i % 4], f"s{i * i % 7}", len(t or ""), "clash", i % 3, float("nan") if i % 5 == 0 else i / 7)
            for i, t in odd_texts(n=60)]
    rows += rows[5:25] + [rows[30]] * 37  # repeated rows, one of them often
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, curve int, slot double").repartition(5)


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("shards", [7, 40, 300])
def test_shards_equal_loops(docs, law, shards):
    """Cells, order, cuts and slots by sorting; only Spark's index of a cell and its row hash are taken over."""
    dims, bits = ["source", "lang", "n_chars"], 3
    d = docs.withColumns(H.size_and_checksum())
    layout = H.fit(d, dims, bits)
    got = H.assign(d, layout, shards, law, "size")
    assert got.columns == [*d.columns, "_shard"]
    rows = got.collect()
    n = len(rows)
    assert n == d.count() == layout.n_rows
    where = [cells([r[c] for r in rows], bits) for c in dims]
    index = {}
    for r in rows:  # one index per cell triple, different for different triples
        assert index.setdefault(tuple(w[r[c]] for w, c in zip(where, dims)), r._shard.curve) == r._shard.curve
    assert len(set(index.values())) == len(index)
    rows.sort(key=lambda r: (r._shard.curve, r._shard.tie % 256, r._shard.tie, r._shard.shard, r._shard.slot))
    total, before, slots = sum(r.size for r in rows), 0, Counter()
    for i, r in enumerate(rows):
        want = i * shards // n if law == "rows" else min(shards - 1, (2 * before + r.size) * shards // (2 * total))
        assert (r._shard.shard, r._shard.slot) == (want, slots[want])
        slots[want] += 1
        before += r.size
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    if law == "rows":
        assert max(slots.values()) - min(slots[k] for k in range(shards)) <= 1


def test_layout_of_the_table_does_not_matter(docs):
    d = docs.withColumns(H.size_and_checksum()).drop("text")
    results = []
    for part in (d.repartition(1), d.repartition(9, "lang")):
        layout = H.fit(part, ["source", "doc_id"], 4)
        results.append(sorted(map(repr, H.assign(part, layout, 6).collect())))
    assert results[0] == results[1]


def test_copies_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 10)
    d = spark.createDataFrame([(1, "a")] * 95 + [(2, "b")] * 10 + [(3, "c")], "doc_id long, lang string")
    rows = H.assign(d, H.fit(d, ["lang"], 2), 4).collect()
    assert Counter(r.doc_id for r in rows) == {1: 95, 2: 10, 3: 1}
    seen = {(r._shard.shard, r._shard.slot) for r in rows}
    assert len(seen) == 106 and sorted(Counter(s for s, _ in seen).values()) == [26, 26, 27, 27]


def test_empty_null_and_refused(spark, docs):
    none = docs.where("false")
    assert H.assign(none, H.fit(none, ["lang"]), 5).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 5, "doc_id long, lang string, day date")
    out = H.assign(nulls, H.fit(nulls, ["lang", "day"]), 2, "bytes", "doc_id").collect()
    assert len(out) == 5 and all(r._shard.curve == 0 for r in out)
    days = spark.createDataFrame([(datetime.date(2024, 1, i + 1), datetime.datetime(2024, 1, 1, i), i % 2 == 0) for i in range(8)], "d date, t timestamp, b boolean")
    assert len({r._shard.curve for r in H.assign(days, H.fit(days, ["d", "t", "b"], 3), 2).collect()}) == 8
    for bad in (dict(dims=[]), dict(dims=["lang", "lang"]), dict(dims=["lang", "source"], bits=9)):
        with pytest.raises(ValueError):
            H.fit(docs, **bad)
    with pytest.raises(ValueError):
        H.assign(docs, H.fit(docs, ["lang"]), 3, "bytes")


def test_written_shards_prune_by_every_dimension(spark, docs, tmp_path):
    d = docs.withColumns(H.size_and_checksum())
    layout = H.fit(d, ["source", "n_chars", "doc_id"], 4)
    m = H.write(d, str(tmp_path / "out"), layout, 16, "bytes", "size", files=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(d.columns).collect())) == sorted(map(repr, d.collect()))
    assert m.agg(F.sum("n_rows")).first()[0] == d.count()
    for ranges in (dict(source=("s2", "s2")), dict(n_chars=(None, 30)), dict(doc_id=(20, 30)), dict(source=("s4", "s4"), n_chars=(100, None))):
        keep = {r.shard for r in H.matching(m, **ranges).collect()}
        hit = back
        for c, (lo, hi) in ranges.items():
            hit = hit.where(F.col(c).between(*(F.lit(x) for x in (lo, hi))) if None not in (lo, hi) else F.col(c) <= hi if lo is None else F.col(c) >= lo)
        assert {r.shard for r in hit.select("shard").distinct().collect()} <= keep and len(keep) < m.count()


def test_query(spark):
    rows = queries.QUERIES["op11_hilbert_shards"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len((docs[r.doc_id] or "").encode()) + 16, zlib.crc32((docs[r.doc_id] or "").encode()), "rows", None) for r in rows)


def test_no_python_in_the_plan(spark, capsys):
    queries.QUERIES["op11_hilbert_shards"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "RDD" not in plan
