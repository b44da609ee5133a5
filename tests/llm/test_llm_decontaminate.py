import gc
import re
import weakref

import pytest
from llm_frames import documents, odd_texts, rows

from tickloom.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    wanted = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1) if k else ():
            wanted.setdefault(tuple(w[p:p + k]), set()).add(i)
    sizes = {len(x) for x in wanted}
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in wanted:
                    hit.update(range(p, p + k))
                    found |= wanted[tuple(w[p:p + k])]
        out[i] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def case():
    texts = odd_texts(4, 70)
    items = [(i, " ".join((t or "").split()[3:3 + n])) for i, ((_, t), n) in enumerate(zip(texts[10:60], list(range(1, 40)) + [60] * 11))]
    items += [(90, None), (91, ""), (92, "one"), (92, "one"), (93, "a b c"), (94, items[20][1])]
    return texts, items


@pytest.mark.parametrize("block_words", [4_000_000, 300])
def test_hits_equal_a_loop_in_one_block_or_many(spark, block_words):
    texts, items = case()
    d, b = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = dc.digest(dc.find(d, b, block_words=block_words)).collect()
    want = brute(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == want
    kept = dc.clean(d, b, block_words=block_words)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if not x[3])


def test_empty_tables_and_repeated_rows(spark):
    d = documents(spark, [(1, "a b c"), (1, "a b c"), (2, None)])
    b = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    assert dc.find(d.where("false"), b).count() == 0
    assert [r.n_hit for r in dc.digest(dc.find(d, b.where("false"))).collect()] == [0, 0, 0]
    assert sorted((r.doc_id, r.n_hit) for r in dc.digest(dc.find(d, b)).collect()) == [(1, 2), (1, 2), (2, 0)]
    assert rows(dc.clean(d, b)).keys() == {2}


@pytest.mark.parametrize("block_words", [1_000_000, 10])
def test_rows_are_judged_by_their_own_text_in_one_block_or_many(spark, block_words):
    item = " ".join(f"q{i}" for i in range(14))
    other = " ".join(f"z{i}" for i in range(13))
    plain = " ".join(f"n{i}" for i in range(30))
    texts = [(1, item), (1, plain), (None, item + " x"), (None, plain), (None, other), (2, plain), (2, plain), (3, other), (3, None), (3, other)]
    b = spark.createDataFrame([(5, item), (6, other), (7, "r s t u v w"), (8, item)], "item_id long, text string")
    d = documents(spark, texts)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in dc.digest(dc.find(d, b, block_words=block_words)).collect())
    assert got == sorted([(1, 14, 14, 2), (1, 30, 0, 0), (0, 15, 14, 2), (0, 30, 0, 0), (0, 13, 13, 1), (2, 30, 0, 0), (2, 30, 0, 0), (3, 13, 13, 1), (3, 0, 0, 0), (3, 13, 13, 1)])
    kept = dc.clean(d, b, block_words=block_words)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, plain), (1, plain), (2, plain), (2, plain), (3, "")]


def test_the_driver_holds_one_block_at_a_time(spark, monkeypatch):
    texts, items = case()
    built, real = [], dc.item_windows

    def watched(*args):
        gc.collect()
        assert not any(w() is not None for w in built)
        out = real(*args)
        built.extend(weakref.ref(i.shingles) for i in out)
        return out

    monkeypatch.setattr(dc, "item_windows", watched)
    dc.find(documents(spark, texts[:5]), spark.createDataFrame(items, "item_id long, text string"), block_words=1500)
    assert len(built) > 1


@pytest.mark.parametrize("window,block_words", [(3, 1_000_000), (5, 300)])
def test_other_windows(spark, window, block_words):
    texts, items = case()
    d, b = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items, window)
    got = dc.digest(dc.find(d, b, window=window, block_words=block_words)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == want
    kept = dc.clean(d, b, window=window, block_words=block_words)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if not x[3])
