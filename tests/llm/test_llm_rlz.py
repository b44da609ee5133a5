import random
import re

import pytest
from llm_frames import documents, odd_texts

from tickloom.llm import rlz_dedup


def brute(texts, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    first, out = {}, {}
    for i in sorted(words):
        w, gone = words[i], set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in first:
                gone.update(range(p, p + window))
            else:
                first[key] = (i, p)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out, words


def greedy(words, window):
    """Factors of every document by a loop: the first place of the window, carried on word by word."""
    first, out = {}, {}
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), (i, p))
    for i, w in words.items():
        out[i], p = [], 0
        while p <= len(w) - window:
            d, r = first[tuple(w[p:p + window])]
            if (d, r) == (i, p):
                p += 1
                continue
            n = window
            while p + n < len(w) and r + n < len(words[d]) and w[p + n] == words[d][r + n]:
                n += 1
            out[i].append((p, p + n, d, r))
            p += n - window + 1
    return out


@pytest.mark.parametrize("window,seed", [(20, 1), (9, 3), (5, 2), (3, 4)])
def test_factors_equal_a_greedy_loop(spark, window, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefg") + str(rng.randrange(6)) for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(90):  # passages of passages, copies of copies, periods
        w = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(base + [t for _, t in texts[-12:]]).split()
            lo = rng.randrange(len(x)) if x else 0
            w += x[lo:lo + rng.randrange(1, 50)] * rng.choice([1, 1, 1, 2, 4])
        texts.append((i, " ".join(w[:400])))
    words = {i: t.split() for i, t in texts}
    want = greedy(words, window)
    assert sum(map(len, want.values())) > 100
    rows = rlz_dedup.deduplicate(documents(spark, texts), window).collect()
    assert {r.doc_id: [(f.start, f.end, f.ref_doc, f.ref_start) for f in r.factors] for r in rows} == want
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute(texts, window)[0]


def test_a_copy_is_one_factor_though_an_older_document_holds_its_middle(spark):
    w = [str(i) for i in range(40)]
    d = documents(spark, [(1, " ".join(w[10:25])), (2, " ".join(w)), (3, " ".join(w))])
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in rlz_dedup.deduplicate(d, 5).collect()}
    assert got == {1: [], 2: [(10, 25, 1, 0)], 3: [(0, 40, 2, 0)]}


@pytest.mark.parametrize("window,seed", [(20, 1), (9, 3), (5, 2)])
def test_removed_words_equal_a_loop(spark, window, seed):
    texts = odd_texts(seed, 80)
    d = documents(spark, texts)
    got = rlz_dedup.deduplicate(d, window).collect()
    want, words = brute(texts, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    for r in got:  # a factor is its reference's words
        for f in r.factors:
            assert words[r.doc_id][f.start:f.end] == words[f.ref_doc][f.ref_start:f.ref_start + f.end - f.start]
            assert (f.ref_doc, f.ref_start) < (r.doc_id, f.start) and f.end - f.start >= window


def test_periodic_text_and_empty_tables(spark):
    texts = [(1, "a b " * 100), (2, None), (3, "x"), (4, " ".join(map(str, range(50)))), (5, " ".join(map(str, range(10, 45))))]
    d = documents(spark, texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rlz_dedup.deduplicate(d, 20).collect()} == brute(texts, 20)[0]
    assert rlz_dedup.deduplicate(d.where("false"), 20).count() == 0


def test_rows_that_share_an_id_are_each_answered(spark):
    text = " ".join(map(str, range(30)))
    d = documents(spark, [(1, text), (1, text), (2, text)])
    assert sorted((r.doc_id, r.n_removed) for r in rlz_dedup.deduplicate(d, 20).collect()) == [(1, 0), (1, 30), (2, 30)]


def test_rows_without_an_id_come_last_and_one_by_one(spark):
    a, b = " ".join(map(str, range(30))), " ".join(map(str, range(40, 75)))
    d = documents(spark, [(None, a), (None, a), (None, b), (7, a), (8, b + " x"), (None, None)])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, {f.ref_doc for f in r.factors}) for r in rlz_dedup.deduplicate(d, 20).collect())
    assert got == [(False, 7, 30, 0, set()), (False, 8, 36, 0, set()), (True, 0, 0, 0, set()), (True, 0, 30, 30, {7}), (True, 0, 30, 30, {7}), (True, 0, 35, 35, {8})]
    lone = documents(spark, [(None, a), (None, a)])
    assert sorted((r.n_removed, [f.ref_doc for f in r.factors]) for r in rlz_dedup.deduplicate(lone, 20).collect()) == [(0, []), (30, [None])]
