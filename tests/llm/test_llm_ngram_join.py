import re

import numpy as np
import pytest
from llm_frames import documents, odd_texts

from tickloom.llm import ngram_join
from tickloom.llm.components import components


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, percent=85, k=4):
    s = [shingles(t, k) for _, t in texts]
    n = len(s)
    label, links = list(range(n)), [0] * n
    for a in range(n):
        for b in range(n):
            o = len(s[a] & s[b])
            if a != b and s[a] and 100 * o >= percent * (len(s[a]) + len(s[b]) - o):
                links[a] += 1
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    first = {}
    for (i, _), c in zip(texts, label):
        first[c] = min(first.get(c, i), i)
    return {i: (len(x), first[c], m) for (i, _), x, c, m in zip(texts, s, label, links)}


def near_copies(seed, n=70, length=150, edits=4):
    r = np.random.default_rng(seed)
    base = [f"v{i}" for i in r.integers(0, 10_000, length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, edits + 1))):
            w[int(r.integers(length))] = f"e{int(r.integers(10**6))}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [85, 60])
def test_classes_and_links_equal_all_pairs(spark, percent):
    texts = odd_texts(5, 90) + near_copies(2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(documents(spark, texts), percent=percent).collect()}
    assert got == brute(texts, percent)


def test_groups_above_the_block_size_are_searched_in_pairs_of_blocks(spark, monkeypatch):
    texts = near_copies(7, n=90, edits=6)
    monkeypatch.setattr(ngram_join, "BLOCK", 3000)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(documents(spark, texts)).collect()}
    want = brute(texts)
    assert got == want
    assert len({c for _, c, _ in want.values()}) > 1  # some near copies are not similar enough


def test_search_equals_counting_whatever_the_list_lengths():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, size)) for size in r.integers(1, 300, 80)]
    sets += [np.unique(np.concatenate((sets[0], r.integers(0, 400, k)))) for k in range(30)]
    ids, sizes = np.arange(len(sets)) * 3, np.array([len(s) for s in sets])
    _, links = ngram_join.search(ids, np.ones(len(sets), int), sizes, np.concatenate(sets).astype(np.uint64), None, 70)
    for i, a in enumerate(sets):
        o = np.array([len(np.intersect1d(a, b)) for b in sets])
        assert links[i] == (100 * o >= 70 * (len(a) + sizes - o)).sum() - 1


def test_empty_and_tiny_tables(spark):
    d = documents(spark, [(1, None), (2, ""), (3, "a b"), (4, "A  b")])
    assert ngram_join.join(d.where("false")).count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(d).collect()} == {
        1: (0, 1, 0), 2: (0, 2, 0), 3: (1, 3, 1), 4: (1, 3, 1)}


def test_rows_that_repeat_are_all_answered(spark):
    d = documents(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (5, "other words in this one")])
    assert sorted(tuple(r)[:3] for r in ngram_join.join(d).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 2, 5)]


def test_rows_without_an_id_and_with_a_shared_one_are_searched_by_themselves(spark):
    near = near_copies(4, n=2, edits=1)
    a, b = near[0][1], near[1][1]
    d = documents(spark, [(None, a), (None, b), (None, "a b c d e"), (7, b), (7, "words of quite another kind"), (3, "x y z"), (3, "x y z"), (None, None), (None, "")])
    got = sorted(tuple(r) for r in ngram_join.join(d).select("n_shingles", "n_links", "component_id", "doc_id").na.fill(-1).collect())
    n = 147
    assert got == [(0, 0, -1, -1), (0, 0, -1, -1), (1, 1, 3, 3), (1, 1, 3, 3), (2, 0, -1, -1), (2, 0, 7, 7), (n, 2, 7, -1), (n, 2, 7, -1), (n, 2, 7, 7)]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    near = near_copies(4, n=3, edits=1)
    a, b, c = (t for _, t in near)
    other, third = "words of quite another kind", "a b c d e f"
    d = documents(spark, [(None, a), (None, b), (7, c), (7, other), (8, other + " "), (2, third), (2, third), (2, third), (None, None), (None, None), (4, ""), (4, ""),
                          (None, "k l m n o"), (None, "k l m n o"), (None, "alone in here it is")])
    out = ngram_join.firsts(d)
    assert out.columns == d.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(
        [(7, c), (7, other), (2, third), (None, None), (None, None), (4, ""), (4, ""), (None, "k l m n o"), (None, "alone in here it is")], key=key)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and 200 not in got
