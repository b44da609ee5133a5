"""Aligned tokens against overlaps of byte ranges by a double loop."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import documents, odd_texts
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tickloom.llm import queries
from tickloom.llm import token_align as A

PAIR = A.load(queries.BYTES, queries.PIECES)


def ranges(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def encoded(texts):
    """Ids and byte ranges of both tokenizers, straight from their libraries."""
    a = Tokenizer.from_file(queries.BYTES)
    a.encode_special_tokens = True
    letter = {}
    for i in range(0x200):  # the byte-level alphabet: each letter stands for one byte
        c = chr(i)
        if a.token_to_id(c) is not None and len(letter) < 256:
            letter[c] = None
    assert len(letter) == 256 and ByteLevel().decode(["\u0120"]) == " "
    b = SentencePieceProcessor(model_file=queries.PIECES)
    for text in texts:
        if not text:
            yield [], [], [], []
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        ia, ib = e.ids, b.encode(text)
        size_a = [len(a.id_to_token(i)) for i in ia]  # one letter a byte
        pieces = [b.id_to_piece(i) for i in ib]
        data = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(ib, pieces)]
        if a.decode(ia, skip_special_tokens=False) != " " + text or b"".join(data).decode() != " " + text:
            yield [], [], [], []
        else:
            yield ia, ranges(size_a), ib, ranges(map(len, data))


def brute(texts):
    rows, pairs = [], []
    for ia, ra, ib, rb in encoded(texts):
        hit = [(x, y) for x, (s, e) in zip(ia, ra) for y, (u, v) in zip(ib, rb) if max(s, u) < min(e, v)]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        parts, lo = [], 0
        for hi in common:
            parts.append(",".join(str(x) for x, r in zip(ia, ra) if lo <= r[0] < hi) + "|" + ",".join(str(x) for x, r in zip(ib, rb) if lo <= r[0] < hi))
            lo = hi
        pairs.append(hit)
        rows.append([len(ia), len(ib), len(common), len(hit), hashlib.sha256(";".join(parts).encode()).hexdigest() if ia else "", parts])
    count = Counter(p for hit in pairs for p in hit)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(*r[:4], sum(count[p] == top[p[1]] for p in hit), sum(count[p] for p in hit), r[4], r[5]) for r, hit in zip(rows, pairs)], count


TEXTS = [t[:600] if t else t for _, t in odd_texts(n=30)] + [
    "<|endoftext|> and </s> and <s> as text", "\u2581 a lower block", "  two  spaces \n\n and\ttabs ", "naïve 日本 🙂🙂 \u200b \x00 null", "e\u0301 combining ﬁ ligature", " ",
    "word" * 200, "don't won't I'm 12345678 1.5e-3", "ends with space ", "same text", "same text", "same text"]


@pytest.mark.parametrize("chunk", [A.CHUNK, 50, 3000])
def test_documents_equal_double_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    docs = documents(spark, list(enumerate(TEXTS)), partitions=3)
    want, _ = brute(TEXTS)
    got = {r.doc_id: r for r in A.summary(docs, PAIR).collect()}
    assert len(got) == len(TEXTS)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w[:7], TEXTS[i]
    assert sum(w[0] > 0 for w in want) > 30 and any(t and not w[0] for t, w in zip(TEXTS, want))


def test_groups_and_pairs(spark):
    docs = documents(spark, list(enumerate(TEXTS)), partitions=2)
    want, count = brute(TEXTS)
    got = {}
    for r in A.groups(docs, PAIR).orderBy("doc_id", "group").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (t, w) in enumerate(zip(TEXTS, want)):
        rows = got.get(i, [])
        assert [f"{','.join(map(str, r.a))}|{','.join(map(str, r.b))}" for r in rows] == w[7]
        assert [r.group for r in rows] == list(range(len(rows)))
        if rows:
            assert [r.start for r in rows] == [0, *(r.end for r in rows[:-1])] and rows[-1].end == len(t.encode()) + 1
    table = {(r.a, r.b): (r.n, r.best) for r in A.pair_counts(A.encode(docs, PAIR), PAIR)[1].collect()}
    assert {p: n for p, (n, _) in table.items()} == count
    assert all(best == (n == max(m for (_, y), m in count.items() if y == p[1])) for p, (n, best) in table.items())


def test_repeated_null_ids_and_empty_table(spark):
    docs = documents(spark, [(None, "one two"), (None, "one two"), (4, None), (4, ""), (4, "three")])
    rows = A.summary(docs, PAIR).collect()
    assert sorted((r.doc_id is None, r.n_a > 0) for r in rows) == [(False, False), (False, False), (False, True), (True, True), (True, True)]
    assert A.summary(docs.where("false"), PAIR).count() == 0 and A.groups(docs.where("false"), PAIR).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.randoms(use_true_random=False), st.integers(1, 9))
def test_pieces_equal_one_merge(sizes, r, steps):
    a = np.cumsum(sizes, dtype=np.int64)
    b = np.array(sorted({x for x in range(1, int(a[-1])) if r.random() < 0.5} | {int(a[-1])}) if sizes else [], np.int64)
    want, i, j = [], 0, 0
    while i < len(a):
        want.append((i, j, a[i] == b[j]))
        i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
    assert [tuple(x) for x in zip(*A.links(a, b, steps))] == want
    cuts = np.arange(len(a) + len(b) + 1)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert A.diagonals(a, b, cuts).tolist() == [sum(s == 0 for _, s in merged[:k]) for k in cuts]


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in queries.QUERIES["op13_token_align"](spark, SF).collect()}
    assert len(rows) == len(texts)
    for (i, _), (ia, ra, ib, rb) in zip(texts, encoded([t for _, t in texts])):
        common = len({e for _, e in ra} & {e for _, e in rb})
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_groups, rows[i].n_links) == (len(ia), len(ib), common, len(ia) + len(ib) - common)
