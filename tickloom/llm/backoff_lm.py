"""Stupid-backoff scores of every document under the n-gram counts of all the others.

    S(w | u v) = c(u v w) / c(u v)      if c(u v w) > 0
               = 0.4 * c(v w) / c(v)    else if c(v w) > 0
               = 0.16 * c(w) / N        else if c(w) > 0
               = 0.064 / N              else

All counts leave out the document that is scored (with them every n-gram would be known and nothing would ever
back off). The first word of a text starts at the unigram, the second at the bigram, without a penalty.
``log_score`` is the sum of ln S over the words.

The count table is partitioned by n-gram hash. Documents are taken in chunks; a chunk explodes its n-grams of
all orders, adds up equal ones, and sends one row of sorted hashes and counts to each partition of the
table; the partition adds up the counts of all chunks and answers in the same order (``exchange``). Nothing is pruned, capped
or sampled, and no count goes through the driver. A frequent n-gram is one entry per chunk.

Words are maximal runs without ASCII white space, letters A-Z lower-cased. Null and empty texts have no words,
a score of 0 and a null mean. Rows that share a doc_id are separate documents of one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm import exchange as X
from tickloom.llm import text as T
from tickloom.llm.columns import id_and_text, partitions

U64 = np.uint64
ORDER = 3
BACKOFF = 0.4


def _grams(t: pa.Table, order: int):
    """Word counts per text; per order the n-gram hash that ends at each word (where the text has one there), and the text of each word."""
    data, offs = T.buffers(t["text"])
    h, d = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lo, hi in T.slices(offs):
        w = T.words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], T.NOT_SPACE, T.LOWER)
        h.append(w.hash)
        d.append(w.doc + lo)
    h, d = np.concatenate(h), np.concatenate(d)
    out = []
    for k in range(1, order + 1):
        g = T.windows(h, k)
        at = np.flatnonzero(d[:len(g)] == d[k - 1:]) + k - 1 if len(g) else np.zeros(0, np.int64)
        out.append((at, g[at - k + 1]))
    return T.counts_by(d, len(t)), d, out


TOTAL = T.mix(np.array([0x746F74616C], U64))  # the key under which words are counted


def _table(grams, owners: int):
    """Distinct keys of all orders, their counts in the chunk, and per order the key index of each n-gram."""
    flat = X.narrow(np.concatenate([TOTAL, *(g for _, g in grams)]), owners)
    order = np.argsort(flat)
    s = flat[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    of = np.empty(len(s), np.int32)
    of[order] = np.cumsum(new) - 1
    count = np.diff(np.append(np.flatnonzero(new), len(s)))
    n_words = len(grams[0][0])
    count[of[0]] += n_words - 1
    ends = np.cumsum([1, *(len(g) for _, g in grams)])
    return s[new], count, of[0], [of[a:z] for a, z in zip(ends[:-1], ends[1:])]


def _post(chunk: int, t: pa.Table, order: int, owners: int) -> pa.Table:
    keys, count, _, _ = _table(_grams(t, order)[2], owners)
    return X.post(chunk, keys, owners, False, count.astype(np.uint32))


def _own(index: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """How often each occurrence's n-gram stands in its own text."""
    out = np.ones(len(index), np.int64)
    again = np.flatnonzero(count[index] > 1)  # alone in the chunk: alone in the text
    if len(again):
        pair = index[again].astype(np.int64) * n_docs + doc[again]
        _, inv, many = np.unique(pair, return_inverse=True, return_counts=True)
        out[again] = many[inv]
    return out


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_score", pa.float64()), ("n_unigram", pa.int64())])


def _score(t: pa.Table, replies: pa.Table, order: int, owners: int) -> pa.Table:
    n, d, grams = _grams(t, order)
    _, count, total_at, of = _table(grams, owners)
    total = X.answers(replies).astype(np.int64)
    words = len(d)
    rest = (int(total[total_at]) - n)[d].astype(float)  # words of all other texts
    out = np.full(words, np.nan)
    backed = np.zeros(words, np.int64)
    top = np.zeros(words, np.int64)
    for at, _ in grams[1:]:
        top[at] += 1  # the highest order that the word has, less one
    others = []
    for (at, _), i in zip(grams, of):
        c = np.zeros(words, np.int64)
        c[at] = total[i] - _own(i, d[at], count, len(n))
        others.append(c)
    for k in range(order - 1, 0, -1):
        c = others[k]
        context = np.zeros(words, np.int64)
        context[1:] = others[k - 1][:-1]  # the n-gram before the word
        hit = np.isnan(out) & (c > 0) & (top >= k)
        with np.errstate(divide="ignore"):
            out[hit] = np.log(c[hit] / context[hit]) + (top[hit] - k) * np.log(BACKOFF)
    left = np.isnan(out)
    backed[left] = 1
    c, rest_left = others[0][left], np.maximum(rest[left], 1)
    out[left] = np.where(c > 0, np.log(np.maximum(c, 1) / rest_left) + top[left] * np.log(BACKOFF),
                         np.log(1 / rest_left) + (top[left] + 1) * np.log(BACKOFF))
    sums = np.bincount(d, weights=out, minlength=len(n))
    with np.errstate(invalid="ignore"):
        mean = sums / n
    return pa.Table.from_arrays([t["doc_id"].combine_chunks(), pa.array(n), pa.array(sums), pa.array(mean, pa.float64(), mask=n == 0),
                                 pa.array(np.bincount(d, weights=backed, minlength=len(n)).astype(np.int64))], schema=SCORED)


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, mean_score (per word), n_unigram (words that backed off, or began, at the unigram)."""
    owners = partitions(docs)
    chunks = X.chunked(id_and_text(docs, id_col, text_col))
    replies = X.exchange(chunks, lambda c, t: _post(c, t, order, owners), owners)
    return X.finish(chunks, replies, lambda t, r: _score(t, r, order, owners),
                    "doc_id long, n_words long, log_score double, mean_score double, n_unigram long")
