"""Benchmark words in documents: exact windows of an item found by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). A window is a set
of word shingles; to contain it, a document must hold every shingle, so one necessary prefix token is
enough: the rarest one, by its count over all documents. Documents meet the prefix tokens, a hit fixes
where the window would have to start (positional bound) and end (length bound), and the words of that
place are compared with the window by two independent 64-bit hashes of all its words.

Two passes over the documents and no shuffle of them: one counts the benchmark's shingles, one finds and
verifies. The benchmark is taken in blocks of about ``block_words`` words (one block up to a million
words, about 100 MB on the driver and in a task; an item is not divided). Of several blocks each is searched before
the next is built and leaves only the hits in the shared folder, so driver and tasks hold one block whatever the
benchmark's size; the hits are united per text, on which alone they depend (by 128 bits of it).

Null and empty texts have no words; null items are no items. Rows are answered one by one, also those that share
a doc_id or have none; repeated item texts count as one item per item_id.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.columns import batch, carried, id_and_text, mapped, unpacked
from tickloom.session import cut

WINDOW = 13
SHINGLE = 3
SALT = 0xD6E8FEB86659FD93
U64 = np.uint64


class Items(NamedTuple):
    """Windows of one block of the benchmark, sorted by hash."""
    size: int             # words of a window
    hash: np.ndarray      # of distinct windows, ascending
    check: np.ndarray     # second hash
    shingles: np.ndarray  # windows x shingles of each
    owner_at: np.ndarray  # where the window's items begin in owners
    owners: np.ndarray    # item ids


class Prefix(NamedTuple):
    token: np.ndarray   # distinct prefix tokens, ascending
    at: np.ndarray      # where the token's windows begin
    window: np.ndarray  # index into Items.hash
    offset: np.ndarray  # position of the token in the window


def _wordlist(texts: pa.Array) -> T.Words:
    return T.words(*T.buffers(texts), T.ALNUM, T.LOWER)


def _gathered(h: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of the ``size`` words from each position."""
    out = np.zeros(len(at), U64)
    for j in range(size):
        out = out * U64(salt | 1) + h[at + j]
    return T.mix(out + U64(size))


def item_windows(ids: np.ndarray, texts: pa.Array, window: int = WINDOW) -> list[Items]:
    """One entry per window length."""
    w = _wordlist(texts)
    n = T.counts_by(w.doc, len(texts))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = []
    for size in sorted({min(int(x), window) for x in n[n > 0]}):
        docs = np.flatnonzero(n >= window) if size == window else np.flatnonzero(n == size)
        many = n[docs] - size + 1
        at, owner = T.spans(first[docs], many), np.repeat(ids[docs], many)
        h, c = _gathered(w.hash, at, size, SALT), _gathered(w.hash, at, size, T._BASE)
        order = np.lexsort((owner, h))
        h, c, at, owner = h[order], c[order], at[order], owner[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        k = min(SHINGLE, size)
        s = np.stack([_gathered(w.hash, at[new] + j, k, SALT + 2) for j in range(size - k + 1)], axis=1)
        out.append(Items(size, h[new], c[new], s, np.concatenate((np.flatnonzero(new), [len(h)])), owner))
    return out


def prefixes(items: Items, counts: dict[int, int]) -> Prefix:
    """The rarest shingle of every window; ties go to the smaller hash, so overlapping windows agree."""
    flat = items.shingles.ravel()
    freq = np.array([counts.get(int(x), 0) for x in flat], np.int64).reshape(items.shingles.shape)
    least = freq == freq.min(axis=1, keepdims=True)
    best = np.where(least, items.shingles, ~U64(0)).argmin(axis=1)
    best = np.where(least[np.arange(len(best)), best], best, least.argmax(axis=1))
    token = items.shingles[np.arange(len(best)), best]
    order = np.argsort(token, kind="stable")
    token, window, offset = token[order], order, best[order]
    new = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    return Prefix(token[new], np.concatenate((np.flatnonzero(new), [len(token)])), window, offset)


class Member:
    """Membership in a sorted array of hashes, with a bit table in front of the search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.zeros(1 << 20, bool)
        self.bits[keys >> U64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hit, and the index of the key each hits."""
        at = np.flatnonzero(self.bits[h >> U64(44)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[i] == h[at]
        return at[ok], i[ok]


def _pieces(b: pa.RecordBatch):
    offs = T.buffers(b.column(1))[1]
    for lo, hi in T.slices(offs):
        yield b.slice(lo, hi - lo)


def _shingles(w: T.Words, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions inside one text, and hashes, of the shingles of windows of this size."""
    k = min(SHINGLE, size)
    if len(w.hash) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(len(w.hash) - k + 1)
    at = at[w.doc[at] == w.doc[at + k - 1]]
    return at, _gathered(w.hash, at, k, SALT + 2)


def shingle_counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """Occurrences in all documents of the wanted shingles (a bounded set)."""
    wanted = np.unique(wanted)

    def run(batches):
        member = Member(wanted)
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for p in _pieces(b):
                w = _wordlist(p.column(1))
                for k in sorted({min(SHINGLE, s) for s in sizes}):
                    _, i = member.find(_shingles(w, None, k)[1])
                    np.add.at(total, i, 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].view(np.int64)), pa.array(total[hit])], ["token", "n"])

    rows = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}


HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                  ("items", pa.list_(pa.int64()))])
HITS_DDL = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<long>"


def _task(blocks: list[tuple[Items, Prefix]]):
    def task():
        tables = [(i, p, Member(p.token)) for i, p in blocks]
        return lambda b: (_find(piece, tables) for piece in _pieces(b))

    return task


def _find(piece: pa.RecordBatch, tables) -> pa.RecordBatch:
    w = _wordlist(piece.column(1))
    n = T.counts_by(w.doc, len(piece))
    first = np.concatenate(([0], np.cumsum(n)))
    starts, ends, owner_doc, owner = [], [], [], []
    for items, prefix, member in tables:
        at, h = _shingles(w, n, items.size)
        hit, token = member.find(h)
        if not len(hit):
            continue
        many = prefix.at[token + 1] - prefix.at[token]
        which = T.spans(prefix.at[token], many)
        pos, win = np.repeat(at[hit], many), prefix.window[which]
        doc = w.doc[pos]
        pos = pos - prefix.offset[which]
        fits = (pos >= first[doc]) & (pos + items.size <= first[doc + 1])  # positional and length bounds
        pos, win, doc = pos[fits], win[fits], doc[fits]
        same = _gathered(w.hash, pos, items.size, SALT) == items.hash[win]
        pos, win, doc = pos[same], win[same], doc[same]
        same = _gathered(w.hash, pos, items.size, T._BASE) == items.check[win]
        pos, win, doc = pos[same], win[same], doc[same]
        starts.append(pos)
        ends.append(pos + items.size)
        many = items.owner_at[win + 1] - items.owner_at[win]
        owner.append(items.owners[T.spans(items.owner_at[win], many)])
        owner_doc.append(np.repeat(doc, many))
    hits, found = [[] for _ in range(len(piece))], [[] for _ in range(len(piece))]
    if starts:
        s, e = np.concatenate(starts), np.concatenate(ends)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, s, 1)
        np.add.at(cover, e, -1)
        inside = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
        lo, hi = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        for a, z in zip(lo, hi):
            while a < z:  # a run may go on from one text into the next
                d = int(w.doc[a])
                stop = min(int(z), int(first[d + 1]))
                hits[d].append({"start": int(a - first[d]), "end": int(stop - first[d])})
                a = stop
        pairs = np.unique(np.stack([np.concatenate(owner_doc), np.concatenate(owner)]), axis=1)
        for d, i in zip(*pairs.tolist()):
            found[d].append(i)
    return batch(HITS, doc_id=piece.column(0), n_words=n, hits=hits, items=found)


def _items(benchmark: DataFrame, block_words: int, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    """The items, and in how many blocks they are taken."""
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    bench = bench.where("item_id is not null and text is not null")
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // 2
    return bench, max(1, -(-size // block_words))


def _block(docs: DataFrame, bench: DataFrame, k: int, n_blocks: int, window: int) -> list[tuple[Items, Prefix]]:
    """The windows and prefix tokens of one block of the benchmark."""
    block = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).toArrow()
    per_size = item_windows(block.column(0).to_numpy(), block.column(1).combine_chunks(), window) if len(block) else []
    if not per_size:
        return []
    counts = shingle_counts(docs, np.concatenate([i.shingles.ravel() for i in per_size]), [i.size for i in per_size])
    return [(i, prefixes(i, counts)) for i in per_size]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 128 bits of the text."""
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _block_hits(docs: DataFrame, bench: DataFrame, k: int, n_blocks: int, window: int) -> DataFrame:
    """One row per text in which a window of the block occurs, written to the shared folder."""
    found = carried(_keyed(docs), _task(_block(docs, bench, k, n_blocks, window)), HITS_DDL).where(F.size("hits") > 0)
    found = found.select(F.col("row.t1").alias("t1"), F.col("row.t2").alias("t2"), "n_words", "hits", "items")
    return cut(found.groupBy("t1", "t2").agg(*(F.first(c).alias(c) for c in ("n_words", "hits", "items"))))


def _text_hits(docs: DataFrame, bench: DataFrame, n_blocks: int, window: int) -> DataFrame:
    """t1, t2, n_words, hits and items of the texts with hits, over all blocks."""
    every = _block_hits(docs, bench, 0, n_blocks, window)
    for k in range(1, n_blocks):
        every = every.unionByName(_block_hits(docs, bench, k, n_blocks, window))
    merged = every.groupBy("t1", "t2").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
                                           F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    union = F.aggregate(  # overlapping ranges become one
        F.array_sort("hits"), F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end >= x.start), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(acc, F.lit(-1)).start.alias("start"),
                             F.greatest(F.try_element_at(acc, F.lit(-1)).end, x.end).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    return merged.withColumn("hits", union)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1_000_000,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, hits (word ranges, disjoint), items (ids of items with an occurring window)."""
    docs = id_and_text(docs, id_col, text_col)
    bench, n_blocks = _items(benchmark, block_words, item_col, item_text)
    if n_blocks == 1:
        return mapped(docs, _task(_block(docs, bench, 0, 1, window)), HITS_DDL)
    found = _text_hits(docs, bench, n_blocks, window).drop("n_words").withColumnsRenamed({"hits": "h", "items": "i"})
    rows = carried(_keyed(docs), _task([]), HITS_DDL).select(F.col("row.t1").alias("t1"), F.col("row.t2").alias("t2"), "doc_id", "n_words", "hits", "items")
    return rows.join(found, ["t1", "t2"], "left").select(
        "doc_id", "n_words", F.coalesce("h", "hits").alias("hits"), F.coalesce("i", "items").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1_000_000, share: int = 20,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated (fewer than 1/share of their words hit)."""
    texts = id_and_text(docs, id_col, text_col)
    bench, n_blocks = _items(benchmark, block_words, item_col, item_text)
    n_hit = F.aggregate("hits", F.lit(0), lambda acc, x: acc + x.end - x.start)
    if n_blocks == 1:
        rows = carried(docs, _task(_block(texts, bench, 0, 1, window)), HITS_DDL, id_col, text_col)
        return unpacked(rows.where((n_hit == 0) | (share * n_hit < F.col("n_words"))), docs)
    bad = _text_hits(texts, bench, n_blocks, window).where((n_hit > 0) & (share * n_hit >= F.col("n_words"))).select("t1", "t2")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = _keyed(docs.select(row, F.col(text_col).cast("string").alias("text")))
    return unpacked(rows.join(bad, ["t1", "t2"], "left_anti"), docs)


def digest(found: DataFrame, share: int = 20) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and the verdict: contaminated if at least 1/share of the words are hit."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                hit = sum(x["end"] - x["start"] for x in r["hits"])
                ids = ",".join(sorted(map(str, r["items"])))
                rows.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": hit, "n_items": len(r["items"]),
                             "items_sha256": hashlib.sha256(ids.encode()).hexdigest(),
                             "contaminated": hit > 0 and share * hit >= r["n_words"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
