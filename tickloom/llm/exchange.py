"""Sums over all texts for the keys of each text, without a row per key.

Texts are hashed by id into chunks. A chunk's keys (n-gram hashes) are sent, sorted and
difference-coded, to the partition that owns their hash range, and a reply with the global value of each
key comes back in the same order. Both directions are ordinary groupBy shuffles of a few binary rows per
(chunk, partition); the texts themselves are shuffled once, and the plan reuses that exchange for every pass.

Sizes: there are ``4 x spark.sql.shuffle.partitions`` chunks and as many owners as shuffle partitions, so
both hold a constant amount when that setting follows the data. A key has ``BITS`` = 41 bits within its
owner (and log2(owners) more by the choice of the owner), so about one key in a million meets another by
chance at any data size; callers that need exact equality send full 64-bit hashes (``exact=True``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.columns import partitions

U64 = np.uint64
BITS = 41
POSTED = "part int, chunk int, keys binary, vals binary"
POSTED_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, place (the id; for null ids 2^62 and a hash of the text, so that they are many documents after all others)
    and the chunk number, a hash of the place."""
    n = 4 * partitions(docs)
    place = F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    return docs.select("doc_id", "text", place.alias("place")).withColumn("chunk", F.pmod(F.xxhash64("place"), F.lit(n)).cast("int"))


def narrow(keys: np.ndarray, owners: int) -> np.ndarray:
    """64-bit hashes cut to the bits that the exchange compares; order is kept."""
    return keys >> U64(64 - min(64, BITS + owners.bit_length()))


def width(owners: int, exact: bool) -> int:
    return 64 if exact else min(64, BITS + owners.bit_length())


def cuts(keys: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Where each owner's range begins in ascending keys of so many bits."""
    edge = np.array([(i << bits) // owners for i in range(1, owners)], U64)
    return np.concatenate(([0], np.searchsorted(keys, edge), [len(keys)]))


def post(chunk: int, keys: np.ndarray, owners: int, exact: bool, *values: np.ndarray):
    """Rows for the owners: ascending distinct keys, and byte planes of values aligned with them."""
    at = cuts(keys, owners, width(owners, exact))
    rows = {"part": [], "chunk": [], "keys": [], "vals": []}
    for p in np.flatnonzero(np.diff(at)):
        lo, hi = at[p], at[p + 1]
        rows["part"].append(int(p))
        rows["chunk"].append(chunk)
        rows["keys"].append(T.pack_sorted(keys[lo:hi]))
        rows["vals"].append(b"".join(T.planes(v[lo:hi]) for v in values))
    return pa.Table.from_pydict(rows, schema=POSTED_SCHEMA)


def totals(posted: pa.Table) -> pa.Table:
    """Owner's reply: the sum of the posted counts (32 bits) of every key, in the order it was posted."""
    keys = [T.unpack_sorted(k.as_buffer()) for k in posted["keys"]]
    size = [len(k) for k in keys]
    vals = np.concatenate([T.unplanes(v.as_buffer(), np.uint32) for v in posted["vals"]]) if keys else np.zeros(0, np.uint32)
    flat = np.concatenate(keys) if keys else np.zeros(0, U64)
    del keys
    order = np.argsort(flat)
    new = np.ones(len(flat), bool)
    s = flat[order]
    new[1:] = s[1:] != s[:-1]
    del s, flat
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights=vals[order]).astype(np.uint64)
    out = np.empty(len(order), np.uint64)
    out[order] = total[run]
    at = np.concatenate(([0], np.cumsum(size)))
    return pa.Table.from_pydict({"part": posted["part"], "chunk": posted["chunk"], "keys": pa.nulls(len(size), pa.binary()),
                                 "vals": [T.planes(out[at[i]:at[i + 1]]) for i in range(len(size))]}, schema=POSTED_SCHEMA)


def answers(replies: pa.Table, dtype=np.uint64) -> np.ndarray:
    """A chunk's replies in the order of its keys."""
    if not len(replies):
        return np.zeros(0, dtype)
    order = np.argsort(replies["part"].to_numpy())
    return np.concatenate([T.unplanes(replies["vals"][int(i)].as_buffer(), dtype) for i in order])


def exchange(chunks: DataFrame, keys_of: Callable, owners: int, owner: Callable = totals) -> DataFrame:
    """Replies to the keys of every chunk; ``keys_of(chunk number, texts table) -> posted table``."""
    def send(t: pa.Table) -> pa.Table:
        return keys_of(t["chunk"][0].as_py(), t)

    posted = chunks.groupBy("chunk").applyInArrow(send, POSTED)
    return posted.groupBy("part").applyInArrow(owner, POSTED)


def finish(chunks: DataFrame, replies: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """``fn(texts table, replies table) -> table`` for every chunk with its replies."""
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda a, b: fn(a, b), ddl)
