"""Order MinHash fingerprints: sensitive to the order of the text, as edit distance is.

Every k-mer of a text gets its occurrence number (the first, second, ... time it is seen), so repeated
k-mers are distinct elements. Each element is hashed once and falls into one of ``SLOTS`` bins; a bin
selects its ``PICK`` minimal elements, lists them in text order and hashes that tuple. A signature
is the row of tuple hashes; the likeness of two is the share of equal slots. Bins that hold fewer
elements borrow from the following bins, so short texts have a full signature too. A text shorter than
k is one k-mer; a text without characters has the empty signature (all zero), like only to itself.

One sort by k-mer and one by hash per text, nothing quadratic. Null texts are empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.columns import id_and_text, partitions

K = 6
SLOTS = 64
PICK = 2
U64 = np.uint64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)


def _ranked(h: np.ndarray) -> np.ndarray:
    """Occurrence number of every element among its equals, in text order."""
    n = len(h)
    bits = U64(max(1, int(n - 1).bit_length()))
    low = (U64(1) << bits) - U64(1)
    packed = np.sort((h & ~low) | np.arange(n, dtype=U64))  # equal k-mers side by side, in text order
    key = packed & ~low
    same = np.concatenate(([False], key[1:] == key[:-1]))
    run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.zeros(n, U64)
    rank[(packed & low).astype(np.int64)] = run
    return rank


def signature(codes: np.ndarray, k: int = K, slots: int = SLOTS, pick: int = PICK) -> np.ndarray:
    """``slots`` 16-bit tuple hashes of a text given as code points; zero only for the empty text."""
    n = len(codes) - k + 1
    if not len(codes):
        return np.zeros(slots, np.uint16)
    if n < 1:
        h, n = np.array([int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little")], U64), 1
    else:
        h = codes[:n].copy()
        for j in range(1, k):
            h *= U64(0x100000001B3)
            h += codes[j:n + j]
        h = T.mix(h)
    if n > 1:
        h = T.mix(h + _ranked(h) * U64(0x9E3779B97F4A7C15))
    bits = U64(max(1, int(n - 1).bit_length()))
    low = (U64(1) << bits) - U64(1)
    packed = np.sort((h & ~low) | np.arange(n, dtype=U64))
    bin_of = ((packed >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)
    first = np.searchsorted(bin_of, np.arange(slots))
    at = first[:, None] + np.arange(pick)  # a thin bin goes on with the next bins, the last with the first
    pos = (packed[at % n] & low).astype(np.int64)
    pos.sort(axis=1)  # text order
    out = np.full(slots, 0x2545F4914F6CDD1D, U64)
    for j in range(pick):
        out = T.mix(out * U64(0x100000001B3) + h[pos[:, j]])
    return np.maximum(out >> U64(48), U64(1)).astype(np.uint16)


def _raw(text: str | None, **params) -> bytes:
    return signature(_codes(text or ""), **params).astype(">u2").tobytes()


def _alike(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")
    return float((x == y).mean()) if len(x) else 1.0


def fingerprint(text: str | None, **params) -> str:
    return _raw(text, **params).hex()


def likeness(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints of one length."""
    return _alike(bytes.fromhex(a), bytes.fromhex(b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """doc_id and fingerprint of every text; no shuffle."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t, **params) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
                    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDITED_DDL = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
              "near_edited double, near_next double")


def _edited(doc_id: int, text: str, prints: bytes, following: str, following_prints: bytes) -> dict:
    quarter = len(text) // 4
    edited = text[:len(text) - quarter] + following[:quarter]
    ep = _raw(edited)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(),
            "fingerprint": prints, "edited_fingerprint": ep, "near_edited": _alike(prints, ep), "near_next": _alike(prints, following_prints)}


def with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited form and against the next text by id (after the last: the first).

    Rows are range-partitioned by id and sorted, so the next text is the next row; a partition's last
    row, and its first as a neighbour for others, are kept aside (two rows per partition) and paired by
    partition number. Rows that share an id follow one another in the order of their text's hash.
    Rows with a null id come first.
    """
    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(docs), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    names = EDITED.names

    def run(batches):
        before = part = None
        nothing = {n: None for n in names}
        schema = pa.schema([*EDITED, ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
        for b in batches:
            for sub in T.slices(T.buffers(b.column(1))[1]):
                rows = b.slice(sub[0], sub[1] - sub[0])
                out = []
                for i, t, p in zip(*(c.to_pylist() for c in rows.columns)):
                    prints = _raw(t)
                    if before is None:
                        out.append({**nothing, "doc_id": i, "part": p, "kind": "first", "text": t, "fingerprint": prints})
                    else:
                        out.append({**_edited(*before, t, prints), "part": p, "kind": "whole", "text": None})
                    before, part = (i, t, prints), p
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if before is not None:
            last = {**nothing, "doc_id": before[0], "part": part, "kind": "last", "text": before[1], "fingerprint": before[2]}
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    from tickloom.session import cut

    paired = cut(ordered.mapInArrow(run, f"{EDITED_DDL}, part int, kind string, text string"))
    whole = paired.where("kind = 'whole'").select(*names)
    firsts = paired.where("kind = 'first'").select("part", "doc_id", "text", "fingerprint")
    lasts = paired.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
    parts = firsts.select("part")  # one row per partition that has rows
    ring = parts.withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), parts.agg(F.min("part")).scalar()))
    edge = (lasts.join(ring, "part")
            .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_prints")), "next_part")
            .select("doc_id", "text", "fingerprint", "next_text", "next_prints"))

    def edges(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([_edited(*r.values()) for r in b.to_pylist()], schema=EDITED)

    every = whole.unionByName(edge.mapInArrow(edges, EDITED_DDL))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
