"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has a node between any two bytes and an edge for every vocabulary piece (and, with a
weight that only matters where no piece fits, for every single byte). The forward pass sums the weights of
all paths to each node; the backward pass draws one path from the end, edge by edge, with exactly
the path's probability. Random numbers are hashes of (seed, row key, byte position), so a row's
segmentation depends on nothing but its key, its text and the parameters: not on partitions, batches or retries.

Piece weights follow the vocabulary's merge order (Zipf: 1 / (rank + 2)), raised to ``alpha``: 1 stays near
the most likely path, towards 0 all paths become alike. ``alpha=None`` takes the most likely path (ties:
the longer last piece).

The lattice falls apart wherever no piece holds the two neighbouring bytes (between words, mostly), and the
distribution with it. So each distinct part of a batch is filtered once and its occurrences are sampled
from the shared tables. Decoding joins the bytes of the pieces and drops the one space put before the text.

Texts are processed whole in pieces of about a megabyte, without shuffles; null texts have null ids and
decode to null, empty ones have none. The vocabulary is read on the driver and sent to the tasks (32,000 short strings).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.columns import carried, mapped

U64 = np.uint64
BYTE_WEIGHT = -60.0
SPACE = 0x20


class Vocabulary:
    """Pieces as bytes with a blank for the word mark, and their lookup tables."""

    def __init__(self, pieces: list[bytes | None], bytes_of: list[int], weights: np.ndarray):
        self.pieces = [p or b"" for p in pieces]
        self.byte_id = np.array(bytes_of)  # id of each single byte
        self.weight = weights
        for b, i in enumerate(bytes_of):
            self.pieces[i] = bytes([b])
        lookup: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            if p and i not in set(bytes_of):
                for k in range(1, len(p)):
                    lookup.setdefault(p[:k], -1)
                lookup[p] = i
        self.joins = np.zeros((256, 256), bool)
        for p in lookup:
            if len(p) > 1:
                self.joins[p[-2], p[-1]] = True
        keys = list(lookup)
        offs = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        h = _hashes(np.frombuffer(b"".join(keys), np.uint8), offs[:-1], offs[1:])
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(list(lookup.values()))[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> U64(42)] = True
        self.longest = max(map(len, keys))
        self.data = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.offs = np.concatenate(([0], np.cumsum([len(p) for p in self.pieces])))

    def join(self, ids: np.ndarray) -> bytes:
        """The text of one row of ids."""
        size = self.offs[ids + 1] - self.offs[ids]
        return self.data[T.spans(self.offs[ids], size)].tobytes()[1:]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece or the beginning of one, and the piece's id or -1."""
        at = np.flatnonzero(self.bits[h >> U64(42)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[i] == h[at]
        return at[ok], self.ids[i[ok]]


def load(path: str, alpha: float | None = 1.0) -> Vocabulary:
    """Vocabulary of a SentencePiece model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes | None] = []
    bytes_of = [0] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_of[int(p[3:5], 16)] = i
        pieces.append(None if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else p.replace("▁", " ").encode())
    rank = -np.array([sp.get_score(i) for i in range(len(pieces))])
    weights = -np.log(np.maximum(rank, 0) + 2.0) * (1.0 if alpha is None else alpha)
    weights[bytes_of] = BYTE_WEIGHT
    return Vocabulary(pieces, bytes_of, weights)


def _sums(data: np.ndarray) -> np.ndarray:
    v = data.astype(U64)
    v += U64(1)
    v *= T._powers(len(data))[0][:len(data)]
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(v, out=out[1:])
    return out


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = _sums(data)
    return T.mix((s[end] - s[start]) * T._powers(len(data) + 1)[1][start])


def _lattice(v: Vocabulary, data: np.ndarray, offs: np.ndarray, best: bool):
    """Forward-filtered lattices of distinct byte strings; node ``offs[c] + c + j`` lies after j bytes of string c.

    Returns first and last node of every string, and of every edge, sorted by the node it ends in: the node
    it starts from, its piece, its end node, and the cumulative probability among the edges into that node.
    """
    n = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    left = (offs[1:][owner] - np.arange(len(data))).astype(np.int32)  # bytes to the end of the string
    s, inv = _sums(data), T._powers(len(data) + 1)[1]
    alive = np.arange(len(data))
    at, length, piece = [alive], [np.ones(len(data), np.int64)], [v.byte_id[data]]
    for k in range(1, v.longest + 1):
        alive = alive[left[alive] >= k]
        i, ids = v.find(T.mix((s[alive + k] - s[alive]) * inv[alive]))
        alive = alive[i]
        hit = ids >= 0
        at.append(alive[hit])
        length.append(np.full(int(hit.sum()), k))
        piece.append(ids[hit])
        if not len(alive):
            break
    at, length, piece = np.concatenate(at), np.concatenate(length), np.concatenate(piece)
    a = at + owner[at]
    order = np.argsort(((a + length) << 6) | length, kind="stable")  # a byte has two edges if it is a piece, too
    a, length, piece = a[order], length[order], piece[order]
    b = a + length
    first, last = offs[:-1] + np.arange(n), offs[1:] + np.arange(n)
    w = v.weight[piece]
    alpha = np.full(len(data) + n, -np.inf)
    alpha[first] = 0.0
    new = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))  # the edges into one node are neighbours
    many = np.diff(np.append(new, len(b)))
    depth = (b[new] - first[owner[at[order[new]]]]).astype(np.int32)
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(1, int(size.max(initial=0)) + 2))
    for j in range(len(bounds) - 1):
        g = by_depth[bounds[j]:bounds[j + 1]]
        e = T.spans(new[g], many[g])
        begin = np.cumsum(many[g]) - many[g]
        x = alpha[a[e]] + w[e]
        top = np.maximum.reduceat(x, begin)
        alpha[b[new[g]]] = top if best else top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many[g])), begin))
    p = alpha[a] + w - alpha[b]
    if best:
        later = np.repeat(np.maximum.reduceat(np.where(p >= 0, np.arange(len(b)), -1), new), many)
        p = (np.arange(len(b)) == later).astype(float)
    else:
        p = np.exp(p)
    share = p.copy()  # summed inside each node, so that it does not depend on the other strings
    for k in range(1, int(many.max(initial=0))):
        e = new[many > k] + k
        share[e] += share[e - 1]
    share /= np.repeat(share[new + many - 1], many)
    share[new + many - 1] = 1.0
    return first, last, a, piece, b, share


class Sampler:
    """Lattices of the strings a task has met; started anew when they fill about 100 MB."""

    LIMIT = 5_000_000

    def __init__(self, v: Vocabulary, best: bool):
        self.v, self.best = v, best
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, U64)
        self.first = self.last = np.zeros(0, np.int32)
        self.edge_from = self.edge_piece = np.zeros(0, np.int32)
        self.share = np.zeros(0)  # of an edge and those before it among the edges into its node
        self.begin = np.zeros(1, np.int32)  # where each node's edges begin, and their number
        self.nodes = 0

    def slots(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of each string's lattice, building the missing ones."""
        uniq, rep, which = np.unique(_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.edge_from) > self.LIMIT:
            self.clear()
        i = np.searchsorted(self.hash, uniq)
        known = self.hash[np.minimum(i, len(self.hash) - 1)] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        new = rep[~known]
        if len(new):
            size = (end - start)[new]
            offs = np.concatenate(([0], np.cumsum(size)))
            first, last, a, piece, b, share = _lattice(self.v, data[T.spans(start[new], size)], offs, self.best)
            self.first = np.concatenate((self.first, (first + self.nodes).astype(np.int32)))
            self.last = np.concatenate((self.last, (last + self.nodes).astype(np.int32)))
            self.edge_from = np.concatenate((self.edge_from, (a + self.nodes).astype(np.int32)))
            self.edge_piece = np.concatenate((self.edge_piece, piece.astype(np.int32)))
            self.share = np.concatenate((self.share, share))
            many = np.bincount(b, minlength=int(offs[-1]) + len(new))
            self.begin = np.concatenate((self.begin, (self.begin[-1] + np.cumsum(many)).astype(np.int32)))
            self.nodes += len(many)
            hashes = np.concatenate((self.hash, uniq[~known]))
            slot = np.concatenate((self.slot if len(self.hash) else np.zeros(0, np.int64), np.arange(len(self.first) - len(new), len(self.first))))
            order = np.argsort(hashes)
            self.hash, self.slot = hashes[order], slot[order]
            i = np.searchsorted(self.hash, uniq)
        return self.slot[i][which]

    def _edge(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The first edge into each node whose share is above u, by halving the node's own range (the last share is 1)."""
        lo, hi = self.begin[node], self.begin[node + 1] - 1
        for _ in range(int((hi - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            after = self.share[mid] <= u
            lo, hi = np.where(after, np.minimum(mid + 1, hi), lo), np.where(after, hi, mid)
        return lo

    def sample(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path for each occurrence of lattice ``which``: piece counts, and all pieces in text order."""
        live = np.argsort(which)  # equal strings together: the tables are read in order
        node, first, seed = self.last[which[live]], self.first[which[live]], seed[live]
        steps = []
        while len(live):
            u = (T.mix(seed + (node - first).astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)) * 2.0 ** -53
            e = self._edge(node, u)
            steps.append((live, self.edge_piece[e]))
            node = self.edge_from[e]
            on = np.flatnonzero(node > first)
            live, node, first, seed = live[on], node[on], first[on], seed[on]
        many = np.zeros(len(which), np.int64)
        for i, _ in steps:
            many[i] += 1
        end = np.cumsum(many)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int32)
        for t, (i, piece) in enumerate(steps):
            out[end[i] - 1 - t] = piece
        return many, out


def _encode(sampler: Sampler, keys: np.ndarray, data: np.ndarray, offs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece counts per text, and all pieces."""
    n = len(offs) - 1
    real = np.flatnonzero(np.diff(offs))  # empty texts have no pieces
    if not len(real):
        return np.zeros(n, np.int64), np.zeros(0, np.int32)
    data = np.insert(data, offs[real], SPACE)
    begin = offs[real] + np.arange(len(real))
    cut = np.ones(len(data), bool)
    cut[1:] = ~sampler.v.joins[data[:-1], data[1:]]
    cut[begin] = True
    start = np.flatnonzero(cut)
    end = np.concatenate((start[1:], [len(data)]))
    doc = np.searchsorted(begin, start, "right") - 1
    at = T.mix(T.mix(keys[real].astype(np.int64).view(U64) + U64(seed))[doc] + (start - begin[doc]).astype(U64))
    many, out = sampler.sample(sampler.slots(data, start, end), at)
    count = np.zeros(n, np.int64)
    np.add.at(count, real[doc], many)
    return count, out


def _task(docs: DataFrame, vocabulary: Vocabulary, seed: int, best: bool):
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task():
        sampler = Sampler(sent.value, best)
        return lambda b: _encoded(sampler, b, seed)

    return task


def _encoded(sampler: Sampler, b: pa.RecordBatch, seed: int) -> Iterator[pa.RecordBatch]:
    keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    data, offs = T.buffers(b.column(1))
    for lo, hi in T.slices(offs, T.PIECE):
        count, out = _encode(sampler, keys[lo:hi], data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], seed)
        mask = b.column(1).slice(lo, hi - lo).is_null()
        at = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        ids = pa.ListArray.from_arrays(at, pa.array(out), mask=mask) if mask.true_count else pa.ListArray.from_arrays(at, pa.array(out))
        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, vocabulary: Vocabulary, seed: int = 0, best: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and sampled piece ids of every text."""
    return mapped(docs, _task(docs, vocabulary, seed, best), "doc_id long, ids array<int>", id_col, text_col)


def with_pieces(docs: DataFrame, vocabulary: Vocabulary, seed: int = 0, best: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with columns piece_ids and n_pieces (in place of columns of these names, if there are any)."""
    rows = carried(docs, _task(docs, vocabulary, seed, best), "doc_id long, ids array<int>", id_col, text_col)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("piece_ids", "n_pieces")]
    return rows.select(*own, F.col("ids").alias("piece_ids"), F.size("ids").alias("n_pieces"))


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; the inverse of ``encode``."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = sent.value
        for b in batches:
            ids = b.column(1)
            offs = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy()
            for lo, hi in T.slices(offs, T.PIECE // 2):
                p = flat[offs[lo]:offs[hi]]
                size = v.offs[p + 1] - v.offs[p]
                data = v.data[T.spans(v.offs[p], size)]
                at = np.concatenate(([0], np.cumsum(size)))[offs[lo:hi + 1] - offs[lo]]
                full = np.flatnonzero(np.diff(at))
                data = np.delete(data, at[full])  # the space before each text
                at = at - np.searchsorted(at[full], at, "left")
                mask = ids.slice(lo, hi - lo).is_null()
                texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                texts = texts.filter(pa.array(np.ones(len(at) - 1, bool))) if not mask.true_count else _masked(texts, mask)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), texts], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def round_trip(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_tokens and the SHA-256 of the decoded text (null ids: of nothing, null)."""
    import hashlib

    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = sent.value
        for b in batches:
            ids = b.column(1)
            offs, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            sha = [None if null else hashlib.sha256(v.join(flat[lo:hi])).hexdigest()
                   for null, lo, hi in zip(ids.is_null().to_pylist(), offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(np.diff(offs).astype(np.int64)), pa.array(sha, pa.string())],
                                             ["doc_id", "ids", "n_tokens", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string")


def _masked(texts: pa.Array, mask: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(mask, pa.scalar(None, pa.string()), texts)
