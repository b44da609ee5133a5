"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in the whole corpus.

A byte-level BPE (A) reads a space and the text, a piece BPE (B) the text (it adds the space). Both token sequences cut the same
bytes, so the byte offsets where tokens end are two sorted lists, and merging them gives everything: each distinct end is one
overlap (the A and the B token around it), each common end closes a group.

1. ``encode`` packs some megabytes of texts with their ids into one row, a chunk, and the chunks are written once. A
   works on single words, so a task looks up words that it has met; where that may differ from encoding the whole text
   (rare characters, another model), the whole text is encoded.
2. The merge of a chunk's end lists is cut along diagonals into pieces of equal work (``diagonals``): a binary search finds how many
   A ends come before each cut. Pieces know nothing of each other (``overlaps``); where a cut falls between two equal
   ends, their link is counted by the first piece and its group is closed when the pieces are put together (``links``).
3. ``pair_counts`` adds up links per id pair, counted inside each chunk first, so a frequent pair is one row per chunk.
4. ``summary`` brings the counts of its distinct pairs back to each chunk, by joins on the pair and on the chunk, and answers
   every document. ``groups`` returns the groups themselves.

Texts that are null, empty or not reproduced byte by byte by one of the tokenizers have no tokens and are answered with zeros.
Strings of special tokens are ordinary text. Rows that share an id or have none are answered one by one; other columns are not
read. An empty table gives an empty result. One text is one row and must fit a task. Ids have 32 bits.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.columns import id_and_text
from tickloom.llm.text import buffers, slices
from tickloom.session import cut

CHUNK = 1 << 20  # bytes of text
REMEMBERED = 1 << 17  # words
LONGEST = 8  # characters of a remembered word: long ones seldom come again

# Ranges of characters whose kind (letter, number, space) has long been settled in every Unicode version.
SETTLED = [(0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x45F), (0x2010, 0x2027),
           (0x2030, 0x205E), (0x20A0, 0x20B5), (0x2190, 0x21FF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF)]
STEPS = 1 << 16  # merge steps of a piece


class Pair(NamedTuple):
    """The files of both tokenizers, as bytes: a few megabytes that go to every task."""

    a: bytes
    b: bytes


def load(a_path: str, b_path: str) -> Pair:
    """A: a byte-level BPE in the JSON of the tokenizers library; B: a sentencepiece model with byte fallback."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return Pair(a.read(), b.read())


def _class(kind: str) -> str:
    """The settled characters of a kind (first letter of the category), for a character class of a pattern."""
    return "".join(re.escape(chr(c)) for lo, hi in SETTLED for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] == kind)


@functools.cache
def word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Texts of settled characters only; words of A (the split before the merges of its vocabulary)."""
    letter, number = _class("L"), _class("N")
    return (re.compile("[" + "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi))}" for lo, hi in SETTLED) + "]*"),
            re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"))


class Memory:
    """Packed ids by word."""

    def __init__(self, encode: Callable[[list[str]], list[bytes | None]]):
        self.known: dict[str, bytes | None] = {}
        self.encode = encode

    def packed(self, texts: list[list[str]]) -> list[bytes | None]:
        """The ids of each list of words; words not met before are encoded together. None if a word is not reproduced."""
        distinct = set().union(*texts)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(distinct)
        self.known.update(zip(new, self.encode(new)))
        lists = [[self.known[w] for w in words] for words in texts]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return [None if None in x else b"".join(x) for x in lists]


class Tools:
    """Encoders and token bytes in a worker."""

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_buffer(pair.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pair.b)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [i for i in range(256) if i not in printable]
        byte = {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(others)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id with what follows it: , | and ;
        self.words = [[np.array([f"{i}{c}" for i in range(len(t))], object) for c in ends]
                      for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.code = "H" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        split = self.a.pre_tokenizer
        self.a_splits = self.a.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.by_a = Memory(self.encoded_a)

    def _checked(self, ids: list[int], token_bytes: list[bytes], data: bytes) -> bytes | None:
        """Packed ids, if their bytes are the text's."""
        return array(self.code, ids).tobytes() if b"".join([token_bytes[i] for i in ids]) == data else None

    def encoded_a(self, texts: list[str]) -> list[bytes | None]:
        found = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [self._checked(e.ids, self.a_bytes, t.encode()) for t, e in zip(texts, found)]

    def encoded_b(self, texts: list[str]) -> list[bytes | None]:
        """Each text starts with the space that the encoder adds."""
        found = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [self._checked(ids, self.b_bytes, t.encode()) for t, ids in zip(texts, found)]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of A and of B for each text; empty where the bytes are not the text's."""
        settled, words_a = word_patterns()
        out = [(b"", b"")] * len(texts)
        which = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in which]
        usual = [self.a_splits and settled.fullmatch(t) is not None for t in spaced]
        a = self.by_a.packed([words_a.findall(t) if by_word else [] for t, by_word in zip(spaced, usual)])
        a = [x if by_word else self.encoded_a([t])[0] for t, x, by_word in zip(spaced, a, usual)]
        for i, x, y in zip(which, a, self.encoded_b(spaced)):
            if x is not None and y is not None:
                out[i] = x, y
        return out


@functools.lru_cache(1)
def tools(pair: Pair) -> Tools:
    return Tools(pair)


# The merge of two sorted lists of ends.


def diagonals(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of the first ``steps`` ends of the merge are from a (of equal ends a's comes first), by binary search for each."""
    lo, hi = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        open_ = lo < hi
        first = a[np.where(open_, mid, 0)] <= b[np.where(open_, steps - 1 - mid, 0)]
        lo, hi = np.where(open_ & first, mid + 1, lo), np.where(open_ & ~first, mid, hi)
    return lo


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: its distinct ends, the tokens of a and b around each, and whether both end there."""
    x, y = a[i0:i1], b[j0:j1]
    ends = np.concatenate((x, y))
    ends.sort(kind="stable")  # merges the two runs
    new = np.ones(len(ends), bool)
    new[1:] = ends[1:] != ends[:-1]
    at = np.flatnonzero(new)
    common = np.diff(np.append(at, len(ends))) == 2
    ends = ends[at]
    return ends, i0 + np.searchsorted(x, ends), j0 + np.searchsorted(y, ends), common


def links(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of a and b of every overlap in order, and whether it closes a group; a and b are ascending ends of the same bytes."""
    cuts = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    i = diagonals(a, b, cuts)
    j = cuts - i
    pieces = [overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1]) for k in range(len(cuts) - 1)]
    out, last = [], None
    for ends, ai, bi, common in pieces:
        if last == ends[0]:  # the cut parted two equal ends
            out[-1][2][-1] = True
            ends_left = slice(1, None)
        else:
            ends_left = slice(None)
        last = ends[-1]
        if len(ends[ends_left]):
            out.append((ai[ends_left], bi[ends_left], common[ends_left]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none.astype(bool))


# Chunks of documents.

CHUNKS = "chunk long, ids array<long>, n_a array<int>, n_b array<int>, a binary, b binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int32())), ("n_b", pa.list_(pa.int32())),
                          ("a", pa.binary()), ("b", pa.binary())])


def encode(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents with the ids of both tokenizers, written once."""
    def run(batches):
        tool, part, done, zstd = tools(pair), TaskContext.get().partitionId(), 0, pa.Codec("zstd", 3)
        for batch in batches:
            for lo, hi in slices(buffers(batch.column(1))[1], CHUNK):
                a, b = zip(*tool.encode(batch.column(1).slice(lo, hi - lo).to_pylist()))
                yield pa.RecordBatch.from_pydict({
                    "chunk": [(part << 32) + done], "ids": [batch.column(0).slice(lo, hi - lo).to_pylist()], "n_a": [[len(x) // tool.kind.itemsize for x in a]],
                    "n_b": [[len(x) // tool.kind.itemsize for x in b]], "a": [zstd.compress(b"".join(a), asbytes=True)], "b": [zstd.compress(b"".join(b), asbytes=True)]}, schema=CHUNK_SCHEMA)
                done += 1

    return cut(id_and_text(docs, id_col, text_col).mapInArrow(run, CHUNKS))


class Aligned:
    """The overlaps of one chunk."""

    def __init__(self, tool: Tools, t: pa.Table | pa.RecordBatch, row: int = 0):
        self.n_a, self.n_b = (np.array(t[c][row].as_py(), np.int64) for c in ("n_a", "n_b"))
        self.a, self.b = (self._ids(tool, t[c][row], int(n.sum())) for c, n in (("a", self.n_a), ("b", self.n_b)))
        self.ids = t["ids"][row].values if t["ids"][row].is_valid else pa.array([], pa.int64())
        self.a_ends, self.b_ends = np.cumsum(tool.a_len[self.a]), np.cumsum(tool.b_len[self.b])
        self.ai, self.bi, self.closes = links(self.a_ends, self.b_ends)
        self.doc = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.ai]
        self.pairs = (self.a[self.ai] << 32) | self.b[self.bi]

    @staticmethod
    def _ids(tool: Tools, packed: pa.Scalar, n: int) -> np.ndarray:
        data = pa.Codec("zstd").decompress(packed.as_buffer(), n * tool.kind.itemsize) if n else b""
        return np.frombuffer(data, tool.kind).astype(np.int64)

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sums over the links of each document, in whole numbers."""
        if values is None:
            return np.bincount(self.doc, minlength=len(self.n_a)).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
        at = np.concatenate(([0], np.cumsum(self.per_doc())))
        return total[at[1:]] - total[at[:-1]]

    def token_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group, counted through the chunk, of every token of A and of B."""
        group = np.cumsum(self.closes) - self.closes
        return (group[np.searchsorted(self.ai, np.arange(len(self.a)))], group[np.searchsorted(self.bi, np.arange(len(self.b)))])

    def digests(self, tool: Tools) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document, empty without tokens."""
        ga, gb = self.token_groups()
        n = int(self.closes.sum())
        in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, group, at, (inside, last) in ((self.a, ga, np.cumsum(in_b) - in_b, tool.words[0]), (self.b, gb, np.cumsum(in_a), tool.words[1])):
            ends = np.ones(len(ids), bool)
            ends[:-1] = group[1:] != group[:-1]
            out[np.arange(len(ids)) + at[group]] = np.where(ends, last[ids], inside[ids])
        cuts = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [hashlib.sha256("".join(out[lo:hi].tolist())[:-1].encode()).hexdigest() if hi > lo else "" for lo, hi in zip(cuts, cuts[1:])]


def pair_counts(chunks: DataFrame, pair: Pair) -> tuple[DataFrame, DataFrame]:
    """The distinct id pairs of every chunk (chunk, pair), written once; and of the corpus: pair, a, b, n (links), best (the most
    frequent of its b). ``pair`` is a x 2^32 + b."""
    schema = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("m", pa.int64())])

    def run(batches):
        tool = tools(pair)
        tool.by_a.known.clear()  # the words of the stage before
        for batch in batches:
            for row in range(len(batch)):
                found, m = np.unique(Aligned(tool, batch, row).pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch["chunk"][row], len(found)), pa.array(found), pa.array(m, pa.int64())], schema=schema)

    in_chunks = cut(chunks.mapInArrow(run, "chunk long, pair long, m long"))
    total = in_chunks.groupBy("pair").agg(F.sum("m").alias("n"))
    total = total.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.expr("cast(pair & 4294967295 as int)").alias("b"), "n")
    # a group of this window is at most the ids of A
    return in_chunks.select("chunk", "pair"), total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summary(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, links with the most frequent partner of their B id, corpus-wide counts
    summed over the links, and the digest of the groups."""
    chunks = encode(docs, pair, id_col, text_col)
    in_chunks, counts = pair_counts(chunks, pair)
    found = in_chunks.join(counts.select("pair", "n", "best"), "pair")

    def answer(t: pa.Table, counted: pa.Table) -> pa.Table:
        tool = tools(pair)
        x = Aligned(tool, t)
        key = counted["pair"].to_numpy()
        order = np.argsort(key)
        at = order[np.searchsorted(key, x.pairs, sorter=order)] if len(x.pairs) else np.zeros(0, np.int64)
        n, best = counted["n"].to_numpy()[at], counted["best"].to_numpy()[at]
        return pa.table({"doc_id": x.ids, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.per_doc(x.closes), "n_links": x.per_doc(),
                         "n_best": x.per_doc(best), "count_sum": x.per_doc(n), "groups_sha256": pa.array(x.digests(tool), pa.string())})

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(answer, SUMMARY)


def groups(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group (from 0), start and end (bytes of a space and the text), a and b (arrays of ids) of every group."""
    def parts(x: Aligned) -> pa.RecordBatch:
        (ga, gb), n = x.token_groups(), int(x.closes.sum())

        def lists(ids, group):
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)), pa.int32()), pa.array(ids, pa.int32()))

        ends = x.a_ends[x.ai[x.closes]]
        starts = np.concatenate(([0], ends[:-1])) if n else ends
        doc = x.doc[x.closes]
        first = np.searchsorted(doc, np.arange(len(x.n_a)))
        base = np.concatenate((starts, [0]))[first]
        ids = x.ids.take(pa.array(doc))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(n) - first[doc]), pa.array(starts - base[doc]), pa.array(ends - base[doc]),
                                           lists(x.a, ga), lists(x.b, gb)], ["doc_id", "group", "start", "end", "a", "b"])

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                yield parts(Aligned(tools(pair), batch, row))

    return encode(docs, pair, id_col, text_col).mapInArrow(run, "doc_id long, group long, start long, end long, a array<int>, b array<int>")
