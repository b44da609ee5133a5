"""Repeated passages by relative Lempel-Ziv parsing against all earlier text.

The reference is the collection itself, in the order (doc_id, position). A document is parsed from left to right into factors:
a factor begins at the first window outside the factors before it that also stands, word for word, at an earlier place, takes that
window's first place as its reference, and goes on as far as the words there stay equal. Factors of one passage may overlap by less
than a window, so that a window across a factor boundary is covered too; every word inside a factor is a repeat.

Index in two exchanges over chunks of documents (see ``exchange``), then parse:

1. Seeds. Each window of ``window`` words has one seed, the place of its smallest hash of ``SEED`` words; equal windows have
   equal seeds. Only seeds are exchanged (about one word in seven), and a window whose seed has one place cannot repeat.
2. Reference blocks. The remaining windows are indexed by full 64-bit hash in the block that owns their range, each with
   its first place (doc_id, position) in every chunk; the block replies with the first place of all and a second hash.
3. Runs. The first place names a window's words, so a document's repeated windows become a few runs of consecutive first
   places. Where the next window's first place lies elsewhere, the chunk joins the runs of the document it is copying: the factor goes
   on while both documents have equal first places. A document's runs reach a chunk once, however many factors ask for them.

A factor's windows, its two boundaries among them, are checked by a second hash against the reference's (80 bits in all). A window
that repeats the document itself counts from its second place on.

Nothing is capped. Null texts and texts with fewer than ``window`` words are left as they are. Rows that share a
doc_id are taken as one document after another in the order of their texts, so their windows count as earlier and later; as a
reference their position is ambiguous, so a factor that copies one of them ends with its run. Rows
without an id come after all others, in the order of a hash of their text; as a factor's reference they are null.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import exchange as X
from tickloom.llm import text as T
from tickloom.llm.columns import id_and_text, partitions
from tickloom.session import cut

U64 = np.uint64
SEED = 8


def _sorted(t: pa.Table) -> pa.Table:
    """The chunk by place (and text, for rows that share an id), so that positions are ordered like places."""
    return t.sort_by([("place", "ascending"), ("text", "ascending")])


def _pieces(t: pa.Table):
    """Bytes and words of a chunk piece by piece; text numbers are those of the piece, which begins at text ``lo``."""
    data, offs = T.buffers(t["text"])
    for lo, hi in T.slices(offs):
        own = data[offs[lo]:offs[hi]]
        yield lo, hi, own, T.words(own, offs[lo:hi + 1] - offs[lo], T.NOT_SPACE)


def _starts(w: T.Words, window: int) -> np.ndarray:
    """First words of the windows that lie in one text."""
    if len(w.hash) < window:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[:len(w.doc) - window + 1] == w.doc[window - 1:])


def _seeds(w: T.Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed of each window, and the hashes of the distinct places that are a seed."""
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64)
    size = min(SEED, window)
    g = T.windows(w.hash, size, 0x5851F42D4C957F2D)
    bits = U64(len(g).bit_length())
    m = ((g >> bits) << bits) | np.arange(len(g), dtype=U64)  # the place decides between equal hashes
    rest, step = window - size + 1, 1
    while 2 * step <= rest:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if rest > step:
        m = np.minimum(m[:len(m) - (rest - step)], m[rest - step:])
    place = (m[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    chosen = np.zeros(len(g), bool)
    chosen[place] = True
    return g[place], g[chosen]


def _seed_counts(chunk: int, t: pa.Table, window: int, owners: int) -> pa.Table:
    found = [np.zeros(0, U64)]
    for _, _, _, w in _pieces(t):
        found.append(_seeds(w, _starts(w, window), window)[1])
    keys, n = np.unique(X.narrow(np.concatenate(found), owners), return_counts=True)
    return X.post(chunk, keys, owners, False, n.astype(np.uint32))


def _check(w: T.Words, window: int) -> np.ndarray:
    return (T.windows(w.hash, window, 0x94D049BB133111EB) >> U64(48)).astype(np.uint16)


def _index(chunk: int, t: pa.Table, replies: pa.Table, window: int, owners: int) -> pa.Table:
    """Post the first place in this chunk of every window that may repeat."""
    t = _sorted(t)
    pieces, places = [], [np.zeros(0, U64)]
    for lo, _, _, w in _pieces(t):
        at = _starts(w, window)
        seed, chosen = _seeds(w, at, window)
        pieces.append((lo, w, at, X.narrow(seed, owners)))
        places.append(X.narrow(chosen, owners))
    repeated = np.unique(np.concatenate(places))
    del places
    repeated = repeated[X.answers(replies) > 1]
    key, doc, pos, check = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)]
    ids = t["place"].to_numpy()
    for lo, w, at, seed in pieces:
        if not len(at) or not len(repeated):
            continue
        at = at[repeated[np.minimum(np.searchsorted(repeated, seed), len(repeated) - 1)] == seed]
        key.append(T.windows(w.hash, window)[at])
        doc.append(ids[w.doc[at] + lo])
        pos.append((at - np.searchsorted(w.doc, w.doc[at])).astype(np.int32))
        check.append(_check(w, window)[at])
    key, first = np.unique(np.concatenate(key), return_index=True)
    return X.post(chunk, key, owners, True, np.concatenate(doc)[first], np.concatenate(pos)[first], np.concatenate(check)[first])


PLACE = (np.int64, np.int32, np.uint16)
PLACE_BYTES = 14


def _unplace(blob, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in PLACE:
        size = n * np.dtype(kind).itemsize
        out.append(T.unplanes(blob[at:at + size], kind))
        at += size
    return out


def _first_places(posted: pa.Table) -> pa.Table:
    """A reference block: for every chunk, the keys whose first place of all is in another chunk, and that place."""
    keys = [T.unpack_sorted(k.as_buffer()) for k in posted["keys"]]
    size = np.array([len(k) for k in keys])
    places = [_unplace(memoryview(v.as_buffer()), n) for v, n in zip(posted["vals"], size)]
    key = np.concatenate(keys)
    doc, pos, check = (np.concatenate([p[i] for p in places]) for i in range(3))
    del keys, places
    blob = np.repeat(np.arange(len(size), dtype=np.int32), size)
    order = np.lexsort((doc, key))  # a document is in one chunk, so (key, doc) is unique
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    later = order[~new]
    first = head[~new]
    back = np.argsort(later)  # by chunk, then key, as they were posted
    later, first = later[back], first[back]
    at = np.searchsorted(blob[later], np.arange(len(size) + 1))
    rows = {"part": [], "chunk": [], "keys": [], "vals": []}
    parts, chunks = posted["part"].to_pylist(), posted["chunk"].to_pylist()
    for i in np.flatnonzero(np.diff(at)):
        own, ref = later[at[i]:at[i + 1]], first[at[i]:at[i + 1]]
        rows["part"].append(parts[i])
        rows["chunk"].append(chunks[i])
        rows["keys"].append(T.pack_sorted(key[own]))
        rows["vals"].append(T.planes(doc[ref]) + T.planes(pos[ref]) + T.planes(check[ref]))
    return pa.Table.from_pydict(rows, schema=X.POSTED_SCHEMA)


FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
PARSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", FACTORS), ("kept", pa.string())])
PARSED_DDL = ("doc_id long, n_words long, n_removed long, "
              "factors array<struct<start:int,end:int,ref_doc:long,ref_start:int>>, kept string")


RUN = "array<struct<start:int,n:int,ref_doc:long,ref_start:int>>"
RUNS_DDL = f"chunk int, row int, place long, shared boolean, runs {RUN}, wants array<long>"
RUNS = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("place", pa.int64()), ("shared", pa.bool_()),
                  ("runs", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))),
                  ("wants", pa.list_(pa.int64()))])


def _repeats(t: pa.Table, replies: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """The windows of a sorted chunk that also stand earlier: text, position and first place."""
    if len(replies):
        order = np.argsort(replies["part"].to_numpy())
        far = [T.unpack_sorted(replies["keys"][int(i)].as_buffer()) for i in order]
        place = [_unplace(memoryview(replies["vals"][int(i)].as_buffer()), len(k)) for i, k in zip(order, far)]
        far, (far_doc, far_pos, far_check) = np.concatenate(far), (np.concatenate(x) for x in zip(*place))
    else:
        far = np.zeros(0, U64)
    ids = t["place"].to_numpy()
    keys, texts, poss, checks = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)]
    for lo, hi, _, w in _pieces(t):
        at = _starts(w, window)
        n = T.counts_by(w.doc, hi - lo)
        keys.append(T.windows(w.hash, window)[at])
        checks.append(_check(w, window)[at])
        texts.append(w.doc[at] + lo)
        poss.append((at - (np.cumsum(n) - n)[w.doc[at]]).astype(np.int32))
    key, text, pos, check = map(np.concatenate, (keys, texts, poss, checks))
    del keys, texts, poss, checks
    # the earliest place of each window: in this chunk, or in the reference block's answer
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else order
    first = np.empty(len(k), np.int64)
    first[order] = head
    ref_doc, ref_pos, again = ids[text[first]], pos[first], (first != np.arange(len(first))) & (check[first] == check)
    if len(far):
        i = np.minimum(np.searchsorted(far, key), len(far) - 1)
        hit = (far[i] == key) & (far_check[i] == check)
        ref_doc[hit], ref_pos[hit] = far_doc[i[hit]], far_pos[i[hit]]
        again |= hit
    dup = np.flatnonzero(again)
    return text[dup], pos[dup], ref_doc[dup], ref_pos[dup]


def _runs(t: pa.Table, replies: pa.Table, window: int) -> pa.Table:
    """Runs of consecutive first places of every text that has any, and the documents whose runs its factors may need."""
    t = _sorted(t)
    ids = t["place"].to_numpy()
    text, pos, ref_doc, ref_pos = _repeats(t, replies, window)
    begin, after = np.ones(len(text), bool), np.zeros(len(text), bool)
    after[1:] = (text[1:] == text[:-1]) & (pos[1:] == pos[:-1] + 1)
    begin[1:] = ~after[1:] | (ref_doc[1:] != ref_doc[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)
    b = np.flatnonzero(begin)
    n = np.diff(np.append(b, len(text))).astype(np.int32)
    goes_on = np.append(after[b][1:], False) if len(b) else np.zeros(0, bool)
    shared = np.zeros(len(ids), bool)
    shared[1:] = ids[1:] == ids[:-1]
    shared[:-1] |= shared[1:]
    has = T.counts_by(text[b], len(ids))
    rows = np.flatnonzero((has > 0) | shared)
    ask = b[goes_on]
    asked = np.unique(np.stack([text[ask], ref_doc[ask]]), axis=1) if len(ask) else np.zeros((2, 0), np.int64)
    runs = pa.StructArray.from_arrays([pa.array(pos[b]), pa.array(n), pa.array(ref_doc[b]), pa.array(ref_pos[b])], fields=list(RUNS.field("runs").type.value_type))
    ends = np.append(0, np.cumsum(has[rows]))
    want_ends = np.append(0, np.cumsum(T.counts_by(asked[0], len(ids))[rows]))
    return pa.Table.from_arrays([
        pa.array(np.full(len(rows), t["chunk"][0].as_py() if len(t) else 0, np.int32)), pa.array(rows.astype(np.int32)), pa.array(ids[rows]),
        pa.array(shared[rows]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs).cast(RUNS.field("runs").type),
        pa.ListArray.from_arrays(pa.array(want_ends, pa.int32()), pa.array(asked[1])).cast(RUNS.field("wants").type)], schema=RUNS)


def _first_place(runs: tuple[list, ...], doc: int, y: int) -> tuple[int, int, float]:
    """First place of window ``y`` of a document with these runs, and for how many windows it goes on."""
    start, n, ref_doc, ref_start = runs
    k = bisect_right(start, y) - 1
    if k >= 0 and y < start[k] + n[k]:
        return ref_doc[k], ref_start[k] + y - start[k], start[k] + n[k] - y
    return doc, y, start[k + 1] - y if k + 1 < len(start) else float("inf")


def _greedy(runs: tuple[list, ...], known: dict, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (first word, end, reference document and word) of one text; each is carried on through the runs after its own."""
    start, n, ref_doc, ref_start = runs
    out, j, x = [], 0, 0
    while j < len(start):
        p = max(x, start[j])
        doc, ref = ref_doc[j], ref_start[j] + p - start[j]
        x, copied = start[j] + n[j], known.get(doc)
        j += 1
        while copied is not None and j < len(start) and start[j] == x:
            stop = start[j] + n[j]
            while x < stop:
                d, y, left = _first_place(copied, doc, ref + x - p)
                if (d, y) != (ref_doc[j], ref_start[j] + x - start[j]):
                    break
                x += min(left, stop - x)
            if x < stop:
                break
            j += 1
        out.append((p, x - 1 + window, doc, ref))
    return out


def _lists(runs: pa.ListArray) -> tuple[list, ...]:
    flat = runs.values if runs is not None else None
    return tuple([] if flat is None else flat.field(i).to_pylist() for i in range(4))


def _parse(t: pa.Table, found: pa.Table, window: int) -> pa.Table:
    t = _sorted(t)
    known, own, place_of = {}, {}, found["place"].to_pylist()
    for row, place, shared, runs in zip(found["row"].to_pylist(), place_of, found["shared"].to_pylist(), found["runs"]):
        lists = _lists(runs)
        if row is None:
            known[place] = None if shared else lists
        else:
            own[row] = lists
    factors = [(row, *f) for row in sorted(own) for f in _greedy(own[row], known, window)]
    text, start, stop, ref_doc, ref_start = (np.array([f[i] for f in factors], np.int64) for i in range(5))
    out = []
    for lo, hi, data, w in _pieces(t):
        n = T.counts_by(w.doc, hi - lo)
        first_word = np.cumsum(n) - n
        cover = np.zeros(len(w.start) + 1, np.int64)
        fs = slice(*np.searchsorted(text, [lo, hi]))
        np.add.at(cover, first_word[text[fs] - lo] + start[fs], 1)
        np.add.at(cover, first_word[text[fs] - lo] + stop[fs], -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = T.counts_by(w.doc[gone], hi - lo)
        s, size, kept_doc = w.start[~gone], (w.end - w.start)[~gone] + 1, w.doc[~gone]
        at = T.spans(s, size)
        flat = data[np.minimum(at, max(0, len(data) - 1))] if len(at) else np.zeros(0, np.uint8)
        flat[np.cumsum(size) - 1] = 0x20
        offs = np.concatenate(([0], np.cumsum(np.bincount(kept_doc, weights=size, minlength=hi - lo).astype(np.int64))))
        full = np.diff(offs) > 0
        flat = np.delete(flat, offs[1:][full] - 1)  # the space after a text's last word
        offs = offs - np.concatenate(([0], np.cumsum(full)))
        kept = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
        parts = pa.StructArray.from_arrays([pa.array(start[fs], pa.int32()), pa.array(stop[fs], pa.int32()),
                                            pa.array(ref_doc[fs], mask=ref_doc[fs] >= 1 << 62), pa.array(ref_start[fs], pa.int32())],
                                           fields=list(FACTORS.value_type))
        per = np.concatenate(([0], np.cumsum(T.counts_by(text[fs] - lo, hi - lo))))
        out.append(pa.Table.from_arrays([t["doc_id"].slice(lo, hi - lo).combine_chunks(), pa.array(n), pa.array(removed),
                                         pa.ListArray.from_arrays(pa.array(per, pa.int32()), parts).cast(FACTORS), kept], schema=PARSED))
    return pa.concat_tables(out) if out else PARSED.empty_table()


def deduplicate(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, factors (word ranges with the place they repeat), kept (the other words, one space apart)."""
    owners = partitions(docs)
    chunks = X.chunked(id_and_text(docs, id_col, text_col))
    seeds = X.exchange(chunks, lambda c, t: _seed_counts(c, t, window, owners), owners)
    indexed = X.finish(chunks, seeds, lambda t, r: _index(t["chunk"][0].as_py(), t, r, window, owners), X.POSTED)
    places = indexed.groupBy("part").applyInArrow(_first_places, X.POSTED)
    runs = cut(X.finish(chunks, places, lambda t, r: _runs(t, r, window), RUNS_DDL))
    asked = runs.select("chunk", F.explode("wants").alias("place")).distinct()
    copied = asked.join(runs.select("place", "shared", "runs"), "place", "left").select(
        "chunk", F.lit(None).cast("int").alias("row"), "place", F.coalesce("shared", F.lit(False)).alias("shared"), "runs")
    found = runs.where("size(runs) > 0").select("chunk", "row", "place", "shared", "runs").unionByName(copied)
    return X.finish(chunks, found, lambda t, r: _parse(t, r, window), PARSED_DDL)


def digest(parsed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    def run(batches):
        for b in batches:
            sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return parsed.selectExpr("doc_id", "n_words", "n_removed", "kept").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
