"""Similar documents by the overlap of their word shingles: T-occurrence search with DivideSkip.

Two documents link when 100 * |A & B| >= percent * |A | B|, so either must hold T = ceil(percent/100 * n) of
the other's shingles, and T of its own n must occur elsewhere. The steps:

1. The document frequency of every shingle comes back to each document through one exchange (``exchange``);
   documents with fewer than T shared shingles cannot link and are done (exactly, whatever their size).
2. The rest are grouped by their set of shingles; one representative per set goes on, with its class size.
3. Rare shingles are the short lists: of a representative's n shingles the n - T + 1 rarest must meet one of any
   partner's. Representatives that share such a shingle are connected (through the smallest document of
   each list, so a long list costs its length) and each connected group is searched on its own.
4. Within a group an inverted index is searched with DivideSkip: a query's short lists are merged, candidates
   that can still reach T are kept, and of the long lists each is merged or probed by binary search,
   whichever is cheaper for the candidates left. The final counts decide the link, so there is no approximation.
   A group above ``BLOCK`` shingles is cut into blocks and each pair of blocks is one task's search; groups
   without that size are packed together. No pair of documents is ever a row: a task returns one row per document, with the
   smallest document it is connected to and its links.
5. Components of these rows are the classes.

No caps: every list, candidate and document is used. Nulls, empty texts and texts without words have no
shingles, link with nothing and are their own component. Rows are searched under a number of their own, so rows that
share a doc_id or have none are answered one by one; a component is only named by its smallest doc_id (null if no
row of it has one).
Class identity compares 128-bit hashes of sets, overlap 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import exchange as X
from tickloom.llm import text as T
from tickloom.llm.columns import id_and_text, partitions, unpacked
from tickloom.llm.components import components
from tickloom.session import cut

U64 = np.uint64
BLOCK = 1_000_000
SIGNED = np.int64


def sets(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs by shingle, then text; and the number of shingles of each text."""
    h, d = [], []
    data, offs = T.buffers(texts)
    for lo, hi in T.slices(offs):
        w = T.words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], T.NOT_SPACE, T.LOWER)
        n = T.counts_by(w.doc, hi - lo)
        s = T.windows(w.hash, size)
        keep = np.flatnonzero(w.doc[:len(s)] == w.doc[size - 1:]) if len(s) else np.zeros(0, np.int64)
        h.append(s[keep])
        d.append(w.doc[keep] + lo)
        short = np.flatnonzero((n > 0) & (n < size))
        first = np.cumsum(n) - n
        for k in np.unique(n[short]):
            which = short[n[short] == k]
            h.append(T.windows(w.hash, int(k))[first[which]])
            d.append(which + lo)
    h, d = np.concatenate(h) if h else np.zeros(0, U64), np.concatenate(d) if d else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    swap = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] < d[:-1]))
    if len(swap):  # short texts were appended out of order
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, d, T.counts_by(d, len(texts))


def _keys(h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct narrowed keys and, for each pair, the index of its key."""
    k = X.narrow(h, owners)
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return k[new], np.cumsum(new) - 1


STATE = "doc_id long, k1 long, k2 long, n_shingles long, f1 long, f2 long, grams binary, rare array<long>"
STATE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                          ("grams", pa.binary()), ("rare", pa.list_(pa.int64()))])


def _state(texts: pa.Table, replies: pa.Table, size: int, percent: int, owners: int) -> pa.Table:
    """Every document with its number of shingles; those that may link also with their set and rare shingles."""
    h, d, n = sets(texts["text"], size)
    _, of = _keys(h, owners)
    df = X.answers(replies)[of]
    shared = np.bincount(d[df > 1], minlength=len(n))
    need = -(-n * percent // 100)
    on = (n > 0) & (shared >= need)
    keep = on[d]
    h, d, df = h[keep], d[keep], df[keep]
    order = np.argsort(d, kind="stable")  # by text, then shingle
    h, d, df = h[order], d[order], df[order]
    docs = np.flatnonzero(on)
    at = np.searchsorted(d, np.append(docs, len(n)))
    f1, f2, grams, rare = (np.zeros(len(n), U64), np.zeros(len(n), U64), [None] * len(n), [None] * len(n))
    if len(docs):
        f1[docs] = np.add.reduceat(T.mix(h ^ U64(0xA0761D6478BD642F)), at[:-1])
        f2[docs] = np.add.reduceat(T.mix(h ^ U64(0xE7037ED1A0B428DB)), at[:-1])
    for i, lo, hi in zip(docs.tolist(), at[:-1].tolist(), at[1:].tolist()):
        grams[i] = h[lo:hi].tobytes()
        first = np.lexsort((h[lo:hi], df[lo:hi]))[:n[i] - need[i] + 1]  # rarest first
        rare[i] = h[lo:hi][first[df[lo:hi][first] > 1]].view(SIGNED)
    mask = ~on
    return pa.Table.from_arrays([
        *(texts[c].combine_chunks() for c in ("doc_id", "k1", "k2")), pa.array(n), pa.array(f1.view(SIGNED), mask=mask), pa.array(f2.view(SIGNED), mask=mask),
        pa.array(grams, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], schema=STATE_SCHEMA)


def search(ids: np.ndarray, weight: np.ndarray, sizes: np.ndarray, grams: np.ndarray, split: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip over the documents of one task: the smallest connected id and the weighted links of each.

    ``grams`` are the sets one after another. With ``split`` only pairs of documents on different sides count.
    """
    n = len(ids)
    at = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(grams, kind="stable")
    posts, sorted_grams = doc[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = sorted_grams[1:] != sorted_grams[:-1]
    begin = np.append(np.flatnonzero(new), len(grams))
    of = np.empty(len(grams), np.int64)
    of[order] = np.cumsum(new) - 1
    length = np.diff(begin)
    label, links, parent = np.arange(n), np.zeros(n, np.int64), list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    need = -(-sizes * percent // 100)
    for q in range(n):
        lists = of[at[q]:at[q + 1]]
        lists = lists[length[lists] > 1]
        if len(lists) < need[q]:
            continue
        lists = lists[np.argsort(length[lists])]
        many = length[lists]
        # The longest lists stay out of the merge: fewer than T of them, and more the longer they are.
        n_long = min(int(need[q] / (0.0085 * np.log2(many[-1]) + 1)), len(lists) - 1)
        n_short = len(lists) - n_long
        found, count = _merged(posts[T.spans(begin[lists[:n_short]], many[:n_short])], n)
        alive = (count >= need[q] - n_long) & (found != q)
        alive &= (sizes[found] * 100 >= sizes[q] * percent) & (sizes[q] * 100 >= sizes[found] * percent)
        if split is not None:
            alive &= split[found] != split[q]
        found, count = found[alive], count[alive]
        i, left = n_short, n_long
        while left and len(found):
            if len(found) * int(np.log2(many[i]) + 1) * 4 < many[i]:  # binary search of the candidates in one long list
                lst = posts[begin[lists[i]]:begin[lists[i] + 1]]
                count = count + (lst[np.minimum(np.searchsorted(lst, found), len(lst) - 1)] == found)
                step = 1
            else:
                step = left if many[i] * left < 8 * n else max(1, left // 2)
                more = posts[T.spans(begin[lists[i:i + step]], many[i:i + step])]
                p = np.minimum(np.searchsorted(found, more), len(found) - 1)
                count = count + np.bincount(p[found[p] == more], minlength=len(found))
            i, left = i + step, left - step
            ok = count + left >= need[q]
            if not ok.all():
                found, count = found[ok], count[ok]
        hit = found[count * 100 >= percent * (sizes[q] + sizes[found] - count)]
        if len(hit):
            links[q] = weight[hit].sum()
            roots = sorted({root(x) for x in [*np.unique(label[hit]).tolist(), int(label[q])]})
            for x in roots[1:]:
                parent[x] = roots[0]
            label[hit] = label[q] = roots[0]
    label = np.array([root(x) for x in label.tolist()], np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return least[label], links


def _merged(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of merged lists and how often each occurs."""
    if len(ids) * 8 < n:
        return np.unique(ids, return_counts=True)
    count = np.bincount(ids, minlength=n)
    found = np.flatnonzero(count)
    return found, count[found]


def _search_task(t: pa.Table, percent: int) -> pa.Table:
    ids, weight = t["row"].to_numpy(), t["class_size"].to_numpy()
    grams = [np.frombuffer(g.as_buffer(), U64) for g in t["grams"]]
    sizes = np.array([len(g) for g in grams])
    sides = t["side"].to_numpy()
    least, links = search(ids, weight, sizes, np.concatenate(grams), sides if sides.max() > 0 else None, percent)
    return pa.Table.from_pydict({"row": ids, "least": least, "links": links})


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with 128 bits of their doc_id and text."""
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def _answered(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``join``'s answer to every row with its key (k1, k2), and whether that key is the first of its component."""
    owners = partitions(docs)
    # by id and text, so that rows without an id are not one chunk
    chunks = _keyed(id_and_text(docs, id_col, text_col)).withColumn("chunk", F.pmod("k1", F.lit(4 * owners)).cast("int"))

    def keys_of(chunk, t):
        h, d, _ = sets(t["text"], size)
        keys, of = _keys(h, owners)
        return X.post(chunk, keys, owners, False, np.bincount(of, minlength=len(keys)).astype(np.uint32))

    replies = X.exchange(chunks, keys_of, owners)
    state = X.finish(chunks, replies, lambda t, r: _state(t, r, size, percent, owners), STATE)
    state = cut(state.withColumn("row", F.monotonically_increasing_id()))  # fixed by being written

    alive = state.where("f1 is not null")
    classes = cut(alive.groupBy("f1", "f2", "n_shingles").agg(
        F.min("row").alias("rep"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first")))
    reps = classes.select(F.col("rep").alias("row"), "class_size")
    lists = cut(alive.select("row", "rare").join(reps, "row").select("row", F.explode("rare").alias("gram")))
    heads = lists.groupBy("gram").agg(F.min("row").alias("head"), F.max("row").alias("other")).where("head <> other")
    groups = cut(components(lists.join(heads, "gram").select(F.col("row").alias("a"), F.col("head").alias("b"))))
    sized = reps.join(alive.select("row", "n_shingles"), "row").join(groups, F.col("row") == F.col("node"))
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    placed = (
        sized.join(blocks, "component")
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("row", "class_size",
                F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("component"), F.lit(4 * owners)).alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j")))
                .otherwise(F.struct(F.col("component").alias("key"), (F.least("block", "partner") + 1).alias("i"),
                                    (F.greatest("block", "partner") + 1).alias("j"))).alias("task"),
                # within one block every pair counts, between two only pairs from both
                F.when(F.col("partner") == F.col("block"), 0).when(F.col("block") < F.col("partner"), 1).otherwise(2).alias("side")))
    found = cut(placed.join(alive.select("row", "grams"), "row")
                .select("task", "row", "class_size", "grams", "side").groupBy("task")
                .applyInArrow(lambda t: _search_task(t, percent), "row long, least long, links long"))
    linked = components(found.select(F.col("row").alias("a"), F.col("least").alias("b")))
    per_rep = (found.groupBy("row").agg(F.sum("links").alias("links")).join(linked, F.col("row") == F.col("node"), "left")
               .select(F.col("row").alias("rep"), "links", "component"))
    # one row per class; only then the copies, in one join whose hot classes adaptive execution can split
    labelled = cut(classes.join(per_rep, "rep", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"), "first",
        (F.coalesce("links", F.lit(0)) + F.col("class_size") - 1).alias("n_links")))
    named = labelled.groupBy("component").agg(F.min("first").alias("first"), F.min("first.doc_id").alias("component_id"))
    done = (alive.select("doc_id", "k1", "k2", "f1", "f2", "n_shingles")
            .join(cut(labelled.drop("first").join(named, "component")), ["f1", "f2", "n_shingles"])
            .select("doc_id", "k1", "k2", "n_shingles", "component_id", "n_links",
                    ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("first")))
    alone = state.where("f1 is null").select("doc_id", "k1", "k2", "n_shingles", F.col("doc_id").alias("component_id"),
                                             F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return done.unionByName(alone)


def join(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows it links with) of every row."""
    return _answered(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_links")


def firsts(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: the smallest id (null ids last), of rows that repeat it the one with the smallest hash."""
    answered = _answered(docs, size, percent, id_col, text_col).where("first")
    # keys are one component's, except those of texts without words, whose rows all stay
    keys = cut(answered.groupBy("k1", "k2").agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = _keyed(docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kept = rows.select("row", "k1", "k2").join(keys, ["k1", "k2"])
    if not keys.where("repeated").isEmpty():
        kept = kept.where("not repeated").unionByName(kept.where("repeated").groupBy("k1", "k2").agg(
            F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row", "k1", "k2", F.lit(True).alias("repeated")))
    return unpacked(kept, docs)
