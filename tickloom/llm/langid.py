"""Language identification by interpolated Kneser-Ney character models.

Training takes at most ``docs_per_lang`` labelled texts per language, of each at most the first ``max_chars`` characters, from the
rows with the smallest hash of their id (a documented, bounded sample; four fifths train, one fifth
calibrates). Spark counts the character n-grams of each language; from the counts the driver builds
the tables, whose size the sample bounds. All languages share one set of sorted hash arrays: an n-gram's
row holds its interpolated log-probability in every language, a history's row the weight with which it
backs off. A text's language is the one with the lowest cross-entropy per character over the whole text;
letters are lower-cased, Latin words with digits in them and every run of other characters are one space. The tables
know the 4,092 most frequent letters of the sample, others are one unknown letter.

Rejection is calibrated on the held-back fifth: a text is rejected if its best cross-entropy is above
mean + 8 deviations (which shrink with the root of its length) + one nat for that language.
``score`` is the posterior of the language, lowered by the excess over that bound.

Null texts and texts without a letter are ``und`` with score 0 and rejected; texts without a scored letter are rejected. Ties go to the language whose
name comes first. Without any training row every text is ``und``. Repeated rows are answered each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import text as T
from tickloom.llm.columns import batch, carried, findable, mapped, unpacked

ORDER = 5
BITS = 12
SPACE, UNKNOWN, FIRST = 1, 2, 3
U64 = np.uint64
_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    if not _fold:
        t = np.arange(0x110000, dtype=np.uint32)
        t[:0x20000] = [(ord(c.lower()) if len(c.lower()) == 1 else i) if (c := chr(i)).isalpha() else 0 for i in range(0x20000)]
        t[0x323B0:] = 0  # nothing but ideographs between
        _fold.append(t)
    return _fold[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, each preceded by ORDER-1 spaces and followed by one; the text of
    each, and per text the number of letters and of those that are scored."""
    enc = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    n = np.array([len(e) // 4 for e in enc])
    raw = np.frombuffer(b"".join(enc), np.uint32)
    cps = _letters()[raw]
    doc = np.repeat(np.arange(len(texts)), n)
    letters = T.counts_by(doc[cps > 0], len(texts))
    digit = (raw >= 0x30) & (raw <= 0x39)
    if digit.any():  # keys and codes say nothing about the language: a run that holds a digit is no word
        inside = digit | (cps > 0)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        run = np.cumsum(begin)
        coded = np.zeros(int(run[-1]) + 1, bool)
        coded[run[digit]] = True
        cps[inside & coded[run] & (raw < 0x250)] = 0  # scripts without spaces run on
    left = T.counts_by(doc[cps > 0], len(texts))
    keep = cps > 0
    keep[1:] |= (cps[:-1] > 0) & (doc[1:] == doc[:-1])  # the first of a run of other characters stays
    cps, doc = cps[keep], doc[keep]
    m = T.counts_by(doc, len(texts)) + ORDER
    at = np.concatenate(([0], np.cumsum(m)))
    out = np.zeros(at[-1], np.uint32)
    out[np.arange(len(cps)) + (doc + 1) * (ORDER - 1) + doc] = cps
    return out, np.repeat(np.arange(len(texts)), m), np.stack([letters, left], axis=1)


def _grams(sym: np.ndarray) -> np.ndarray:
    """The ORDER symbols up to each position, packed; the first ORDER-1 positions of a text are padding."""
    g = np.zeros(len(sym), U64)
    for j in range(ORDER - 1, -1, -1):
        g <<= U64(BITS)
        g[j:] |= sym[:len(sym) - j].astype(U64)
    return g


class Hashed:
    """Sorted hashes with an index over their leading bits."""

    def __init__(self, keys: np.ndarray):
        h = T.mix(keys)
        self.order = np.argsort(h)
        self.h = h[self.order]
        self.shift = U64(64 - max(4, len(keys).bit_length() + 1))
        self.first = np.searchsorted(self.h >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the constructor's array, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.h):
            return out
        h = T.mix(keys)
        at = self.first[h >> self.shift]
        last = len(self.h) - 1
        hit = self.h[np.minimum(at, last)] == h
        out[hit] = self.order[at[hit]]
        rest = np.flatnonzero(~hit)
        for d in range(1, self.deep):
            p = at[rest] + d
            hit = self.h[np.minimum(p, last)] == h[rest]
            out[rest[hit]] = self.order[np.minimum(p[hit], last)]
            rest = rest[~hit & (self.h[np.minimum(p, last)] < h[rest])]
            if not len(rest):
                break
        return out


@dataclass
class Model:
    langs: list[str]
    chars: np.ndarray             # known letters, ascending; symbol FIRST + index
    grams: list[np.ndarray]       # packed n-grams of order 1..ORDER
    logp: list[np.ndarray]        # n-grams x languages
    histories: list[np.ndarray]   # packed histories of length 1..ORDER-1
    backoff: list[np.ndarray]     # histories x languages
    bound: np.ndarray | None = None  # per language: mean and deviation of the cross-entropy

    def tables(self):
        return [Hashed(g) for g in self.grams], [Hashed(h) for h in self.histories]


def _encode(cps: np.ndarray, chars: np.ndarray) -> np.ndarray:
    table = np.zeros(0x110000, np.uint16)
    table[:] = UNKNOWN
    table[0] = SPACE
    table[chars] = FIRST + np.arange(len(chars))
    return table[cps]


def _suffix(g: np.ndarray, k: int) -> np.ndarray:
    return g & ((U64(1) << U64(BITS * k)) - U64(1))


def build(langs: list[str], chars: np.ndarray, lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from the counts of the longest n-grams per language."""
    n_lang = len(langs)
    levels = {ORDER: (lang, gram, count.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct n-grams that end so
        l, g, _ = levels[k + 1]
        pair, many = np.unique(np.stack([l.astype(U64), _suffix(g, k)]), axis=1, return_counts=True)
        levels[k] = (pair[0].astype(np.int64), pair[1], many.astype(np.float64))
    grams, logp, histories, backoff = [], [], [], []
    lower = None
    for k in range(1, ORDER + 1):
        l, g, c = levels[k]
        keys, row = np.unique(g, return_inverse=True)
        once, twice = (np.array([np.sum(c[l == i] == x) for i in range(n_lang)], float) for x in (1, 2))
        discount = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.95)
        hist, hrow = np.unique(g >> U64(BITS), return_inverse=True)
        total = np.zeros((len(hist), n_lang))
        np.add.at(total, (hrow, l), c)
        kinds = np.zeros((len(hist), n_lang))
        np.add.at(kinds, (hrow, l), 1)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.zeros((len(keys), n_lang))
        p[row, l] = np.maximum(c - discount[l], 0) / total[hrow, l]
        of_key = np.searchsorted(hist, keys >> U64(BITS))
        if k == 1:
            base = np.full((len(keys), n_lang), 1.0 / (len(chars) + 2 + 100))
        else:
            base = lower[1][np.searchsorted(lower[0], _suffix(keys, k - 1))]
        p += gamma[of_key] * base
        lower = (keys, p)
        grams.append(keys)
        logp.append(np.log(p).astype(np.float32))
        histories.append(hist)
        backoff.append(np.log(gamma).astype(np.float32))
    return Model(langs, chars, grams, logp, histories, backoff)


def _log_probs(m: Model, tables, g: np.ndarray) -> np.ndarray:
    """n-grams x languages."""
    out = np.zeros((len(g), len(m.langs)), np.float32)
    rest = np.arange(len(g))
    for k in range(ORDER, 0, -1):
        key = _suffix(g[rest], k)
        i = tables[0][k - 1].find(key)
        hit = i >= 0
        out[rest[hit]] += m.logp[k - 1][i[hit]]
        rest, key = rest[~hit], key[~hit]
        if not len(rest):
            return out
        j = tables[1][k - 1].find(key >> U64(BITS))
        known = j >= 0
        out[rest[known]] += m.backoff[k - 1][j[known]]
    out[rest] += np.float32(-np.log(len(m.chars) + 2 + 100))
    return out


def cross_entropy(m: Model, tables, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts x languages in nats per symbol, the symbols and the letters of each text."""
    cps, doc, letters = symbols(texts)
    g = _grams(_encode(cps, m.chars))
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    real = np.ones(len(doc), bool)
    for j in range(ORDER - 1):
        real[at + j] = False
    g, doc = g[real], doc[real]
    start = np.searchsorted(doc, np.arange(len(texts)))
    total = np.add.reduceat(_log_probs(m, tables, g), start, axis=0, dtype=np.float64) if len(g) else np.zeros((len(texts), len(m.langs)))
    n = T.counts_by(doc, len(texts))
    return -total / n[:, None], n, letters


def _text_slices(texts: pa.Array):
    for lo, hi in T.slices(T.buffers(texts)[1], T.PIECE):
        yield lo, hi


def fit(train: DataFrame, docs_per_lang: int = 400, max_chars: int = 20_000, max_languages: int = 256, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Model from labelled rows; see the module for the sample."""
    rows = findable(train).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    # counts per hash bucket give each language's last bucket, so that ranking sees little more than the sample
    rows = rows.withColumn("_bucket", F.shiftrightunsigned(F.xxhash64("doc_id"), 48))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("_bucket"))  # 65,536 buckets at most
    counts = rows.groupBy("lang", "_bucket").agg(F.count("*").alias("n")).withColumn("upto", upto)
    last = F.coalesce(F.min(F.when(F.col("upto") >= docs_per_lang, F.col("_bucket"))), F.max("_bucket"))
    found = counts.groupBy("lang").agg(last.alias("last")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages: clean the labels or raise max_languages (and the memory of the tables)")
    langs = sorted(r.lang for r in found)
    limit = F.create_map(*(x for r in found for x in (F.lit(r.lang), F.lit(r["last"])))) if found else F.create_map(F.lit(""), F.lit(-1).cast("long"))
    rows = rows.where(F.col("_bucket") <= limit[F.col("lang")])
    # rows are ranked, not ids: each task keeps docs_per_lang rows a language before the shuffle, however many share an id
    order = Window.partitionBy("lang").orderBy("_bucket", F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.withColumn("text", F.left("text", F.lit(max_chars)))
    sample = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= docs_per_lang)
    part = sample.select("lang", "text", (F.col("_rank") % 5 == 0).alias("held"))

    def count(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi in _text_slices(b.column(1)):
                cps, doc, _ = symbols(b.column(1).slice(lo, hi - lo).to_pylist())
                # five code points do not fit 64 bits: counted as fixed-width binary
                win = np.zeros((len(cps), ORDER), np.uint32)
                for j in range(ORDER):
                    win[ORDER - 1 - j:, j] = cps[:len(cps) - (ORDER - 1 - j)]
                real = np.ones(len(doc), bool)
                at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, int)
                for j in range(ORDER - 1):
                    real[at + j] = False
                which = np.array([langs.index(x) for x in names[lo:hi]])[doc[real]] if len(doc) else np.zeros(0, int)
                full = np.concatenate([which[:, None].astype(np.uint32), win[real]], axis=1)
                rows_, n = np.unique(full, axis=0, return_counts=True) if len(full) else (full, np.zeros(0, int))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows_], pa.binary()), pa.array(n, pa.int64())], ["gram", "n"])

    counted = part.where("not held").select("lang", "text").mapInArrow(count, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    raw = np.frombuffer(b"".join(counted.column(0).to_pylist()), np.uint32).reshape(-1, ORDER + 1)
    n = counted.column(1).to_numpy()
    seen, many = np.unique(raw[:, -1], return_counts=True)
    chars = seen[seen > 0]
    if len(chars) > (1 << BITS) - FIRST - 1:  # the most frequent letters; the others are "unknown"
        chars = np.sort(chars[np.argsort(-many[seen > 0], kind="stable")[:(1 << BITS) - FIRST - 1]])
    codes = _encode(raw[:, 1:], chars).astype(U64)
    gram = np.zeros(len(raw), U64)
    for j in range(ORDER):
        gram = (gram << U64(BITS)) | codes[:, j]
    pair, row = np.unique(np.stack([raw[:, 0].astype(U64), gram]), axis=1, return_inverse=True)
    total = np.zeros(pair.shape[1])
    np.add.at(total, row.ravel(), n)
    m = build(langs, chars, pair[0].astype(np.int64), pair[1], total)
    m.bound = np.tile([0.0, np.inf], (len(langs), 1))
    held = part.where("held").select("lang", "text")
    tables = m.tables()

    def measure(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi in _text_slices(b.column(1)):
                ce, size, letters = cross_entropy(m, tables, b.column(1).slice(lo, hi - lo).to_pylist())
                own = ce[np.arange(hi - lo), [langs.index(x) for x in names[lo:hi]]]
                yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi]), pa.array(own), pa.array(size), pa.array(letters[:, 1])], ["lang", "ce", "n", "letters"])

    seen = held.mapInArrow(measure, "lang string, ce double, n long, letters long").where("letters > 0").toPandas()  # docs_per_lang / 5 rows a language
    for i, name in enumerate(langs):
        x = seen[seen.lang == name]
        if len(x) >= 2:
            mean = np.average(x.ce, weights=x.n)
            m.bound[i] = mean, max(0.05, np.sqrt(np.average((x.ce - mean) ** 2 * x.n)))
    return m


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()),
                       ("rejected", pa.bool_())])


PREDICTED_DDL = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _task(docs: DataFrame, model: Model):
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def task():
        m = sent.value
        tables = m.tables()
        return lambda b: (_predict(m, tables, b.slice(lo, hi - lo)) for lo, hi in _text_slices(b.column(1)))

    return task


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row, from its text alone; no shuffle."""
    return mapped(docs, _task(docs, model), PREDICTED_DDL, id_col, text_col)


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    return unpacked(carried(docs, _task(docs, model), PREDICTED_DDL, id_col, text_col).where("not rejected"), docs)


def _predict(m: Model, tables, b: pa.RecordBatch) -> pa.RecordBatch:
    texts = b.column(1).to_pylist()
    n_docs = len(texts)
    if not m.langs:
        return batch(PREDICTED, doc_id=b.column(0), lang_pred=["und"] * n_docs, score=[0.0] * n_docs, cross_entropy=[None] * n_docs, rejected=[True] * n_docs)
    ce, n, letters = cross_entropy(m, tables, texts)
    best = ce.argmin(axis=1)
    low = ce[np.arange(n_docs), best]
    post = 1.0 / np.exp(-(ce - low[:, None]) * n[:, None].clip(max=200)).sum(axis=1)
    over = low - (m.bound[best, 0] + 8 * m.bound[best, 1] / np.sqrt(n) + 1.0)
    und = letters[:, 0] == 0
    score = np.where(und, 0.0, post * np.exp(-np.maximum(over, 0) * np.sqrt(n).clip(max=10)))
    return batch(PREDICTED, doc_id=b.column(0), lang_pred=["und" if u else m.langs[i] for u, i in zip(und, best)], score=score,
                 cross_entropy=pa.array(low, pa.float64(), mask=und), rejected=(letters[:, 1] == 0) | (over > 0))
