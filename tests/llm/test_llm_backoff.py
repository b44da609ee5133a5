import math
import re
from collections import Counter

from llm_frames import documents, odd_texts

from tickloom.llm import backoff_lm


def brute(texts):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts}
    grams = {i: Counter(tuple(w[p:p + k]) for k in (1, 2, 3) for p in range(len(w) - k + 1)) for i, w in docs.items()}
    every = sum(grams.values(), Counter())
    total = sum(map(len, docs.values()))
    out = {}
    for i, w in docs.items():
        c = lambda *g: every[g] - grams[i][g]  # noqa: B023, E731
        big, score = max(1, total - len(w)), 0.0
        for p in range(len(w)):
            k, factor = min(p, 2), 1.0
            while k and not c(*w[p - k:p + 1]):
                k, factor = k - 1, factor * 0.4
            if k:
                s = c(*w[p - k:p + 1]) / c(*w[p - k:p])
            else:
                s = c(w[p]) / big if c(w[p]) else 0.4 / big
            score += math.log(factor * s)
        out[i] = (len(w), score)
    return out


def test_scores_equal_a_loop(spark):
    texts = odd_texts(8, 70)
    want = brute(texts)
    got = backoff_lm.score(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, score = want[r.doc_id]
        assert r.n_words == n and abs(r.log_score - score) < 1e-6 * max(1, abs(score))
        assert (r.mean_score is None) == (n == 0)


def test_lone_text_and_empty_table(spark):
    d = documents(spark, [(1, "a b a b"), (2, None)])
    assert {r.doc_id: round(r.log_score, 9) for r in backoff_lm.score(d).collect()} == {i: round(s, 9) for i, (_, s) in brute([(1, "a b a b"), (2, None)]).items()}
    assert backoff_lm.score(d.where("false")).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    texts = odd_texts(3, 30)
    with_ids, without = (sorted((r.n_words, round(r.log_score, 6)) for r in backoff_lm.score(documents(spark, rows)).collect())
                         for rows in (texts, [(None, t) for _, t in texts]))
    assert with_ids == without
