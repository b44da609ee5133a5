from collections import Counter

import numpy as np
import pytest
from llm_frames import documents, odd_texts

from tickloom.llm import pieces
from tickloom.llm.queries import PIECES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES, 0.5)


def test_every_text_comes_back(spark, vocabulary):
    texts = odd_texts() + [(900, "▁ literal mark \u0000 and  blanks  "), (901, " lead"), (902, "a" * 3000), (903, "\n\n"), (904, "�𝔘")]
    d = documents(spark, texts)
    out = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d, vocabulary), vocabulary).collect()}
    assert out == dict(texts)
    full = pieces.with_pieces(d, vocabulary)
    assert full.columns == [*d.columns, "piece_ids", "n_pieces"] and full.count() == len(texts)


def test_library_decodes_the_same(spark, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    d = documents(spark, [(1, "The quick brown fox, über 12 naïve cafés."), (2, "Été ñandú ß")])
    for r in pieces.encode(d, vocabulary).collect():
        assert sp.decode(list(r.ids)) == {1: "The quick brown fox, über 12 naïve cafés.", 2: "Été ñandú ß"}[r.doc_id]


def test_samples_depend_on_key_and_seed_only(spark, vocabulary):
    texts = odd_texts(3, 20)
    take = lambda p, s: {r.doc_id: r.ids for r in pieces.encode(documents(spark, texts, p), vocabulary, seed=s).collect()}
    one = take(1, 5)
    assert one == take(4, 5)
    assert one != take(1, 6)
    same = [r.ids for r in pieces.encode(documents(spark, [(i, "the representation of understanding") for i in range(20)]), vocabulary).collect()]
    assert len({tuple(s) for s in same}) > 3


def test_sampling_follows_the_path_weights(spark):
    """All segmentations of a word, by enumeration, against their frequencies."""
    v = pieces.load(PIECES, 0.3)
    word = " under"
    ids = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_id)}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in ids:
                for p, w in paths(rest[k:]):
                    yield (ids[rest[:k]], *p), w + v.weight[ids[rest[:k]]]

    every = list(paths(word.encode()))
    p = np.exp([w for _, w in every])
    p /= p.sum()
    n = 6000
    sampler = pieces.Sampler(v, False)
    data = np.frombuffer(b"under" * n, np.uint8)
    count, out = pieces._encode(sampler, np.arange(n), data, np.arange(n + 1) * 5, 1)
    at = np.concatenate(([0], np.cumsum(count)))
    got = Counter(tuple(out[a:z]) for a, z in zip(at[:-1], at[1:]))
    for (path, _), q in zip(every, p):
        assert abs(got[path] / n - q) < 5 * np.sqrt(q / n) + 1e-3
    best = pieces._encode(pieces.Sampler(v, True), np.arange(1), np.frombuffer(b"under", np.uint8), np.array([0, 5]), 1)[1]
    assert tuple(best) == every[int(p.argmax())][0]


def test_a_sampler_that_starts_anew_gives_the_same(vocabulary):
    text = "one two three four five six seven eight nine ten eleven twelve".encode()
    data, offs = np.frombuffer(text * 3, np.uint8), np.arange(4) * len(text)
    keys = np.array([7, 8, 9])
    want = pieces._encode(pieces.Sampler(vocabulary, False), keys, data, offs, 1)[1]
    small = pieces.Sampler(vocabulary, False)
    small.LIMIT = 10
    got = [pieces._encode(small, keys[i:i + 1], data[offs[i]:offs[i + 1]], np.array([0, len(text)]), 1)[1] for i in range(3)]
    assert (np.concatenate(got) == want).all()


@pytest.mark.parametrize("draw", [0, 2**64 - 1])
def test_extreme_draws_stay_in_their_lattice(vocabulary, monkeypatch, draw):
    text = b"understanding a rather long and unusual sentence " * 40
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    sampler = pieces.Sampler(vocabulary, False)
    start = np.arange(0, len(text) - 20, 20)
    which = sampler.slots(data, start, start + 20)
    monkeypatch.setattr(pieces.T, "mix", lambda x: np.full(len(x), draw, np.uint64))
    many, out = sampler.sample(which, np.zeros(len(start), np.uint64))
    assert vocabulary.join(out) in (text[:start[-1] + 20], text[1:start[-1] + 20])
    assert len(out) == many.sum()


def test_shares_do_not_depend_on_the_other_strings(vocabulary):
    one = np.frombuffer(b"internationalisation", np.uint8)
    alone = pieces._lattice(vocabulary, one, np.array([0, len(one)]), False)
    before = np.frombuffer(b"sometimes other words " * 500, np.uint8)
    both = pieces._lattice(vocabulary, np.concatenate((before, one)), np.array([0, len(before), len(before) + len(one)]), False)
    assert (both[5][-len(alone[5]):] == alone[5]).all()
