import hashlib
import random

from llm_frames import documents, odd_texts

from tickloom.llm import order_minhash as om


def test_neighbour_and_edited_text_equal_a_loop(spark):
    texts = odd_texts(2, 40)
    random.Random(1).shuffle(texts)
    got = {r.doc_id: r for r in om.with_neighbour(documents(spark, texts, 5)).collect()}
    ordered = sorted(texts)
    assert len(got) == len(texts)
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        fp = om.fingerprint(t)
        assert tuple(got[i])[1:] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, om.fingerprint(edited),
                                     om.likeness(fp, om.fingerprint(edited)), om.likeness(fp, om.fingerprint(nxt)))


def test_likeness_follows_edits_and_order():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    fp = om.fingerprint(text)
    edited = " ".join(w if r.random() > 0.03 else "zzz" for w in words)
    moved = " ".join(words[200:] + words[:200])
    mixed = " ".join(r.sample(words, 400))
    assert om.likeness(fp, om.fingerprint(text)) == 1.0
    assert om.likeness(fp, om.fingerprint(edited)) > om.likeness(fp, om.fingerprint(mixed)) + 0.2
    assert om.likeness(fp, om.fingerprint(moved)) < 0.75  # same k-mers, other order
    assert om.likeness(fp, om.fingerprint(" ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(400)))) < 0.05


def test_short_and_empty_texts():
    assert om.fingerprint(None) == om.fingerprint("") and om.likeness(om.fingerprint(""), om.fingerprint("")) == 1.0
    assert om.likeness(om.fingerprint(""), om.fingerprint("a")) == 0.0
    assert om.fingerprint("ab") != om.fingerprint("ba") and len({len(om.fingerprint("x" * n)) for n in range(20)}) == 1
    assert om.fingerprint("abcabcabc" * 50) != om.fingerprint("abcabcabc" * 40)


def test_repeated_ids_single_rows_and_empty_tables(spark):
    assert om.with_neighbour(documents(spark, [(1, "only one text here")])).first().near_next == 1.0
    assert om.with_neighbour(documents(spark, [(1, "a text"), (1, "a text"), (2, "other")])).count() == 3
    assert om.with_neighbour(documents(spark, [(1, "x")]).where("false")).count() == 0
