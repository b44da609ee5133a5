import numpy as np
import pytest
from llm_frames import documents

from tickloom.llm import langid
from tickloom.llm.queries import op9_language_id


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98 and not got.rejected.any()


def test_probabilities_of_a_history_add_up_to_one(model):
    tables = model.tables()
    chars = np.concatenate(([langid.SPACE, langid.UNKNOWN], langid.FIRST + np.arange(len(model.chars)))).astype(np.uint64)
    for text in ("the a", "der ", "zzzz", "ción"):
        cps, _, _ = langid.symbols([text])
        history = langid._encode(cps, model.chars).astype(np.uint64)[-langid.ORDER:-1]
        g = np.zeros(len(chars), np.uint64)
        for h in history:
            g = (g | h) << np.uint64(langid.BITS)
        p = np.exp(langid._log_probs(model, tables, g | chars).astype(float)).sum(axis=0)
        assert (p <= 1.0 + 1e-3).all() and (p > 0.4).all()  # the rest is left to unseen letters


def test_odd_texts(spark, model):
    d = documents(spark, [(1, None), (2, ""), (3, "12 ** .."), (4, "the of and that with"), (4, "the of and that with"), (5, "жёлтый снег идёт " * 30),
                          (6, "the of and that with " * 12000)])
    got = sorted(langid.predict(d, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", got[5].lang_pred, "en"]
    assert [r.rejected for r in got] == [True, True, True, False, False, True, False]
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.accepted(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 6]
    assert langid.predict(d.where("false"), model).count() == 0


def test_no_training_rows(spark):
    d = documents(spark, [(1, "abc")])
    empty = langid.fit(d.where("false"))
    assert [r.lang_pred for r in langid.predict(d, empty).collect()] == ["und"]


def test_predictions_do_not_depend_on_partitions(spark, model):
    texts = [(i, f"text {i} and the other one of them") for i in range(40)]
    a, b = ({r.doc_id: r.score for r in langid.predict(documents(spark, texts, p), model).collect()} for p in (1, 7))
    assert a == b


LATIN = ["the cat and the dog went home", "der hund und die katze gehen", "le chat et le chien vont"]


def test_rows_are_sampled_one_by_one(spark, monkeypatch):
    """Ids that many rows share, or that are missing, neither multiply nor hide rows."""
    counted = []
    build = langid.build
    monkeypatch.setattr(langid, "build", lambda langs, chars, lang, gram, n: counted.append((langs, n.sum())) or build(langs, chars, lang, gram, n))
    d = documents(spark, [(1, LATIN[0])] * 300 + [(None, LATIN[0])] * 20)
    langid.fit(d, docs_per_lang=40)
    assert counted[-1] == (["en"], 32 * (len(LATIN[0]) + 1))
    langid.fit(documents(spark, [(None, LATIN[0])] * 5), docs_per_lang=40)
    assert counted[-1][1] == 4 * (len(LATIN[0]) + 1)


def test_long_labelled_texts_are_learned_from_their_beginning(spark):
    d = documents(spark, [(i, LATIN[0] * 50) for i in range(10)])
    m = langid.fit(d, max_chars=200)
    assert m.langs == ["en"] and langid.predict(d, m).first().lang_pred == "en"


def test_too_many_labels_are_refused(spark):
    d = documents(spark, [(i, LATIN[0]) for i in range(9)]).selectExpr("doc_id", "text", "cast(doc_id as string) as lang")
    with pytest.raises(ValueError):
        langid.fit(d, max_languages=8)
    assert len(langid.fit(d, max_languages=9).langs) == 9


def test_digits_blank_latin_words_only(spark, model):
    sym = lambda t: langid.symbols([t])
    assert sym("ab1 cd")[2].tolist() == [[4, 2]] and sym("日本1語と2")[2].tolist() == [[4, 4]] and sym("a1 b2")[2].tolist() == [[2, 0]]
    got = langid.predict(documents(spark, [(1, "the1 and2 of3 that4 " * 20)]), model).first()
    assert got.rejected and got.lang_pred != "und"

