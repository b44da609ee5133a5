"""The operators' queries against their SQL, and the pipeline against a brute-force version."""

import inspect
import pathlib

import pytest
from conftest import SF
from llm_frames import documents
from oracle_check import compare, connect
from test_llm_decontaminate import brute as brute_hits
from test_llm_ngram_join import brute as brute_groups

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import pii, queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    error, rows = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert error is None and rows > 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL and n not in ("op9_language_id", "op12_embedding_whitening")])
def test_query_answers_every_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_everything_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_pipeline_equals_its_stages_by_hand(spark):
    """From the language stage's own decisions on: groups, hits and masks by loops, pieces decoded."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id, r.text) for r in kept.collect())
    assert len(texts) == docs.where("text rlike '[a-zA-Z]'").count()  # clean documents stay
    first = {i for i, (_, c, _) in brute_groups(texts, percent=80, k=5).items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [x for x in texts if x[0] in first]
    bad = {i for i, x in brute_hits(texts, items).items() if x[3]}
    want = {i: pii.redact(t, sum(pii.find_spans(t), [])) for i, t in texts if i not in bad}
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    from tickloom.llm import pieces

    back = pieces.decode(out.select("doc_id", "piece_ids"), pieces.load(queries.PIECES), ids_col="piece_ids")
    assert {r.doc_id: r.text for r in back.collect()} == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, stage):
    d = documents(spark, [(1, None), (2, ""), (3, "the of and that"), (3, "the of and that"), (4, "bob@x.yz and that of the"), (5, "the of and that")])
    assert stage(spark, d, SF).count() >= 0
    assert stage(spark, d.where("false"), SF).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(inspect.getfile(entry)).parent / "tickloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tickloom.llm" not in p.read_text()
