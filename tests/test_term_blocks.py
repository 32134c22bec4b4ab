"""TF-IDF by blocks of documents gives what counting by term gives, without a row for each document and term."""

import pytest
from pyspark.sql import functions as F

from tapewire.operators import keywords as kw
from tapewire.operators import term_blocks

TEXTS = ["Margin growth, margin 2024 x!", "margin growth of Straße", "ÉTÉ été foo_bar straße growth", "", None, "profit margin growth", "a b", "profit warning profit  warning"]


@pytest.fixture
def docs(spark, monkeypatch):
    """Many blocks and shards; ids that repeat or are null."""
    monkeypatch.setattr(term_blocks, "BLOCK_CHARS", 16)
    monkeypatch.setattr(term_blocks, "SHARD_CHARS", 8)
    rows = [*enumerate(TEXTS * 3), (1, "margin margin call"), (None, "profit growth"), (None, "growth growth warning")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_rows(df, stop):
    return kw.text_terms(df, "doc_id", "text", stop)


def kept(df, *cols):
    return sorted([tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()], key=str)


@pytest.fixture
def no_rows(monkeypatch):
    """From now on nothing may make a row for each document and term."""

    def stop():
        monkeypatch.setattr(kw, "text_terms", lambda *a, **b: pytest.fail("a row for each document and term"))

    return stop


def test_corpus_keywords(docs, no_rows):
    want = kept(kw.corpus_keywords(docs, "doc_id", "text", 5, terms=by_rows(docs, ["of"])), "term", "score")
    no_rows()
    assert kept(kw.corpus_keywords(docs, "doc_id", "text", 5, stop_words=["of"]), "term", "score") == want != []


def test_terms_of_few_documents_are_among_the_best(spark, no_rows):
    """Of 4,000 documents, terms in four or more are summed first; here the best that pass are in two and three."""
    texts = [f"word{k}" for k in range(3990)] + ["quarterly outlook"] * 3 + ["revenue target"] * 2 + ["x1", "x2", "x3", "x4", "x5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(kw.corpus_keywords(df, "doc_id", "text", 4, terms=by_rows(df, [])), "term", "score")
    no_rows()
    assert kept(kw.corpus_keywords(df, "doc_id", "text", 4, stop_words=[]), "term", "score") == want
    assert len(want) == 4


def test_keyword_document_frequency(docs, no_rows):
    want = kept(kw.keyword_document_frequency(kw.document_keywords(docs, "doc_id", "text", 3, terms=by_rows(docs, ["of"]))), "term", "documents")
    no_rows()
    assert kept(kw.keyword_document_frequency(kw.document_keywords(docs, "doc_id", "text", 3, stop_words=["of"])), "term", "documents") == want != []


def test_tfidf_weights(docs, no_rows):
    want = kept(kw.tfidf_weights(docs, "doc_id", "text", ["of"], max_df=1.0, terms=by_rows(docs, ["of"])), "doc_id", "term", "weight")
    no_rows()
    got = kw.tfidf_weights(docs, "doc_id", "text", ["of"], max_df=1.0)
    assert kept(got, "doc_id", "term", "weight") == want != []
    assert not [x for x in ("Window", "collect_list", "Generate") if x in got._jdf.queryExecution().optimizedPlan().toString()]


def test_top_terms(docs, no_rows):
    weights = kw.tfidf_weights(docs, "doc_id", "text", ["of"], terms=by_rows(docs, ["of"]))
    want = kept(kw.top_meaningful(weights.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("score")), 3), "term", "score")
    no_rows()
    assert kept(kw.top_terms(docs, "doc_id", "text", 3, lambda total: F.round(total, 6), ["of"]), "term", "score") == want != []


def test_document_keywords(docs, no_rows):
    cols = ("doc_id", "term", "weight", "rank")
    want = kept(kw.document_keywords(docs, "doc_id", "text", 2, 0.4, terms=by_rows(docs, ["of"])), *cols)
    no_rows()
    assert kept(kw.document_keywords(docs, "doc_id", "text", 2, 0.4, stop_words=["of"]), *cols) == want != []
