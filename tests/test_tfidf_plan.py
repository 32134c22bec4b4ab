"""TF-IDF weights read and shuffle the counted terms once."""

from tapewire.operators import keywords as kw


def test_terms_are_read_once(spark):
    texts = ["alpha beta gamma alpha", "alpha beta delta", "gamma delta alpha beta", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = kw.tfidf_weights(df, "doc_id", "text", stop_words=["zeta"])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    by_vocabulary = kw.tfidf_weights(df, "doc_id", "text", stop_words=["zeta"], max_features=1000)
    key = lambda rows: sorted((r.doc_id, r.term, round(r.weight, 12)) for r in rows)
    assert key(once.collect()) == key(by_vocabulary.collect()) != []
