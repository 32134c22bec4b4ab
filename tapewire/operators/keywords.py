"""Keyword matching, filtering, TF-IDF keywords and keyword-based weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire import keyword_data as kd
from tapewire.functions.settle import settle
from tapewire.functions.stats import clip
from tapewire.operators import term_blocks
from tapewire.operators.patterns import with_keywords, with_weights

def ticker_stop_words(tickers: list[str] | None = None, aliases: dict[str, list[str]] | None = None) -> list[str]:
    words = [t.lower() for t in (tickers or config.TICKERS)]
    for names in (aliases or config.TICKER_ALIASES).values():
        for name in names:
            words += [name.lower(), *name.lower().split()]
    return sorted(set(words))


def domain_stop_words() -> list[str]:
    return sorted(set(kd.FINANCIAL_STOP_WORDS) | set(ticker_stop_words()))


def english_stop_words() -> list[str]:
    """Spark's own English list; pass another list for other results."""
    return StopWordsRemover.loadDefaultStopWords("english")


def _set(words: list[str]) -> Column:
    """Array literal of words, folded from one joined string."""
    return F.split(F.lit("\n".join(words)), "\n")


def is_meaningful(keyword: Column) -> Column:
    """Finance phrases pass; otherwise length, digits, filing patterns, stop words and tickers decide."""
    kw = F.trim(F.lower(keyword))
    stop, names = domain_stop_words(), ticker_stop_words()
    artefact = kw.rlike("|".join(f"(?:{p})" for p in kd.FILING_PATTERNS))
    parts = F.split(kw, r"\s+")
    only_stop = F.forall(parts, lambda t: t.isin(stop))
    plain = (F.length(kw) >= kd.MIN_KEYWORD_LENGTH) & ~kw.rlike(r"^[\d,.\-%/]+$") & ~artefact & ~only_stop & ~kw.isin(names)
    return kw.isin(kd.FINANCE_PHRASES) | plain


def is_filing_artefact(keyword: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(keyword), r"\s+"), _set(kd.FILING_TOKENS))


def filter_report(keywords: DataFrame, col: str = "keyword") -> DataFrame:
    """How many keywords the filter keeps and blocks."""
    return keywords.groupBy(is_meaningful(F.col(col)).alias("kept")).agg(F.count("*").alias("n"))


def match_listed(news: DataFrame, keywords: list[str], text: str = "headline") -> DataFrame:
    """One row per (headline, contained keyword), case-insensitive literal substring.

    A list written in the program is filtered inside the row, so nothing is
    joined; keyword tables go through ``match_table``.
    """
    low = F.lower(F.col(text))
    listed = _set(keywords)
    hits = F.filter(listed, lambda k: F.contains(low, F.lower(k)))
    return news.withColumn("keyword", F.explode_outer(hits)).where("keyword is not null")


def match_table(news: DataFrame, keywords: DataFrame, text: str = "headline") -> DataFrame:
    """Same match for a keyword table of any size; select the columns that are needed before."""
    return with_keywords(news, keywords, text, out="_hits").withColumn("keyword", F.explode("_hits")).drop("_hits")


def match(news: DataFrame, keywords: list[str] | DataFrame, text: str = "headline") -> DataFrame:
    """A list that is written in the program, or a table."""
    return match_table(news, keywords, text) if isinstance(keywords, DataFrame) else match_listed(news, keywords, text)


def match_tickers(entries: DataFrame, aliases: dict[str, list[str]], title: str = "title", summary: str = "summary") -> DataFrame:
    """Feed entries matched to tickers by symbol or company name at word boundaries; one row per ticker."""
    body = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit("")))
    import re

    tests = []
    for ticker, names in aliases.items():
        pattern = "(?i)\\b(?:" + "|".join(re.escape(n) for n in [ticker, *names]) + ")\\b"
        tests.append(F.when(body.rlike(pattern), F.lit(ticker)))
    return entries.withColumn("ticker", F.explode_outer(F.array_compact(F.array(*tests)))).where("ticker is not null")


# ---- TF-IDF -----------------------------------------------------------------


def _stop(words: list[str] | None) -> list[str]:
    return words if words is not None else sorted(set(english_stop_words()) | set(domain_stop_words()))


def text_terms(df: DataFrame, id_col: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, tf): word uni- and bigrams after stop-word removal, counted inside the row.

    A row's terms are sorted and cut into runs, so neither texts nor repeated terms are shuffled.  ``id_col``
    identifies the rows.
    """
    stop = _stop(stop_words)
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    rows = df.select(id_col, kept.alias("_w"))
    after = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), after, lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.select(id_col, F.sort_array(F.concat("_w", pairs)).alias("_t"))
    # no filter on the size: Spark would push it down and evaluate the arrays twice
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0))), lambda i: (i == 0) | ~F.get("_t", i).eqNullSafe(F.get("_t", i - 1)))
    rows = rows.select(id_col, "_t", begins.alias("_s"))
    counted = F.transform("_s", lambda s, k: F.struct(F.get("_t", s).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - s).cast("long").alias("tf")))
    return rows.select(id_col, F.explode_outer(counted).alias("_x")).select(id_col, "_x.term", "_x.tf").where("term is not null")


def vocabulary(terms: DataFrame, n_docs: Column | int, min_df: int = 2, max_df: float = 0.80, max_features: int | None = None) -> DataFrame:
    """(term, df, total): every term within the df bounds, or with ``max_features`` that many of the most frequent."""
    vocab = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    vocab = vocab.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return vocab if max_features is None else vocab.orderBy(F.desc("total"), "term").limit(max_features)


def tfidf_weights(
    df: DataFrame,
    id_col: str,
    text: str,
    stop_words: list[str] | None = None,
    min_df: int = 2,
    max_df: float = 0.80,
    max_features: int | None = None,
    terms: DataFrame | None = None,
    floor: float | None = None,
) -> DataFrame:
    """(id, term, weight): (1+ln tf) * (ln((1+n)/(1+df))+1), unit length per document; with ``floor`` no smaller weights.

    Texts are weighed by blocks of documents (``term_blocks``).  ``terms``: what ``text_terms`` gives, counted
    by term; with ``max_features`` it is read twice, and the caller has it written.
    """
    if terms is None and max_features is None:
        return term_blocks.weights(df, id_col, text, _stop(stop_words), min_df, max_df, floor)
    terms = text_terms(df, id_col, text, stop_words) if terms is None else terms
    n_docs = df.agg(F.count("*")).scalar()
    idf = F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    if max_features is None:
        rows = terms.withColumn("df", F.count("*").over(W.partitionBy("term"))).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).withColumn("idf", idf)
    else:
        vocab = vocabulary(terms, n_docs, min_df, max_df, max_features)
        rows = terms.join(vocab.select("term", idf.alias("idf")), "term")
    raw = (1.0 + F.ln("tf")) * F.col("idf")
    docs = rows.groupBy(id_col).agg(F.collect_list(F.struct("term", raw.alias("raw"))).alias("_x"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
    docs = docs.select(id_col, "_x", norm.alias("_norm")).select(id_col, "_norm", F.explode_outer("_x").alias("_x"))
    docs = docs.select(id_col, F.col("_x.term").alias("term"), (F.col("_x.raw") / F.nullif("_norm", F.lit(0.0))).alias("weight"))
    return docs if floor is None else docs.where(F.col("weight") >= floor)


def top_meaningful(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The ``n`` best-scored terms that pass the quality predicate, ties by name.

    The predicate is asked of the best ``4 n`` terms, then of four times as many while too few of them
    pass: each turn is one job, and it mostly ends with the first.
    """
    scores = settle(scores)
    some = 4 * n
    while True:
        best = scores.orderBy(F.desc(score), "term").limit(some)
        kept = best.where(is_meaningful(F.col("term"))).orderBy(F.desc(score), "term").limit(n)
        if kept.count() == n or best.count() < some:
            return kept
        some *= 4


def top_terms(df: DataFrame, id_col: str, text: str, n: int, score: Callable[[Column], Column], stop_words: list[str] | None = None, min_df: int = 2, max_df: float = 0.80) -> DataFrame:
    """(term, score): the ``n`` best meaningful terms by a score that rises with the sum of their weights, ties by name.

    A weight is 1 at most, so no sum is above the number of the term's documents.  Terms in a thousandth of the
    documents are summed first; if the ``n``-th sum is below that number, or there is none, it is lowered and
    all is summed once more.
    """
    least = max(min_df, df.count() // 1000)
    while True:
        scores = term_blocks.totals(df, id_col, text, _stop(stop_words), min_df, max_df, least).withColumn("score", score(F.col("total")))
        kept = top_meaningful(scores, n)
        found, last = kept.agg(F.count("*"), F.min("total")).first()
        if least <= min_df or (found == n and (n == 0 or last >= least)):
            return kept.select("term", "score")
        least = max(min_df, min(least - 1, int(last)) if found == n else least // 16)


def corpus_keywords(df: DataFrame, id_col: str, text: str, n: int = config.TOP_N_KEYWORDS, **options: object) -> DataFrame:
    """Top ``n`` meaningful terms by mean weight over all documents, to 12 places, so that sums in another order tie alike."""
    n_docs = df.agg(F.count("*")).scalar()
    if options.get("terms") is None and options.get("max_features") is None:
        options = {k: v for k, v in options.items() if k not in ("terms", "max_features")}
        return top_terms(df, id_col, text, n, lambda total: F.round(total / n_docs, 12), **options)
    scores = tfidf_weights(df, id_col, text, **options).groupBy("term").agg(F.round(F.sum("weight") / n_docs, 12).alias("score"))
    return top_meaningful(scores, n)


def document_keywords(df: DataFrame, id_col: str, text: str, n: int = 5, floor: float = 0.2, **options: object) -> DataFrame:
    """Top ``n`` meaningful terms per document with weight at least ``floor``."""
    weights = tfidf_weights(df, id_col, text, floor=floor, **options).where(is_meaningful(F.col("term")))
    w = W.partitionBy(id_col).orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def keyword_document_frequency(doc_keywords: DataFrame) -> DataFrame:
    return doc_keywords.groupBy("term").agg(F.count("*").alias("documents"))


# ---- weights ----------------------------------------------------------------


def usable_weights(summary: DataFrame, floor: str = config.KEYWORD_GRADE_FLOOR, min_car: float = config.MIN_KEYWORD_CAR) -> DataFrame:
    """Keyword weights that pass the grade and size filters; without grades only size counts."""
    rank = F.when(F.col("signal_grade") == "A", 0).when(F.col("signal_grade") == "B", 1).otherwise(2)
    rows = summary
    if "signal_grade" in summary.columns:
        rows = rows.where(rank <= {"A": 0, "B": 1, "C": 2}[floor])
    return rows.where(F.abs("avg_CAR") >= min_car).select("keyword", "avg_CAR")


def _cars(weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(float(v)).alias("car")) for k, v in weights.items()])


def _contained(text: Column, weights: dict[str, float]) -> Column:
    return F.filter(_cars(weights), lambda e: F.contains(F.lower(text), e["k"]))


def adjusted_signal(text: Column, signal: Column, weights: dict[str, float], limit: float = config.MAX_SIGNAL_ADJUSTMENT) -> Column:
    """signal + clipped sum of the CARs of contained keywords, clipped to +-1."""
    if not weights:
        return signal.cast("double")
    total = F.aggregate(_contained(text, weights), F.lit(0.0), lambda a, e: a + e["car"])
    return clip(signal + clip(total, -limit, limit), -1.0, 1.0)


def impact_weight(text: Column, weights: dict[str, float]) -> Column:
    """min(2, 1 + 10*|CAR|) of the strongest contained keyword, else 1."""
    if not weights:
        return F.lit(1.0)
    best = F.aggregate(_contained(text, weights), F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e["car"])))
    return F.least(F.lit(2.0), 1.0 + best * 10)


def best_keyword(text: Column, weights: dict[str, float]) -> Column:
    """Contained keyword with the largest |CAR| as struct(abs_car, k, car); NULL when none."""
    if not weights:
        return F.lit(None).cast("struct<abs_car:double,k:string,car:double>")
    ranked = F.transform(_contained(text, weights), lambda e: F.struct(F.abs(e["car"]).alias("abs_car"), e["k"].alias("k"), e["car"].alias("car")))
    return F.array_max(ranked)


def adjusted_signals(rows: DataFrame, weights: DataFrame, text: str = "headline", signal: str = "signal", limit: float = config.MAX_SIGNAL_ADJUSTMENT) -> DataFrame:
    """``adjusted_signal`` for a weight table (keyword, avg_CAR) of any size, as column ``adjusted``."""
    got = with_weights(rows, weights, text)
    return got.withColumn("adjusted", clip(F.col(signal) + clip(F.col("keyword_total"), -limit, limit), -1.0, 1.0)).drop("keyword_total", "best_keyword")


def weight_of_best(best: Column) -> Column:
    """The impact weight of the strongest contained keyword, 1 without one."""
    return F.least(F.lit(2.0), 1.0 + F.coalesce(best["abs_car"], F.lit(0.0)) * 10)


def impact_weights(rows: DataFrame, weights: DataFrame, text: str = "headline") -> DataFrame:
    """``impact_weight`` for a weight table of any size, as column ``keyword_w``."""
    return with_weights(rows, weights, text).withColumn("keyword_w", weight_of_best(F.col("best_keyword"))).drop("keyword_total", "best_keyword")


def agreement_weight(lex: Column, sentiment: Column) -> Column:
    """Boost when lexicon and model agree, damp when they differ."""
    both = lex * sentiment
    return F.when(both > 0, 1 + 0.5 * F.abs(lex)).when(both < 0, F.greatest(F.lit(0.3), 1 - 0.7 * F.abs(lex))).otherwise(1.0)


def sentiment_keywords(scored: DataFrame, label: str, keywords: list[str] | DataFrame, top: int = 5, threshold: float = config.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Most frequent known keywords per ticker in confident headlines of one label."""
    rows = scored.where((F.col("label_name") == label) & (F.col("confidence") >= threshold))
    counts = match(rows.select("ticker", "headline"), keywords).groupBy("ticker", "keyword").agg(F.count("*").alias("n"))
    return _top(counts, "keyword", top)


def frequent_words(scored: DataFrame, label: str, top: int = 5, threshold: float = config.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Fallback without keywords: frequent words, stop words removed from the first 3*top."""
    rows = scored.where((F.col("label_name") == label) & (F.col("confidence") >= threshold))
    words = F.filter(F.split(F.trim(F.lower("headline")), r"\s+"), lambda w: F.length(w) > 0)
    counts = rows.select("ticker", F.explode(words).alias("keyword")).groupBy("ticker", "keyword").agg(F.count("*").alias("n"))
    first = _top(counts, "keyword", top * 3).where(~F.col("keyword").isin(kd.UNIGRAM_STOP_WORDS)).drop("rank")
    return _top(first, "keyword", top)


def _top(counts: DataFrame, col: str, top: int) -> DataFrame:
    w = W.partitionBy("ticker").orderBy(F.desc("n"), col)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


