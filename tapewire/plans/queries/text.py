"""Lexicon, keyword and event-study operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire import keyword_data as kd
from tapewire.functions.batches import spread
from tapewire.functions.settle import settle
from tapewire.operators import event_study as es
from tapewire.operators import keywords as kw
from tapewire.operators import lexicon as lx
from tapewire.operators import sets as st
from tapewire.operators.patterns import with_keywords
from tapewire.plans.fixtures import KEYWORDS, Market
from tapewire.plans.oracle_stats import t_p_sql
from tapewire.plans.registry import query

_LEX = ", ".join(
    f"('{p}', {w}::DOUBLE, '{side}', {i})" for i, (p, w, side) in enumerate(lx.Lexicon().entries())
)
_NEG = "|".join(lx.Lexicon().negations)
_COMBOS = " UNION ALL ".join(
    f"SELECT h, {amount}::DOUBLE AS bonus, '{note}' AS note, {i} AS ord FROM heads WHERE " + " AND ".join(f"contains(t, '{r}')" for r in req)
    for i, (req, amount, note) in enumerate(lx.Lexicon().combinations)
)
# Greedy longest-first spans per distinct headline, stepped one candidate at a time.
LEX_CTES = f"""/*RECURSIVE_MARK*/heads AS MATERIALIZED (SELECT h, lower(h) AS t FROM (SELECT DISTINCT headline AS h FROM news)),
lex AS MATERIALIZED (SELECT * FROM (VALUES {_LEX}) AS v(phrase, weight, side, ord)),
cand AS MATERIALIZED (SELECT h, t, phrase, weight, side, s, s + length(phrase) AS e, row_number() OVER (PARTITION BY h ORDER BY ord, s) AS k FROM (
 SELECT h, t, phrase, weight, side, ord, unnest(range(1, length(t) - length(phrase) + 2)) AS s FROM heads JOIN lex ON contains(t, phrase))
 WHERE substr(t, s, length(phrase)) = phrase AND NOT (s > 1 AND regexp_matches(substr(t, s - 1, 1), '[a-z]'))
 AND NOT regexp_matches(substr(t, s + length(phrase), 1), '^[a-z]$')),
walk AS (SELECT h, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS taken FROM heads UNION ALL
 SELECT w.h, c.k, CASE WHEN len(list_filter(w.taken, lambda x: (x.s <= c.s AND c.s < x.e) OR (x.s < c.e AND c.e <= x.e))) > 0 THEN w.taken
 ELSE list_append(w.taken, struct_pack(s := c.s, e := c.e)) END FROM walk w JOIN cand c ON c.h = w.h AND c.k = w.k + 1),
spans AS MATERIALIZED (SELECT h, arg_max(taken, k) AS taken FROM walk GROUP BY 1),
kept AS MATERIALIZED (SELECT c.*, c.weight * CASE WHEN regexp_matches(c.t, '(^|[^a-z0-9])({_NEG})([^a-z0-9]+[a-z0-9]+){{0,2}}[^a-z0-9]+' || c.phrase) THEN -0.8 ELSE 1 END AS value
 FROM cand c JOIN spans s ON s.h = c.h WHERE list_contains(s.taken, struct_pack(s := c.s, e := c.e))),
combos AS MATERIALIZED ({_COMBOS}),
lexed AS MATERIALIZED (SELECT h AS headline, raw_score, tanh(raw_score / 5) AS normalised_score, bull, bear, neu, notes FROM (
 SELECT heads.h, coalesce(b.v, 0) + coalesce(c.v, 0) AS raw_score, coalesce(bull, []) AS bull, coalesce(bear, []) AS bear, coalesce(neu, []) AS neu, coalesce(notes, []) AS notes FROM heads
 LEFT JOIN (SELECT h, sum(value) AS v, list(phrase ORDER BY k) FILTER (side = 'bullish') AS bull, list(phrase ORDER BY k) FILTER (side = 'bearish') AS bear,
 list(phrase ORDER BY k) FILTER (side = 'neutral') AS neu FROM kept GROUP BY 1) b ON b.h = heads.h
 LEFT JOIN (SELECT h, sum(bonus) AS v, list(note ORDER BY ord) AS notes FROM combos GROUP BY 1) c ON c.h = heads.h)),
lexnews AS MATERIALIZED (SELECT n.headline_id, n.ticker, l.*, CASE WHEN normalised_score > 0.15 THEN 'bullish' WHEN normalised_score < -0.15 THEN 'bearish' ELSE 'neutral' END AS lex_label
 FROM news n JOIN lexed l USING (headline))"""


@query(
    "TX01_lexicon_score",
    "headline raw_score:d normalised_score:d lex_label matched_bullish:a matched_bearish:a matched_neutral:a combination_bonuses:a",
    "news",
    """SELECT DISTINCT headline, raw_score, normalised_score, lex_label, bull AS matched_bullish, bear AS matched_bearish, neu AS matched_neutral, notes AS combination_bonuses FROM lexnews""",
    LEX_CTES,
)
def _(m: Market):
    return lx.score_texts(m.news.select("headline").distinct())


@query("TX03_corpus_scores", "headline_id:i raw_score:d normalised_score:d lex_label", "news", "SELECT * FROM lexnews", LEX_CTES)
def _(m: Market):
    return lx.score_texts(m.news.select("headline_id", "headline"), dedupe=True)


@query(
    "TX02_negation",
    "headline_id:i negated_score:d",
    "news",
    "SELECT headline_id, CASE WHEN headline_id % 3 = 0 THEN -0.8::DOUBLE ELSE 1 END AS negated_score FROM news",
)
def _(m: Market):
    """The scorer's own rule: a word within three tokens after a negation counts -0.8 of its weight."""
    lead = F.when(F.pmod("headline_id", F.lit(3)) == 0, "it is not a").when(F.pmod("headline_id", F.lit(3)) == 1, "no one two three").otherwise("it is a")
    own = lx.Lexicon(bullish={"zenith": 1.0}, bearish={}, neutral={}, combinations=[])
    rows = m.news.select("headline_id", F.concat_ws(" ", "headline", lead, F.lit("zenith")).alias("headline"))
    return lx.score_texts(rows, lexicon=own).select("headline_id", F.col("raw_score").alias("negated_score"))


@query(
    "TX04_ticker_lexicon",
    "ticker avg_score:d4 bullish_count:i bearish_count:i headline_count:i bullish_phrases:a bearish_phrases:a",
    "news",
    """SELECT a.ticker, avg_score, bullish_count, bearish_count, headline_count, coalesce(bull, []) AS bullish_phrases, coalesce(bear, []) AS bearish_phrases FROM (
 SELECT ticker, round(avg(normalised_score), 4) AS avg_score, count(*) FILTER (lex_label = 'bullish') AS bullish_count, count(*) FILTER (lex_label = 'bearish') AS bearish_count, count(*) AS headline_count FROM lexnews GROUP BY 1) a
 LEFT JOIN (SELECT ticker, list(p ORDER BY n DESC, p)[1:5] AS bull FROM (SELECT ticker, p, count(*) AS n FROM (SELECT ticker, unnest(bull) AS p FROM lexnews) GROUP BY 1, 2) GROUP BY 1) b USING (ticker)
 LEFT JOIN (SELECT ticker, list(p ORDER BY n DESC, p)[1:5] AS bear FROM (SELECT ticker, p, count(*) AS n FROM (SELECT ticker, unnest(bear) AS p FROM lexnews) GROUP BY 1, 2) GROUP BY 1) c USING (ticker)""",
    LEX_CTES,
)
def _(m: Market):
    return lx.ticker_lexicon(lx.score_texts(m.news.select("ticker", "headline"), dedupe=True))


@query(
    "TX05_label_shares",
    "lex_label n:i mean_score:d share:d",
    "news",
    "SELECT lex_label, count(*) AS n, avg(normalised_score) AS mean_score, count(*) / (SELECT count(*) FROM lexnews) AS share FROM lexnews GROUP BY 1",
    LEX_CTES,
)
def _(m: Market):
    return lx.label_shares(lx.score_texts(m.news.select("headline"), dedupe=True))


@query(
    "AG11_phrase_frequency",
    "phrase count:i",
    "news",
    "SELECT p AS phrase, count(*) AS count FROM (SELECT unnest(bear) AS p FROM lexnews) GROUP BY 1 ORDER BY count DESC, phrase LIMIT 20",
    LEX_CTES,
)
def _(m: Market):
    return lx.top_phrases(lx.score_texts(m.news.select("headline"), dedupe=True), "bearish", 20)


_KW = ", ".join(f"('{k}')" for k in KEYWORDS)


@query(
    "JN07_keyword_in_headline",
    "keyword ticker n:i",
    "news",
    f"SELECT k AS keyword, ticker, count(*) AS n FROM news JOIN (VALUES {_KW}) v(k) ON contains(lower(headline), k) GROUP BY ALL",
)
def _(m: Market):
    return kw.match_listed(m.news, KEYWORDS).groupBy("keyword", "ticker").agg(F.count("*").alias("n"))


WORD_SQL = "SELECT DISTINCT unnest(string_split(lower(headline), ' ')) AS w FROM news"


def headline_words(m: Market):
    """A keyword table: the distinct words of all headlines."""
    return m.news.select(F.explode(F.split(F.lower("headline"), " ")).alias("keyword")).distinct()


@query(
    "JN07_keyword_table_match",
    "keyword n:i",
    "news",
    f"SELECT w AS keyword, count(*) AS n FROM news JOIN ({WORD_SQL}) k ON contains(lower(headline), w) GROUP BY 1",
)
def _(m: Market):
    return kw.match_table(m.news.select("headline"), headline_words(m)).groupBy("keyword").agg(F.count("*").alias("n"))


@query(
    "JN07_document_keywords",
    "doc_id:i keywords:i first last",
    "",
    """SELECT doc_id, count(w) AS keywords, min(w) AS first, max(w) AS last FROM documents LEFT JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{6,}')) AS w FROM benchmark) k ON contains(lower(text), w) GROUP BY doc_id""",
)
def _(m: Market):
    words = m.table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("keyword")).distinct()
    rows = with_keywords(m.documents.select("doc_id", "text"), words, "text")
    return rows.select("doc_id", F.size("keywords").alias("keywords"), F.array_min("keywords").alias("first"), F.array_max("keywords").alias("last"))


_ALIASES = {"Brand#1": [], "Brand#2": ["guidance"], "GS": ["Goldman Sachs", "Goldman"], "SEC": []}


@query(
    "JN08_alias_match",
    "headline_id:i matched",
    "news",
    """SELECT headline_id, matched FROM news JOIN (VALUES ('Brand#1', '(?i)\\b(Brand#1)\\b'), ('Brand#2', '(?i)\\b(Brand#2|guidance)\\b'), ('GS', '(?i)\\b(GS|Goldman Sachs|Goldman)\\b'),
 ('SEC', '(?i)\\b(SEC)\\b')) v(matched, p) ON regexp_matches(headline || ' ' || source, p)""",
)
def _(m: Market):
    rows = m.news.select("headline_id", "headline", "source")
    return kw.match_tickers(rows, _ALIASES, "headline", "source").withColumnRenamed("ticker", "matched")


# The check needs a list known before a session exists, so only the domain words are removed here.
STOP = kw.domain_stop_words()
_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in kw.domain_stop_words()) + "]"
_TERMS = f"""tw AS MATERIALIZED (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP_SQL}, w)) AS ws FROM documents),
tt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM tw UNION ALL
 SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM tw)) GROUP BY 1, 2),
vo AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS total FROM tt GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * (SELECT count(*) FROM documents)),
raw AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM tt JOIN vo USING (term)),
tfidf AS MATERIALIZED (SELECT doc_id, term, raw / norm AS weight FROM raw JOIN (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1) USING (doc_id))"""


def meaningful_sql(col: str) -> str:
    names = ", ".join("'" + w.replace("'", "''") + "'" for w in kw.ticker_stop_words())
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in kw.domain_stop_words()) + "]"
    listed = ", ".join(f"'{p}'" for p in kd.FINANCE_PHRASES)
    pats = " OR ".join(f"regexp_matches({col}, '{p}')" for p in kd.FILING_PATTERNS)
    return f"""({col} IN ({listed}) OR (length({col}) >= 5 AND NOT regexp_matches({col}, '^[\\d,.\\-%/]+$') AND NOT ({pats})
 AND len(list_filter(string_split({col}, ' '), lambda t: NOT list_contains({stop}, t))) > 0 AND {col} NOT IN ({names})))"""


def texts(m: Market):
    return spread(m.documents.select("doc_id", "text"))


@query("TX06_tfidf_weights", "doc_id:i terms:i total:d5", "", "SELECT doc_id, count(*) AS terms, sum(weight) AS total FROM tfidf GROUP BY 1", _TERMS)
def _(m: Market):
    w = kw.tfidf_weights(texts(m), "doc_id", "text", STOP)
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"))


@query(
    "TX06_corpus_keywords",
    "term score:d",
    "",
    f"SELECT term, round(sum(weight) / (SELECT count(*) FROM documents), 12) AS score FROM tfidf WHERE {meaningful_sql('term')} GROUP BY 1 ORDER BY score DESC, term LIMIT 50",
    _TERMS,
)
def _(m: Market):
    return kw.corpus_keywords(texts(m), "doc_id", "text", stop_words=STOP)


_DOCKW = f"""dk AS (SELECT * FROM (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM tfidf WHERE weight >= 0.2 AND {meaningful_sql('term')}) WHERE rank <= 5)"""


@query("TX08_document_keywords", "doc_id:i term weight:d rank:i", "", "SELECT * FROM dk", _TERMS + ",\n" + _DOCKW)
def _(m: Market):
    return kw.document_keywords(texts(m), "doc_id", "text", stop_words=STOP)


@query("AG12_keyword_document_frequency", "term documents:i", "", "SELECT term, count(*) AS documents FROM dk GROUP BY 1", _TERMS + ",\n" + _DOCKW)
def _(m: Market):
    return kw.keyword_document_frequency(kw.document_keywords(texts(m), "doc_id", "text", stop_words=STOP))


@query(
    "SO02_top_keywords",
    "rank:i term",
    "",
    f"SELECT row_number() OVER (ORDER BY score DESC, term) AS rank, term FROM (SELECT term, round(sum(weight), 6) AS score FROM tfidf WHERE {meaningful_sql('term')} GROUP BY 1) ORDER BY rank LIMIT 10",
    _TERMS,
)
def _(m: Market):
    from pyspark.sql import Window as W

    top = kw.top_terms(texts(m), "doc_id", "text", 10, lambda total: F.round(total, 6), STOP)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "term")))


@query(
    "PRJ11_meaningful_keyword",
    "word kept:b",
    "",
    f"SELECT word, {meaningful_sql('word')} AS kept FROM (SELECT DISTINCT unnest(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM documents) WHERE word = trim(word) AND word <> ''",
)
def _(m: Market):
    words = m.documents.select(F.explode(F.split(F.lower(F.regexp_replace("text", r"[\t\n\f\r ]+", " ")), " ")).alias("word")).distinct()
    return words.where("word = trim(word) and word <> ''").select("word", kw.is_meaningful(F.col("word")).alias("kept"))


@query(
    "PRJ12_filing_artefact",
    "headline artefact:b",
    "news",
    "SELECT DISTINCT headline, len(list_intersect(string_split(lower(headline), ' '), ['cik','filing','item','form','exhibit','amendment','sec','edgar','registrant','pursuant'])) > 0 AS artefact FROM news",
)
def _(m: Market):
    return m.news.select("headline").distinct().withColumn("artefact", kw.is_filing_artefact(F.col("headline")))


@query(
    "TX07_stop_word_share",
    "doc_id:i words:i stop_words:i",
    "",
    """SELECT doc_id, len(ws) AS words, len(list_filter(ws, lambda w: list_contains(stop, w))) AS stop_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS ws, """
    + "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in kw.domain_stop_words()) + "] AS stop FROM documents)",
)
def _(m: Market):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    rows = m.documents.select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.size(F.filter("w", lambda x: x.isin(kw.domain_stop_words()))).alias("stop_words"))


@query(
    "TX12_filter_report",
    "kept:b n:i",
    "",
    f"SELECT {meaningful_sql('term')} AS kept, count(*) AS n FROM vo GROUP BY 1",
    _TERMS,
)
def _(m: Market):
    return kw.filter_report(kw.vocabulary(kw.text_terms(texts(m), "doc_id", "text", STOP), m.documents.agg(F.count("*")).scalar()), "term")


CARS = {"investigation": -0.012, "guidance": 0.004, "share buyback": 0.02, "dividend": -0.006}
_CASE_SUM = " + ".join(f"CASE WHEN contains(lower(headline), '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in CARS.items())
_CASE_MAX = ", ".join(f"CASE WHEN contains(lower(headline), '{k}') THEN {abs(v)}::DOUBLE ELSE 0 END" for k, v in CARS.items())


@query(
    "TX09_keyword_adjusted_signal",
    "headline_id:i adjusted:d",
    "scored",
    f"SELECT headline_id, greatest(-1, least(1, signal + greatest(-0.25, least(0.25, {_CASE_SUM})))) AS adjusted FROM scored",
)
def _(m: Market):
    return m.scored.withColumn("adjusted", kw.adjusted_signal(F.col("headline"), F.col("signal"), CARS))


@query("TX10_keyword_impact", "headline_id:i keyword_w:d", "news", f"SELECT headline_id, least(2, 1 + 10 * greatest({_CASE_MAX})) AS keyword_w FROM news")
def _(m: Market):
    return m.news.withColumn("keyword_w", kw.impact_weight(F.col("headline"), CARS))


_WCARS = f"wcar AS MATERIALIZED (SELECT w, (length(w) * 7 % 11 - 5) / 1000.0::DOUBLE AS car FROM ({WORD_SQL}) WHERE length(w) > 0),\nwhit AS MATERIALIZED (SELECT h, sum(car) AS total, max(abs(car)) AS best FROM (SELECT DISTINCT headline AS h FROM news) JOIN wcar ON contains(lower(h), w) GROUP BY 1)"


def word_weights(m: Market):
    """A weight table: a CAR for every word of the headlines."""
    n = F.length("keyword")
    return headline_words(m).where(n > 0).select("keyword", (((n * 7) % 11 - 5) / 1000.0).alias("avg_CAR"))


@query(
    "TX09_weight_table",
    "headline_id:i adjusted:d",
    "scored",
    "SELECT headline_id, greatest(-1, least(1, signal + greatest(-0.25, least(0.25, coalesce(total, 0))))) AS adjusted FROM scored LEFT JOIN whit ON h = headline",
    _WCARS,
)
def _(m: Market):
    return kw.adjusted_signals(m.scored.select("headline_id", "headline", "signal"), word_weights(m))


@query("TX10_weight_table", "headline_id:i keyword_w:d", "news", "SELECT headline_id, least(2, 1 + 10 * coalesce(best, 0)) AS keyword_w FROM news LEFT JOIN whit ON h = headline", _WCARS)
def _(m: Market):
    return kw.impact_weights(m.news.select("headline_id", "headline"), word_weights(m))


@query(
    "TX01_document_scores",
    "doc_id:i raw_score:d normalised_score:d lex_label",
    "",
    "SELECT doc_id, raw_score, normalised_score, CASE WHEN normalised_score > 0.15 THEN 'bullish' WHEN normalised_score < -0.15 THEN 'bearish' ELSE 'neutral' END AS lex_label FROM documents JOIN lexed ON headline = text",
    LEX_CTES.replace("SELECT DISTINCT headline AS h FROM news", "SELECT DISTINCT text AS h FROM documents").split(",\nlexnews")[0],
)
def _(m: Market):
    return lx.score_texts(texts(m).withColumnRenamed("text", "headline"))


@query(
    "TX11_lexicon_agreement",
    "headline_id:i lexicon_w:d",
    "scored",
    """SELECT s.headline_id, CASE WHEN normalised_score * signal > 0 THEN 1 + 0.5 * abs(normalised_score) WHEN normalised_score * signal < 0 THEN greatest(0.3, 1 - 0.7 * abs(normalised_score)) ELSE 1 END AS lexicon_w
 FROM scored s JOIN lexnews USING (headline_id)""",
    LEX_CTES,
)
def _(m: Market):
    rows = lx.score_texts(m.scored, dedupe=True)
    return rows.withColumn("lexicon_w", kw.agreement_weight(F.col("normalised_score"), F.col("signal").cast("double")))


@query(
    "TX13_syndication_dedup",
    "ticker headline source",
    "news",
    """SELECT ticker, headline, source FROM (SELECT *, row_number() OVER (PARTITION BY ticker, lower(headline) ORDER BY
 CASE source WHEN 'sec_edgar' THEN 1.0 WHEN 'reuters' THEN 0.9 WHEN 'guardian' THEN 0.8 WHEN 'newsapi' THEN 0.6 ELSE 0.3 END DESC, date DESC, headline, headline_id) AS rn FROM news) WHERE rn = 1""",
)
def _(m: Market):
    return st.drop_syndicated(m.news, ["ticker"])


@query(
    "SO08_sentiment_keywords",
    "ticker keyword n:i rank:i",
    "scored",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, keyword) AS rank FROM (SELECT ticker, k AS keyword, count(*) AS n FROM scored JOIN (VALUES {_KW}) v(k) ON contains(lower(headline), k)
 WHERE label_name = 'positive' AND confidence >= 0.7 GROUP BY ALL)) WHERE rank <= 5""",
)
def _(m: Market):
    return kw.sentiment_keywords(m.scored, "positive", KEYWORDS)


@query(
    "SO08_keyword_table",
    "ticker keyword n:i rank:i",
    "scored",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, keyword) AS rank FROM (SELECT ticker, w AS keyword, count(*) AS n FROM scored JOIN ({WORD_SQL}) k ON length(w) > 0 AND contains(lower(headline), w)
 WHERE label_name = 'positive' AND confidence >= 0.7 GROUP BY ALL)) WHERE rank <= 5""",
)
def _(m: Market):
    return kw.sentiment_keywords(m.scored, "positive", headline_words(m))


@query(
    "SO08_frequent_words",
    "ticker keyword n:i rank:i",
    "scored",
    """SELECT ticker, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, keyword) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, keyword) AS r0 FROM (
 SELECT ticker, keyword, count(*) AS n FROM (SELECT ticker, unnest(string_split(lower(headline), ' ')) AS keyword FROM scored WHERE label_name = 'negative' AND confidence >= 0.7) GROUP BY ALL))
 WHERE r0 <= 15 AND keyword NOT IN ('the','a','an','of','in','on','at','to','for','and','or','is','was')) WHERE rank <= 5""",
)
def _(m: Market):
    return kw.frequent_words(m.scored, "negative")


# ---- event study ------------------------------------------------------------

STUDY_CTES = f"""bn AS MATERIALIZED (SELECT pos, level / lag(level) OVER (ORDER BY pos) - 1 AS br FROM (SELECT pos, avg(close) AS level FROM panel GROUP BY 1)),
rb AS MATERIALIZED (SELECT ret.*, br FROM ret LEFT JOIN bn USING (pos)),
est AS MATERIALIZED (SELECT p.ticker, p.pos, count(r.ret) AS n, CASE WHEN var_pop(r.br) > 0 THEN regr_slope(r.ret, r.br) ELSE 0 END AS beta, avg(r.ret) AS my, avg(r.br) AS mx
 FROM panel p JOIN rb r ON r.ticker = p.ticker AND r.pos BETWEEN p.pos - 60 AND p.pos - 2 AND r.ret IS NOT NULL AND r.br IS NOT NULL GROUP BY 1, 2),
abn AS MATERIALIZED (SELECT e.ticker, e.pos, {", ".join(f"(a{i}.ret - (my - beta * mx + beta * coalesce(a{i}.br, 0))) AS ar_{i}" for i in range(5))}
 FROM est e {" ".join(f"JOIN rb a{i} ON a{i}.ticker = e.ticker AND a{i}.pos = e.pos + {i - 1} AND a{i}.ret IS NOT NULL" for i in range(5))} WHERE n >= 5 AND least(e.pos - 1, 60) >= 10),
hits AS MATERIALIZED (SELECT h.*, c.pos FROM (SELECT n.*, k AS keyword FROM news n JOIN (VALUES {_KW}) v(k) ON contains(lower(headline), k)) h ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON h.date <= c.cd),
evs AS MATERIALIZED (SELECT h.keyword, h.source, a.*, ar_0 + ar_1 + ar_2 + ar_3 + ar_4 AS car FROM hits h JOIN abn a USING (ticker, pos)),
study AS MATERIALIZED (SELECT keyword, count(*) AS event_count, round(avg(car), 6) AS avg_CAR, round(stddev_pop(car), 6) AS std_CAR, round(avg(CASE WHEN car > 0 THEN 1 ELSE 0 END), 4) AS positive_pct,
 avg(ar_0) AS ar_m1, avg(ar_1) AS ar_p0, avg(ar_2) AS ar_p1, avg(ar_3) AS ar_p2, avg(ar_4) AS ar_p3 FROM evs GROUP BY 1 HAVING count(*) >= 5)"""


def study(m: Market):
    return es.event_study(es.keyword_events(m.news, m.cal, KEYWORDS), es.abnormal_returns(m.panel))


@query(
    "STA15_event_study",
    "keyword event_count:i avg_CAR:d std_CAR:d positive_pct:d4",
    "panel cal ret news",
    "SELECT * FROM study",
    STUDY_CTES,
)
def _(m: Market):
    return study(m)


_TABLE = STUDY_CTES.replace(f"(VALUES {_KW}) v(k)", f"(SELECT w AS k FROM ({WORD_SQL}) WHERE length(w) > 0) v")


@query("STA15_keyword_table", "keyword event_count:i avg_CAR:d std_CAR:d positive_pct:d4", "panel cal ret news", "SELECT * FROM study", _TABLE)
def _(m: Market):
    return es.event_study(es.keyword_events(m.news, m.cal, headline_words(m)), es.abnormal_returns(m.panel))


_SRC = """srcars AS (SELECT * FROM evs WHERE (source, keyword) IN (SELECT (source, keyword) FROM evs GROUP BY source, keyword HAVING count(*) >= 5))"""


@query(
    "STA16_source_comparison",
    "source events:i avg_CAR:d",
    "panel cal ret news",
    "SELECT source, count(*) AS events, round(avg(car), 6) AS avg_CAR FROM srcars GROUP BY 1",
    STUDY_CTES + ",\n" + _SRC,
)
def _(m: Market):
    events = es.keyword_events(m.news, m.cal, KEYWORDS, ("source",))
    return es.source_comparison(es.event_cars(events, es.abnormal_returns(m.panel), ("source",)))


@query(
    "STA17_keyword_summary",
    "keyword event_count:i avg_CAR:d std_CAR:d positive_pct:d4 t_stat:d4 p_value:d4 signal_grade is_finance_phrase:b",
    "panel cal ret news",
    f"""SELECT *, CASE WHEN g = 'C' AND is_finance_phrase AND abs(avg_CAR) > 0.002 THEN 'B' ELSE g END AS signal_grade FROM (
 SELECT *, CASE WHEN abs(avg_CAR) > 0.01 AND p < 0.05 AND event_count >= 10 THEN 'A' WHEN abs(avg_CAR) > 0.005 AND p < 0.10 THEN 'B' ELSE 'C' END AS g, round(t, 4) AS t_stat, round(p, 4) AS p_value,
 keyword IN ('share buyback') AS is_finance_phrase FROM (SELECT *, {t_p_sql('t', '(event_count - 1)')} AS p FROM (SELECT *, avg_CAR / (std_CAR / sqrt(event_count)) AS t FROM study)))""",
    STUDY_CTES,
)
def _(m: Market):
    return es.keyword_summary(study(m))


@query(
    "RP05_car_heatmap",
    "keyword day_m1:d day_p0:d day_p1:d day_p2:d day_p3:d",
    "panel cal ret news",
    "SELECT keyword, ar_m1 AS day_m1, ar_p0 AS day_p0, ar_p1 AS day_p1, ar_p2 AS day_p2, ar_p3 AS day_p3 FROM study ORDER BY abs(avg_CAR) DESC, keyword LIMIT 10",
    STUDY_CTES,
)
def _(m: Market):
    return es.car_heatmap(study(m))


@query(
    "SO05_top_keywords_by_car",
    "keyword avg_CAR:d side",
    "panel cal ret news",
    " UNION ALL ".join(
        f"SELECT keyword, avg_CAR, '{side}' AS side FROM (SELECT * FROM study WHERE {cond} ORDER BY {order}, keyword LIMIT {n})"
        for side, cond, order, n in (("best", "true", "avg_CAR DESC", 20), ("largest", "true", "abs(avg_CAR) DESC", 10), ("positive", "avg_CAR > 0", "avg_CAR DESC", 5), ("negative", "avg_CAR < 0", "avg_CAR", 5))
    ),
    _TABLE,
)
def _(m: Market):
    s = es.event_study(es.keyword_events(m.news, m.cal, headline_words(m)), es.abnormal_returns(m.panel)).select("keyword", "avg_CAR")
    car = F.col("avg_CAR")
    out = None
    for side, rows, order, n in (("best", s, car.desc(), 20), ("largest", s, F.abs(car).desc(), 10), ("positive", s.where(car > 0), car.desc(), 5), ("negative", s.where(car < 0), car.asc(), 5)):
        top = rows.orderBy(order, "keyword").limit(n).withColumn("side", F.lit(side))
        out = top if out is None else out.unionByName(top)
    return out


@query(
    "RP06_keyword_bars",
    "keyword event_count:i avg_CAR:d abs_CAR:d",
    "panel cal ret news",
    "SELECT keyword, event_count, avg_CAR, abs(avg_CAR) AS abs_CAR FROM study",
    STUDY_CTES,
)
def _(m: Market):
    return study(m).withColumn("abs_CAR", F.abs("avg_CAR"))


_HEADTERMS = _TERMS.replace("doc_id", "headline_id").replace("lower(text)", "lower(headline)").replace("FROM documents)", "FROM news)")
_FOUND = f"found AS MATERIALIZED (SELECT term FROM (SELECT term, round(sum(weight) / (SELECT count(*) FROM news), 12) AS score FROM tfidf WHERE {meaningful_sql('term')} GROUP BY 1) ORDER BY score DESC, term LIMIT 50)"


@query(
    "EX14_keyword_study",
    "keyword in_headlines:i event_count:i avg_CAR:d t_stat:d4 p_value:d4 signal_grade",
    "panel cal ret news",
    f"""SELECT keyword, k AS in_headlines, event_count, avg_CAR, round(t, 4) AS t_stat, round(p, 4) AS p_value,
 CASE WHEN abs(avg_CAR) > 0.01 AND p < 0.05 AND event_count >= 10 THEN 'A' WHEN abs(avg_CAR) > 0.005 AND p < 0.10 THEN 'B' WHEN keyword IN ('share buyback') AND abs(avg_CAR) > 0.002 THEN 'B' ELSE 'C' END AS signal_grade
 FROM (SELECT *, {t_p_sql('t', '(event_count - 1)')} AS p FROM (SELECT *, avg_CAR / (std_CAR / sqrt(event_count)) AS t FROM study)) JOIN (SELECT keyword, count(*) AS k FROM hits GROUP BY 1) USING (keyword)""",
    _HEADTERMS + ",\n" + _FOUND + ",\n" + STUDY_CTES.replace(f"(VALUES {_KW}) v(k)", "(SELECT term AS k FROM found) v"),
)
def _(m: Market):
    """Keywords of the headlines themselves, found by weight, feed the event study as a table."""
    found = kw.corpus_keywords(m.news.select("headline_id", "headline"), "headline_id", "headline", stop_words=STOP)
    events = settle(es.keyword_events(m.news, m.cal, found.select(F.col("term").alias("keyword"))))
    s = es.keyword_summary(es.event_study(events, es.abnormal_returns(m.panel)))
    return s.join(events.groupBy("keyword").agg(F.sum("n").alias("in_headlines")), "keyword")
