"""Queries of the numbered operators over whole tables, with their check SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import decontaminate, language, language_model, mixing, ngram_join, quality, spelling, substring_dedup, token_alignment, token_counts, topk, toxicity, warc
from tapewire.llm.tables import shared_folder

#: Folder of the public tokenizer files; not part of this repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# words and A-Z lower case as all operators see them
_WORDS = "list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_ngram_jaccard_join",
    f"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="text"))} AS w FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM lists),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM lists),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.v WHERE reach.r < e.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r) AS component_id FROM sizes s JOIN reach ON v = s.doc_id GROUP BY s.doc_id, s.n
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


@query(
    "op2_substring_dedup",
    f"""
WITH words AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
starts AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM words WHERE len(w) >= 13),
firsts AS (SELECT g, min(doc_id) AS d FROM starts GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 13)) AS p FROM starts s JOIN firsts f ON f.g = s.g AND f.d < s.doc_id),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op7_benchmark_decontamination",
    f"""
WITH both_ AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS MATERIALIZED (SELECT k, id, {_WORDS.format(text=_LOWER.format(text="text"))} AS w FROM both_),
short AS (SELECT DISTINCT len(w) AS n FROM words WHERE k = 'i' AND len(w) BETWEEN 1 AND 4),
shingles AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT k, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g FROM words, short WHERE k = 'd' AND len(w) > n
 UNION ALL SELECT k, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g FROM words)),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE k = 'i' GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM shingles d JOIN shingles i ON d.k = 'd' AND i.k = 'i' AND d.g = i.g GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(c AS BIGINT) AS n_shared, c::DOUBLE / n AS containment FROM shared JOIN sizes ON id = item_id WHERE 100 * c >= 80 * n
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.toxicity_labels())
    got = toxicity.score(docs.select("doc_id", "text"), chain)
    return got.select("doc_id", "p_toxic", "p_toxic_junk", (F.col("p_toxic") >= 0.5).alias("toxic"))


def crc_is(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_is(4, 2))
    model = language.fit(docs.where("NOT held_out"))
    return language.predict(docs, model, "doc_id", "text", F.col("held_out"))


@query(
    "op10_exact_topk",
    """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_is(3, 1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~crc_is(3, 1))
    model = quality.fit(docs.where("NOT held_out"), labels)
    got = quality.score(docs, model, "doc_id", "text", F.col("held_out"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.edited(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", token_counts.sample_edits())
    return got.select("doc_id", "n_tokens", "n_tokens_after", "n_encoded", F.sha2("text_after", 256).alias("after_sha256"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir).withColumn("train", ~crc_is(7, 2)), "train")


# crc32 of a run's UTF-8 bytes from the polynomial; letters from U+00C0 to U+00FF have two bytes
_CRC = """CAST(xor(list_reduce(flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)),
  lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT)"""


@query(
    "op11_spelling_variants",
    f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format(text="text")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, length(run) AS k, CASE WHEN doc_id IS NULL THEN 1 ELSE {_CRC.format(x="doc_id || ':' || run")} END AS h FROM counted, crc),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % k AS INTEGER)) || substr(run, CAST(h % k AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS MATERIALIZED (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || '*' || substr(word, i + 1))) AS hole, length(word) AS k FROM words),
shorter AS MATERIALIZED (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = replace(c.hole, '*', '')),
near AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.hole = y.hole AND x.word <> y.word UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
told AS (SELECT a AS word, count(*) AS n_near, (list(struct_pack(n := w.n, w := w.word) ORDER BY w.n DESC, encode(w.word)))[1] AS best FROM near JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * n THEN best.w END AS form, CASE WHEN best.n >= 10 * n THEN best.n END AS form_n FROM words LEFT JOIN told USING (word)),
way(word, tip) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.tip AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN way ON way.word = f.word JOIN forms e ON e.word = way.tip WHERE e.form IS NULL
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.slipped_words(documents(spark, sf_dir)))


def contents(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(documents(spark, sf_dir), contents(f"{TOKENIZERS}/byte_bpe_50k.json"), contents(f"{TOKENIZERS}/piece_bpe_32k.model"), token_counts.PATTERN)


@query(
    "op13_warc_revisits",
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
r AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS d, first_value(page_id) OVER w AS o, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN o END AS refers_to FROM r
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}" for _ in range(2))
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), first)
    warc.deduplicate(spark, first, second)
    return warc.replayed(spark, second)
