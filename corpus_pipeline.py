"""A cleaning pipeline over ``documents``: each stage keeps or changes whole documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns
of ``documents``; the last adds ``n_words`` and ``copies``.  ``run`` writes each stage to the shared
folder and reads it back, so a lost executor repeats one stage at most.

Rows with a null doc_id pass all stages but the join's and the removal's decisions, which need an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import decontaminate, mixing, ngram_join, substring_dedup, toxicity
from tapewire.llm.tables import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the first category's model rejects go."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.toxicity_labels())
    return toxicity.score(docs.select(COLUMNS), chain).where("p_toxic < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays, and of its repeated
    rows one."""
    member = ngram_join.jaccard_components(docs)
    gone = saved(member.where("component_id <> doc_id").select("doc_id").distinct())  # ids only; read three times
    kept = docs.select(COLUMNS).join(gone, "doc_id", "left_anti")
    many = kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(many, "doc_id", "left_anti").select(COLUMNS)
    return once.unionByName(kept.join(many, "doc_id", "left_semi").select(COLUMNS).dropDuplicates(["doc_id"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated word windows are cut out of the later documents; a document of which nothing is left goes."""
    cut = substring_dedup.remove_repeats(docs, carry=["lang", "source", "n_chars"], original=True)
    cut = cut.where("n_removed = 0 OR n_removed < n_words")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(COLUMNS).join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents with the number of copies that it takes of each."""
    return mixing.mixed_documents(docs.select(COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaked),
    ("source_mixing", mix_sources),
]

#: Trained weights and hashed rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
