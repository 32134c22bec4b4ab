"""A spread of registered queries against DuckDB on the small data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

NAMES = [
    "AG01_daily_signals",
    "BT03_metrics_by_ticker",
    "JN01_forward_asof",
    "JN07_keyword_table_match",
    "WN12_exact_quantiles",
    "WN13_average_rank",
    "WN19_rebalance_calendar",
    "STA01_hit_rate",
    "STA12_student_t_tail",
    "MC01_macro_snapshots",
    "MC07_sector_exposure",
    "TX01_lexicon_score",
    "TX13_syndication_dedup",
    "SRC09_compact_date_json",
    "ML03_class_metrics",
    "ST04_daily_signal_stream",
    "WN15_drawdown_blocks",
    "ML02_stratified_split",
    "PRJ20_class_sample",
    "SRC22_content_hash",
    "SRC25_run_states",
    "TX02_negation",
    "TX09_weight_table",
    "JN07_document_keywords",
    "SO08_keyword_table",
    "STA15_keyword_table",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(norm(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    assert got == want


def test_registry_is_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) > 200


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
