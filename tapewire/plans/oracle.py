"""Shared views of the check SQL (DuckDB dialect), written independently of the Spark jobs."""

from __future__ import annotations

from tapewire.plans.fixtures import COMMODITIES, COMMODITY_SCALE, LABELS, SERIES, SERIES_SCALE, SOURCES, TEMPLATES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(col: str, mapping: dict, quote: bool = True) -> str:
    whens = " ".join(f"WHEN {_quote(k) if isinstance(k, str) else k} THEN {_quote(v) if quote else v}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


_HEADLINE = _case("o_orderkey % 15", dict(enumerate(TEMPLATES)))
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

# name -> (names it needs, SQL)
CTES: dict[str, tuple[str, str]] = {
    "px": (
        "",
        """SELECT CAST(l_shipdate AS DATE) + CASE isodow(l_shipdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date, p_brand AS ticker,
 100.0::DOUBLE + CAST(SUM(CAST(round(l_discount*100) AS BIGINT) - CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS close,
 SUM(l_quantity) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    ),
    "cal": ("px", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px)"),
    "panel": ("px cal", "SELECT px.*, cal.pos FROM px JOIN cal USING (date)"),
    "news": (
        "",
        f"""SELECT o_orderkey AS headline_id, CAST(o_orderdate AS DATE) AS date, 'Brand#' || (1 + o_custkey % 25) AS ticker,
 replace({_HEADLINE}, '{{ticker}}', 'Brand#' || (1 + o_custkey % 25)) AS headline,
 {_case('o_orderpriority', SOURCES)} AS source, o_orderstatus, o_totalprice FROM orders""",
    ),
    "scored": (
        "news",
        f"""SELECT headline_id, date, ticker, headline, source, {_case('o_orderstatus', LABELS)} AS label_name,
 least(1.0::DOUBLE, 0.3::DOUBLE + o_totalprice / 600000.0::DOUBLE) AS confidence,
 {_case('o_orderstatus', {'F': 1, 'O': 0, 'P': -1}, quote=False)} AS signal FROM news""",
    ),
    "sectors": (
        "",
        """SELECT DISTINCT p_brand AS ticker, 'Sector' || (CAST(substr(p_brand, 7) AS INT) % 5) AS sector FROM part
 WHERE CAST(substr(p_brand, 7) AS INT) % 5 < 4""",
    ),
    "vix": ("", f"SELECT CAST(o_orderdate AS DATE) AS date, 10.0::DOUBLE + (SUM({_CENTS})::BIGINT % 2400) / 100.0::DOUBLE AS level FROM orders GROUP BY 1"),
    "macro": (
        "",
        "SELECT series, date, CASE series "
        + " ".join(f"WHEN '{s}' THEN {SERIES_SCALE[s][0]}::DOUBLE + {SERIES_SCALE[s][1]}::DOUBLE * c" for s in SERIES)
        + f" END AS value FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {_case('o_orderkey % 7', dict(enumerate(SERIES)))} AS series,"
        f" SUM({_CENTS})::BIGINT % 1000 AS c FROM orders GROUP BY 1, 2)",
    ),
    "commod": (
        "",
        "SELECT series, date, CASE series "
        + " ".join(f"WHEN '{s}' THEN {COMMODITY_SCALE[s][0]}::DOUBLE + {COMMODITY_SCALE[s][1]}::DOUBLE * c" for s in COMMODITIES)
        + f" END AS price FROM (SELECT CAST(l_shipdate AS DATE) AS date, {_case('l_orderkey % 4', dict(enumerate(COMMODITIES)))} AS series,"
        " SUM(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT % 1000 AS c FROM lineitem GROUP BY 1, 2)",
    ),
    # Daily signals of the confident headlines.
    "conf": ("scored", "SELECT * FROM scored WHERE confidence >= 0.7"),
    "sig": (
        "conf",
        "SELECT date, ticker, round(avg(signal), 4) AS signal, round(avg(confidence), 4) AS avg_confidence, count(*) AS headline_count FROM conf GROUP BY 1, 2",
    ),
    "nextret": (
        "panel",
        "SELECT a.date, a.ticker, b.close / a.close - 1 AS next_ret FROM panel a JOIN panel b ON a.ticker = b.ticker AND b.pos = a.pos + 1",
    ),
    "ret": (
        "panel",
        "SELECT a.date, a.ticker, a.pos, a.close, a.volume, a.close / b.close - 1 AS ret FROM panel a LEFT JOIN panel b ON a.ticker = b.ticker AND b.pos = a.pos - 1",
    ),
    "events_bt": (
        "sig nextret",
        """SELECT date, ticker, signal, position, position * next_ret - abs(position) * 0.0015::DOUBLE AS strategy_return,
 position * next_ret AS gross_strategy_return, next_ret AS benchmark_return, abs(position) * 0.0015::DOUBLE AS cost_drag
 FROM (SELECT *, CASE WHEN signal > 0.6 THEN 1 WHEN signal < -0.6 THEN -1 ELSE 0 END AS position FROM sig JOIN nextret USING (date, ticker))""",
    ),
    # Capped, confidence-weighted daily signals.
    "capped": (
        "conf",
        """SELECT date, ticker, avg(signal * confidence) AS signal, count(*) AS headline_count FROM (
 SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY confidence DESC, headline_id) AS rn FROM conf) WHERE rn <= 3 GROUP BY 1, 2""",
    ),
    # The same of weekly cross-sections.
    "wscored": ("scored", "SELECT * REPLACE (CAST(date_trunc('week', date) AS DATE) AS date) FROM scored"),
    "wcapped": (
        "wscored",
        """SELECT date, ticker, avg(signal * confidence) AS signal, count(*) AS headline_count FROM (
 SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY confidence DESC, headline_id) AS rn FROM wscored WHERE confidence >= 0.7) WHERE rn <= 3 GROUP BY 1, 2""",
    ),
    "binary_sig": ("conf", "SELECT date, ticker, avg(CAST(signal AS DOUBLE)) AS signal, count(*) AS headline_count FROM conf GROUP BY 1, 2"),
    # Directional headlines counted per (date, ticker, signal) with forward returns.
    "dircount": (
        "scored",
        "SELECT date, ticker, signal, count(*) AS n FROM scored WHERE confidence >= 0.5 AND label_name NOT IN ('neutral', 'uncertain') GROUP BY ALL",
    ),
    "fwd": (
        "panel",
        "SELECT a.ticker, a.pos, "
        + ", ".join(f"(p{k}.close - a.close) / a.close AS return_lag_{k}" for k in (1, 2, 3, 5, 10))
        + " FROM panel a "
        + " ".join(f"LEFT JOIN panel p{k} ON p{k}.ticker = a.ticker AND p{k}.pos = a.pos + {k}" for k in (1, 2, 3, 5, 10)),
    ),
    "srcount": (
        "dircount cal fwd",
        """SELECT s.date, s.ticker, s.signal, s.n, f.* EXCLUDE (ticker) FROM (
 SELECT d.*, c.pos FROM dircount d ASOF JOIN cal c ON d.date <= c.date) s JOIN fwd f USING (ticker, pos) WHERE return_lag_1 IS NOT NULL""",
    ),
    "srrow": (
        "scored cal fwd",
        """SELECT s.*, f.* EXCLUDE (ticker, pos) FROM (
 SELECT d.*, c.pos FROM (SELECT * FROM scored WHERE confidence >= 0.5 AND label_name NOT IN ('neutral', 'uncertain')) d ASOF JOIN cal c ON d.date <= c.date) s
 JOIN fwd f USING (ticker, pos) WHERE return_lag_1 IS NOT NULL""",
    ),
}


def with_ctes(names: list[str], extra: str, body: str) -> str:
    """Compose the WITH clause: shared views in dependency order, then ``extra``, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][0].split():
                visit(need)
            if name not in order:
                order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    recursive = "RECURSIVE " if "RECURSIVE_MARK" in extra else ""
    prefix = f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else ""
    return prefix.replace("/*RECURSIVE_MARK*/", "") + body
