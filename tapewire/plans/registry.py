"""Query registry: one entry per operator with its Spark job and, where SQL can say it, the check SQL.

``spec`` lists the output columns as ``name[:kind]``:

* ``t``  date, shown as text            * ``i``  integer
* ``d`` or ``dN``  double rounded to N places (default 6)
* ``b``  boolean                        * ``a``  array of strings, joined by ``|``
* no kind: passed through

The same projection is applied to both sides, so names, types and rounding agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.plans.fixtures import Market
from tapewire.plans.oracle import with_ctes


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Callable[[Market], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((c.split(":") + [""])[:2]) for c in spec.split()]  # type: ignore[misc]


def project(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        col = F.col(name)
        if kind == "t":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind == "i":
            col = col.cast("long")
        elif kind == "b":
            col = col.cast("boolean")
        elif kind == "a":
            col = F.array_join(col, "|")
        elif kind.startswith("d"):
            scale = 10.0 ** int(kind[1:] or 6)
            x = col.cast("double")
            col = F.when(~F.isnan(x), F.floor(x * scale + 0.5) / scale)
        out.append(col.alias(name))
    return df.select(*out)


def project_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        col = name
        if kind == "t":
            col = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            col = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            col = f"CAST({name} AS BOOLEAN)"
        elif kind == "a":
            col = f"array_to_string({name}, '|')"
        elif kind.startswith("d"):
            scale = f"{10 ** int(kind[1:] or 6)}::DOUBLE"
            x = f"CAST({name} AS DOUBLE)"
            col = f"CASE WHEN NOT isnan({x}) THEN floor({x} * {scale} + 0.5::DOUBLE) / {scale} END"
        out.append(f"{col} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{body}\n) AS q"


def query(name: str, spec: str, ctes: str = "", body: str | None = None, extra: str = ""):
    """Register a Spark job.  ``ctes`` names the shared fixture views the SQL uses,
    ``extra`` adds query-specific ones, ``body`` is the final SELECT."""

    def register(fn: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = None if body is None else with_ctes(ctes.split(), extra, project_sql(body, spec))
        REGISTRY[name] = Query(name, spec, fn, sql)
        return fn

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return project(q.build(Market(spark, sf_dir)), q.spec)
