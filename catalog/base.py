"""Registry of queries: a Spark callable, its output contract and, where SQL can say it, an oracle.

The contract is a string `name:type ...` with types int, real, sig (six significant digits, for p-values), str, date, ts, bool. It is applied to both
sides. Doubles are compared at seven significant digits, because the order in which a sum is taken
differs between engines and runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmarts import adapter

_SPARK = {"int": "bigint", "str": "string", "date": "date", "ts": "timestamp_ntz", "bool": "boolean"}
_SQL = {"int": "BIGINT", "str": "VARCHAR", "date": "DATE", "ts": "TIMESTAMP", "bool": "BOOLEAN"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def _contract(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        out.append((name, kind or "int"))
    return out


def project(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _contract(spec):
        c = F.col(f"`{name}`")
        if kind == "real":
            c = (F.round(c.cast("double"), 9).cast("float").cast("double") + F.lit(0.0))
        elif kind == "sig":
            x = c.cast("double")
            unit = F.pow(F.lit(10.0), 5 - F.floor(F.log10(x)))
            c = F.when(x < 1e-37, F.lit(0.0)).otherwise((F.floor(x * unit + 0.5) / unit).cast("float").cast("double"))
        else:
            c = c.cast(_SPARK[kind])
        cols.append(c.alias(name))
    return df.select(*cols)


def wrap(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _contract(spec):
        if kind == "real":
            cols.append(f'CAST(CAST(round(CAST("{name}" AS DOUBLE), 9) AS FLOAT) AS DOUBLE) + CAST(0 AS DOUBLE) AS "{name}"')
        elif kind == "sig":
            unit = f'pow(CAST(10 AS DOUBLE), 5 - floor(log10("{name}")))'
            cols.append(f'CASE WHEN "{name}" < CAST(1e-37 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(floor("{name}" * {unit} + 0.5) / {unit} AS FLOAT) AS DOUBLE) END AS "{name}"')
        else:
            cols.append(f'CAST("{name}" AS {_SQL[kind]}) AS "{name}"')
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in list(adapter.TABLES) + list(CTES):
            if name in words and name not in ctes:
                body = CTES[name] if name in CTES else adapter.oracle_cte(name)
                ctes[name] = ""
                need(body)
                ctes.pop(name)
                ctes[name] = body

    need(sql)
    head = ", ".join(f"{n} AS ({b})" for n, b in ctes.items())
    body = f"({sql.strip()})"
    select = "SELECT " + ", ".join(cols) + f" FROM {body} AS result"
    return f"WITH {head} {select}" if head else select


def cte(name: str, sql: str) -> None:
    """A named step that oracles may use."""
    CTES[name] = sql


def register(name: str, spec: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir, fn=fn, spec=spec: project(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[name] = wrap(sql, spec)
        return fn
    return add


def T(name: str):
    """Loader of a table by name."""
    return lambda spark, d: adapter.table(spark, d, name)
