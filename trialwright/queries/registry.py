"""Registry of queries, and the views of the given tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and, where SQL can say it, the same query in SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


EV = """ev AS (
  SELECT 'events' AS experiment, user_id AS run, value AS score, event_type, props, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter,
         CAST(least(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20) + 1, 3) AS INTEGER) AS stage
  FROM events)"""

OD = """od AS (
  SELECT o_orderpriority AS experiment, o_custkey AS run, o_totalprice AS score,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS iter
  FROM orders)"""

LI = """li AS (
  SELECT l_returnflag AS experiment, l_suppkey AS run, l_extendedprice AS score,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice, l_quantity) AS iter
  FROM lineitem)"""

# Running best, position among scored rows and plateaus of a log.
SCAN = """scan AS (
  SELECT *, max(score) OVER (PARTITION BY {keys} ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best,
         count(score) OVER (PARTITION BY {keys} ORDER BY iter ROWS UNBOUNDED PRECEDING) AS pos
  FROM {log}),
plateaus AS (
  SELECT {keys}, best, count(*) AS length, min(pos) AS first_pos, min(iter) AS first_iter
  FROM scan WHERE score IS NOT NULL GROUP BY {keys}, best)"""


def scan_sql(log: str, keys: str = "experiment, run") -> str:
    return SCAN.format(log=log, keys=keys)


def uniform_sql(*keys: str, seed: int = 0) -> str:
    """SQL text of ``functions.hashing.uniform``."""
    return f"({hash_sql(*keys, seed=seed)} / 4503599627370496::DOUBLE)"


def hash_sql(*keys: str, seed: int = 0) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 13))::BIGINT"
