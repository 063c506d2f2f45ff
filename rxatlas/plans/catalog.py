"""Registry of the queries in ``__spark_entry__`` and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REG = """
reg AS (
  SELECT p.p_partkey * 100000 + s.s_suppkey AS ord,
         SUBSTR(p.p_name, INSTR(p.p_name, ' ') + 1) AS substance,
         CONCAT(p.p_name, ' ', CAST(p.p_size AS VARCHAR), ' mg ',
           CASE p.p_type WHEN 'ECONOMY' THEN 'film-coated tablets' WHEN 'SMALL' THEN 'capsules'
                         WHEN 'LARGE' THEN 'oral solution' WHEN 'STANDARD' THEN 'cream'
                         WHEN 'PROMO' THEN 'tablets' ELSE '' END) AS product,
         s.s_name AS company, n.n_name AS country, r.r_name AS region, p.p_brand AS source,
         CASE WHEN MOD(p.p_partkey, 4) = 0 THEN NULL
              ELSE CONCAT('PL ', LPAD(CAST(p.p_partkey AS VARCHAR), 5, '0'), '/',
                          LPAD(CAST(s.s_suppkey AS VARCHAR), 4, '0')) END AS registration_number,
         CAST(ps.first_ship AS VARCHAR) AS registration_date,
         CASE MOD(p.p_partkey, 5) WHEN 0 THEN 'A10BA02' WHEN 1 THEN 'N02BE01'
                                  WHEN 2 THEN 'C09AA02' ELSE NULL END AS atc_code
  FROM (SELECT l_partkey, l_suppkey, MIN(CAST(l_shipdate AS DATE)) AS first_ship
        FROM lineitem GROUP BY l_partkey, l_suppkey) ps
  JOIN part p ON p.p_partkey = ps.l_partkey JOIN supplier s ON s.s_suppkey = ps.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
)"""

EVT = """
evt AS (
  SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS job_id,
         CONCAT('source', CAST(MOD(event_id, 8) AS VARCHAR)) AS source,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done'
              WHEN 'click' THEN 'timeout' ELSE 'failed' END AS status,
         TRY_CAST(NULLIF(REGEXP_EXTRACT(props, '[0-9]+', 0), '') AS INTEGER) AS records,
         value AS elapsed_seconds, ts
  FROM events
)"""

LEAF = REG + """,
leaf AS (
  SELECT ord, CONCAT('Marketing Authorisation Holder', CHR(10), company, ' Ltd, ', country, CHR(10),
       'Manufacturer', CHR(10), 'Maker ', substance, ' GmbH, Germany', CHR(10),
       'Pack sizes', CHR(10), '24 tablets') AS text FROM reg
)"""


def query(name: str, sql: str | None = None, ctes: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement, ``ctes`` the fixtures it reads."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if ctes:
                head, rest = ("WITH RECURSIVE", body[15:]) if body.startswith("WITH RECURSIVE ") else ("WITH", body[5:])
                body = f"{head} {ctes.strip()},\n{rest.lstrip()}" if body.startswith("WITH ") else f"WITH {ctes.strip()}\n{body}"
            ORACLES[name] = body
        return fn

    return register


def load() -> None:
    from . import queries_jobs, queries_rows, queries_search, queries_sources  # noqa: F401
