"""Relations that the driver's tables stand in for, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

NOTES = "SELECT doc_id AS note_id, doc_id % 200 AS visit_id, doc_id % 200 % 50 AS person_id, source AS note_title, text AS note_text, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id % 365 END AS note_day FROM {documents}"
MENTIONS = "SELECT p_partkey AS mention_id, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' ' || p_size || ' mg ' || lower(p_type) || ' tablet' WHEN 1 THEN 'x' || replace(p_name, ' ', '') WHEN 2 THEN substr(p_name, 1, 3) || substr(p_name, 5) WHEN 3 THEN '(' || p_brand || ') ' || p_name WHEN 4 THEN p_name || ' and ' || p_name ELSE '' END AS raw, p_name AS gold FROM {part}"
NAMES = "(SELECT DISTINCT p_name FROM {part}) AS names"
ALIASES = f"SELECT 'x' || replace(p_name, ' ', '') AS alias_raw, p_name AS canonical, length(p_name) % 3 <> 0 AS include, 1 AS ord FROM {NAMES} UNION ALL SELECT 'x' || replace(p_name, ' ', '') AS alias_raw, 'other ' || p_name AS canonical, true AS include, 2 AS ord FROM {NAMES} WHERE length(p_name) % 5 = 0"
VOCAB = f"SELECT p_name AS canonical, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS syn FROM {NAMES}"
EHR = "SELECT o_custkey AS person_id, o_orderkey AS visit_id, o_orderdate AS visit_date, p_name AS drug, p_type AS condition, p_brand AS measurement, o_orderpriority AS proc, l_linenumber AS line, l_partkey AS part FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"
SEEDS = "SELECT event_id AS ord, 'u' || event_id AS unit_id, event_id % 997 AS note_id, event_id % 31 AS span_id, event_type AS raw FROM {events}"
TRUTH = "SELECT event_id AS truth_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'missing' ELSE 'u' || event_id END AS unit_id, CASE WHEN event_id % 13 = 0 THEN event_id % 997 + 100000 ELSE event_id % 997 END AS note_id, CASE WHEN event_id % 11 = 0 THEN 99 ELSE event_id % 31 END AS span_id, event_type AS raw FROM {events} WHERE event_id % 7 <> 0"
SCORES = "SELECT event_id AS id, (event_id % 1000) / 1000.0 AS score, event_id % 3 <> 1 AS accepted, event_id % 4 <> 0 AS correct, event_type AS kind FROM {events}"


def tables_of(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def role(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in tables_of(sql)})
