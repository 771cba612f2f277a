"""The driver's tables as the relations that the operators work on, in Spark and as text for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The same text runs in both engines.
TOKENS = """SELECT event_type AS domain, user_id AS sample_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos,
 event_id % 7 <> 0 AS mask, value / 100 AS r, -((event_id * 7919) % 1000) / 500 AS t_lp, -((event_id * 104729) % 1000) / 500 AS s_lp,
 -((event_id * 1299709) % 1000) / 500 AS old_lp, -((event_id * 7919) % 1000) / 500 + ((event_id * 104729) % 1000) / 500 AS adv,
 CAST(date_part('day', ts) AS BIGINT) AS step FROM events"""
GROUPS = """SELECT l_orderkey AS group_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS slot,
 l_discount AS reward, l_returnflag IN ('R', 'A') AS correct, CASE WHEN l_partkey % 50 = 0 THEN 'aborted' WHEN l_partkey % 7 = 0 THEN 'truncated' ELSE 'completed' END AS status,
 concat('t', CAST(l_suppkey % 3 AS STRING)) AS teacher, l_quantity AS length, l_partkey, l_suppkey FROM lineitem"""
RECORDS = """SELECT lang AS suite, source AS model, CAST(doc_id AS STRING) AS id, concat(CAST(doc_id % 2 AS STRING), CAST(doc_id % 3 % 2 AS STRING), CAST(n_chars % 2 AS STRING), '1') AS correct FROM documents"""
RESPONSES = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """The view's text over the table `name`, without registering anything in the session's catalogue."""
    return spark.sql(text.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TOKENS, "events")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GROUPS, "lineitem")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RECORDS, "documents")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RESPONSES, "conversations")


def duck(text: str) -> str:
    return text.replace("AS STRING)", "AS VARCHAR)")


WITH = f"WITH tokens AS ({duck(TOKENS)}), grp AS ({duck(GROUPS)}), records AS ({duck(RECORDS)}), responses AS ({RESPONSES}) "
