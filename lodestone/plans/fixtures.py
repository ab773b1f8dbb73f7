"""Adapters: the driver's tables as corpus, questions, vectors, graph and runs.

Each adapter is SQL that Spark and DuckDB read alike; S stands for the string type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLED = """
SELECT doc_id AS ordinal, doc_id, text, source,
  CASE WHEN doc_id % 11 = 3 THEN concat('Siege of ', CAST(doc_id AS S), ' in ', CAST(1800 + doc_id % 200 AS S))
    WHEN doc_id % 10 = 7 THEN concat(CASE doc_id % 3 WHEN 0 THEN 'Men''s 500 metres Final A at ' WHEN 1 THEN 'Heats of Rowing eights at the ' ELSE 'Judo competition at the ' END, CAST(1984 + 4 * (doc_id % 9) AS S), ' Summer Olympics')
    ELSE concat(
      CASE doc_id % 6 WHEN 0 THEN 'Canoeing' WHEN 1 THEN 'Swimming' WHEN 2 THEN 'Speed skating' WHEN 3 THEN 'Athletics' WHEN 4 THEN 'Rowing' ELSE 'Judo' END,
      ' at the ', CAST(1984 + 4 * (doc_id % 9) AS S), CASE WHEN doc_id % 2 = 0 THEN ' Summer' ELSE ' Winter' END, ' Olympics',
      CASE doc_id % 5 WHEN 0 THEN ' – Men''s 1000 metres' WHEN 1 THEN ' – Women''s K-2 500 metres' WHEN 2 THEN ' – Heats of Mixed relay' WHEN 3 THEN ' – Team event' ELSE '' END)
  END AS title
FROM documents
"""

EDGES = """
SELECT DISTINCT 'INITIATED_BY' AS etype, 'ActionEvent' AS from_type, CAST(o_orderkey AS S) AS from_id, 'Person' AS to_type, CAST(o_custkey AS S) AS to_id FROM orders
UNION ALL SELECT DISTINCT 'TOOK_PLACE_AT', 'ActionEvent', CAST(o_orderkey AS S), 'Country', n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'AFFECTED', 'ActionEvent', CAST(l_orderkey AS S), 'Company', CAST(l_suppkey AS S) FROM lineitem
UNION ALL SELECT DISTINCT 'RESULTED_IN', 'ActionEvent', CAST(o_orderkey AS S), 'Outcome', o_orderstatus FROM orders
UNION ALL SELECT DISTINCT 'MENTIONED_IN', 'ActionEvent', CAST(l_orderkey AS S), 'Chunk', concat(CAST(l_orderkey % (SELECT count(*) FROM documents) AS S), '_chunk_', CAST(l_linenumber - 1 AS S)) FROM lineitem
UNION ALL SELECT DISTINCT 'MENTIONED_IN', 'Person', CAST(o_custkey AS S), 'Chunk', concat(CAST(o_orderkey % (SELECT count(*) FROM documents) AS S), '_chunk_0') FROM orders
"""

#: Searches start from every customer whose key is divisible by 100.
SEEDS = "SELECT c_custkey AS qid, 'Person' AS vtype, CAST(c_custkey AS S) AS vid FROM customer WHERE c_custkey % 100 = 0"

#: Context keys of the events, one row each.
KEYS = """
SELECT CAST(o_orderkey AS S) AS vid, concat('olympics:', CAST(year(o_orderdate) AS S)) AS ckey FROM orders
UNION ALL SELECT CAST(o_orderkey AS S), concat('event:', lower(o_orderpriority)) FROM orders
UNION ALL SELECT CAST(o_orderkey AS S), concat('sport:', lower(c_mktsegment)) FROM orders JOIN customer ON o_custkey = c_custkey
"""

#: Each region asks for one year, one segment and one priority.
ASKED = """
SELECT r_regionkey AS qid, concat('olympics:', CAST(1995 + r_regionkey AS S)) AS ckey FROM region
UNION ALL SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'sport:building' WHEN 1 THEN 'sport:machinery' WHEN 2 THEN 'sport:automobile' WHEN 3 THEN 'sport:household' ELSE 'sport:furniture' END FROM region
UNION ALL SELECT r_regionkey, CASE r_regionkey % 2 WHEN 0 THEN 'event:1-urgent' ELSE 'event:5-low' END FROM region
"""

#: Extraction records, a row per item: a line is an entity pair and an event. Line numbers
#: repeat inside an order, so items are numbered by all columns.
ITEMS = """
SELECT l_orderkey AS ord, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item,
  concat(CAST(l_orderkey % (SELECT count(*) FROM documents) AS S), '_chunk_', CAST(l_linenumber - 1 AS S)) AS chunk_id,
  concat(CASE l_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'the ' ELSE '' END, 'Part ', CAST(l_partkey % 97 AS S), CASE l_suppkey % 2 WHEN 0 THEN '.' ELSE '' END) AS name,
  CASE l_suppkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Company' WHEN 2 THEN 'Venue' ELSE 'Gadget' END AS vtype,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('about ', CAST(l_partkey AS S)) END AS description,
  l_partkey, l_suppkey, l_returnflag
FROM lineitem
"""

RECORDS = """
SELECT user_id AS qid, event_type AS qtype, value AS ms, event_id, event_id % 7 = 0 AS hit, CASE WHEN event_id % 13 = 0 THEN 'boom' END AS err,
  CASE event_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' ELSE 'agentic' END AS pipeline
FROM events
"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The adapter's rows, read from the Parquet tables it names."""
    text = sql.replace("AS S)", "AS STRING)")
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"lodestone_{t}")
    for t in sorted(tables, key=len, reverse=True):
        text = _named(text, t)
    return spark.sql(text)


def _named(text: str, name: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 lodestone_{name}", text)


def duck(sql: str) -> str:
    return sql.replace("AS S)", "AS VARCHAR)")
