"""Domain relations shaped from the driver's tables, in SQL that Spark and the oracle both read."""

from __future__ import annotations

#: Call edges: orders are tests, parts are methods; the ordinal stands for file order.
EDGES = """SELECT concat('p', CAST(l_suppkey % 4 AS STRING)) AS project,
  concat('t', CAST(l_orderkey % 3000 AS STRING)) AS from_url, concat('m', CAST(l_partkey % 400 AS STRING)) AS to_url,
  concat('testMake', CAST(l_orderkey % 3000 % 40 AS STRING)) AS from_name,
  concat('make', CAST(l_partkey % 400 % 40 AS STRING)) AS to_name,
  CAST(l_linenumber AS STRING) AS to_call_depth, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS to_lcba,
  l_discount AS score,
  CAST(l_linenumber AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS _ord
FROM {lineitem}"""
#: Methods on both sides with artifacts in all spellings.
METHODS = """SELECT concat('p', CAST(p_partkey % 4 AS STRING)) AS project, concat('m', CAST(p_partkey % 400 AS STRING)) AS url,
  replace(p_name, ' ', '_') AS name,
  CASE p_partkey % 5 WHEN 0 THEN '#main-code' WHEN 1 THEN '#test-code#test-case-method' WHEN 2 THEN ' #test-code  #test-helper-method'
    WHEN 3 THEN '#main-code #doc-module' ELSE '#test-module #main-code' END AS artifact,
  CAST(p_size AS STRING) AS start_line, CAST(p_size + p_partkey % 9 AS STRING) AS end_line,
  CASE p_partkey % 7 WHEN 0 THEN '1' WHEN 1 THEN 'x' WHEN 2 THEN '0.0' ELSE '0' END AS abstract,
  p_retailprice AS price, CAST(p_partkey AS BIGINT) AS _ord
FROM {part}"""
#: Labels of test-production pairs: ground truth.
TRUTH = """SELECT DISTINCT concat('p', CAST(l_suppkey % 4 AS STRING)) AS project,
  concat('t', CAST(l_orderkey % 3000 AS STRING)) AS from_url, concat('m', CAST(l_partkey % 400 AS STRING)) AS to_url
FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 25"""
#: Linked pairs with change counts on both sides.
PAIRS = """SELECT concat('p', CAST(o_custkey % 6 AS STRING)) AS project, concat('t', CAST(o_orderkey AS STRING)) AS from_url,
  concat('m', CAST(o_custkey AS STRING)) AS to_url,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 17 AS STRING) END AS from_ch_all,
  CAST(o_custkey % 11 AS STRING) AS to_ch_all, CAST(o_orderkey % 5 AS STRING) AS from_ch_diff,
  CAST(o_custkey % 4 AS STRING) AS to_ch_diff, CAST(o_orderkey AS BIGINT) AS _ord
FROM {orders}"""
#: Smells of tests with their sizes.
SMELLS = """SELECT concat('t', CAST(event_id % 1500 AS STRING)) AS url, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS smell,
  CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 17 = 0 THEN '0' ELSE CAST(1 + user_id % 90 AS STRING) END AS loc,
  CAST(event_id AS BIGINT) AS _ord FROM {events}"""
#: Tests with united smells, a revision group and a project.
TESTS = """SELECT concat('t', CAST(event_id % 4000 AS STRING)) AS from_url, concat('p', CAST(event_id % 4000 % 5 AS STRING)) AS project,
  CASE WHEN event_id % 4000 % 37 = 0 AND event_id > 6000 THEN 'AHTR'
    ELSE CASE event_id % 4000 % 3 WHEN 0 THEN 'NTR' WHEN 1 THEN 'ATR' ELSE 'HTR' END END AS rg_all,
  CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'click error' ELSE event_type END AS smells,
  CAST(event_id AS BIGINT) AS _ord FROM {events}"""
#: Commits of two sides.
COMMITS = """SELECT event_id, user_id, ts, event_type, concat('c', CAST(event_id % 3000 AS STRING)) AS commit, CAST(event_id AS BIGINT) AS place
FROM {events}"""
