"""Registered queries: lookups, review edits, mapping steps and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import dates, tags, text
from weftline.operators import (
    agreement, classification, evaluation, filters, linking, model_runs, relational, reporting, review, revisions, sampling, signatures,
    smell_bridge, smells,
)
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, PAIRS, SMELLS, TESTS
from weftline.sources import csv

TAG_LIST = "list_distinct(list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\s#]+'), lambda t: t <> ''))"
#: One method for each URL, the first.
METHOD = f"SELECT url, min(artifact) AS artifact, min(_ord) AS _ord FROM ({METHODS}) m GROUP BY url"
#: Links between methods.
LINKS = """SELECT concat('m', CAST(l_orderkey % 400 AS STRING)) AS from_url, concat('m', CAST(l_partkey % 400 AS STRING)) AS to_url,
  CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(l_orderkey AS BIGINT) * 10 AS _ord, l_partkey FROM {lineitem}"""
#: Codes of methods, some blank.
CODES = """SELECT concat('m', CAST(p_partkey % 400 AS STRING)) AS url, concat('p', CAST(p_partkey % 4 AS STRING)) AS project,
  CASE WHEN p_size > 40 THEN '' ELSE concat('void ', replace(p_name, ' ', '_'), '() {{ }}') END AS code, CAST(p_partkey AS BIGINT) AS _ord FROM {part}"""
#: Labels of pairs with review columns.
REVIEW = """SELECT concat('t', CAST(o_custkey AS STRING)) AS from_url, concat('m', CAST(o_orderkey AS STRING)) AS to_url,
  CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '' END AS label, CASE WHEN o_orderpriority LIKE '1%' THEN ' #One,two ' WHEN o_orderpriority LIKE '2%' THEN 'Two ##one' ELSE '' END AS tags,
  o_orderpriority AS notes, concat('p', CAST(o_custkey % 6 AS STRING)) AS project, CAST(o_orderkey AS BIGINT) AS _ord FROM {orders}"""
SCORED = """SELECT concat('p', CAST(l_suppkey % 4 AS STRING)) AS project, concat('t', CAST(l_orderkey % 3000 AS STRING)) AS from_url,
  concat('m', CAST(l_partkey % 400 AS STRING)) AS to_url, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS tech_nc, CASE WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN '1' ELSE 'x' END AS tech_lcba,
  CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END AS tech_gpt_oss_20b, CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END AS tech_testlinker, l_discount * 10 AS tech_lcs_u, CAST(l_linenumber AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS _ord FROM {lineitem}"""
NUMBER = "coalesce(TRY_CAST({c} AS DOUBLE), 0)"


def first_of(rows: str, keys: str, order: str = "_ord") -> str:
    """The first row of every key, as SQL."""
    return f"SELECT * EXCLUDE (__r) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS __r FROM ({rows}) x0) x1 WHERE __r = 1"


# ---- filters and columns --------------------------------------------------------------------


@query("test_to_main", f"SELECT l.from_url, l.to_url, l._ord, l.l_partkey FROM ({LINKS}) l JOIN ({METHOD}) a ON a.url = from_url JOIN ({METHOD}) b ON b.url = to_url WHERE list_contains({TAG_LIST.replace('{c}', 'a.artifact')}, 'test-case-method') AND list_contains({TAG_LIST.replace('{c}', 'b.artifact')}, 'main-code')")
def test_to_main(t):
    both = relational.attach_both(t.sql(LINKS), t.sql(METHOD).select("url", "artifact"))
    return filters.drop_helpers(filters.test_to_production(both), ("from_artifact", "to_artifact"))


@query("population_with_code", f"SELECT project, url, kind AS method_kind, code FROM (SELECT m.project, m.url, m._ord, CASE WHEN list_contains({TAG_LIST.replace('{c}', 'artifact')}, 'test-case-method') THEN 'test-case-method' WHEN list_contains({TAG_LIST.replace('{c}', 'artifact')}, 'main-code') THEN 'main-code' END AS kind, c.code FROM ({METHODS}) m JOIN ({first_of(CODES, 'project, url')}) c ON c.url = m.url AND c.project = m.project WHERE TRY_CAST(abstract AS DOUBLE) = 0 AND c.code <> '') x WHERE kind IS NOT NULL")
def population_with_code(t):
    return relational.attach_code(filters.base_population(t.sql(METHODS)), t.sql(CODES)).select("project", "url", "method_kind", "code")


@query("exact_tags", f"SELECT url, _ord, list_contains(regexp_split_to_array(artifact, '\\s+'), '#main-code') AS main FROM ({METHODS}) m")
def exact_tags(t):
    return t.sql(METHODS).select("url", "_ord", tags.has_exact_tag(F.col("artifact"), "#main-code").alias("main"))


@query("cleared_columns", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice, '' AS o_orderstatus, o_orderpriority AS alias FROM {orders}")
def cleared_columns(t):
    rows = filters.null_columns(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), ["o_totalprice"])
    return filters.alias_columns(filters.reset_columns(rows, ["o_orderstatus"]), {"alias": ("missing", "o_orderpriority")}).drop("o_orderpriority")


@query("ordered_columns", "SELECT o_orderkey AS project, o_custkey AS ch_diff, o_orderkey % 7 AS ch_all FROM {orders}")
def ordered_columns(t):
    rows = t.orders.select(F.col("o_custkey").alias("ch_diff"), (F.col("o_orderkey") % 7).alias("ch_all"), F.col("o_orderkey").alias("project"))
    out = filters.order_change_columns(rows)
    assert out.columns == ["project", *filters.change_columns(rows.columns)]
    return out


@query("union_of_rows", "SELECT DISTINCT k, v FROM (SELECT l_suppkey AS k, l_returnflag AS v FROM {lineitem} UNION ALL SELECT s_suppkey, NULL FROM {supplier}) u")
def union_of_rows(t):
    return relational.union_distinct([t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v")), t.supplier.select(F.col("s_suppkey").alias("k"))])


@query("sorted_any_case", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN upper(c_name) ELSE c_name END AS name FROM {customer}")
def sorted_any_case(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    return reporting.sort_any_case(rows, ["name"])


@query("whole_numbers", f"SELECT _ord, CASE WHEN TRY_CAST(abstract AS DOUBLE) = floor(TRY_CAST(abstract AS DOUBLE)) THEN CAST(CAST(TRY_CAST(abstract AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE abstract END AS abstract FROM ({METHODS}) m")
def whole_numbers(t):
    return csv.normal_integers(t.sql(METHODS).select("_ord", "abstract"), ["abstract"])[0]


@query("plain_dates", "SELECT o_orderkey, concat(strftime(o_orderdate, '%d/%m/%Y'), ' ', CASE o_orderkey % 3 WHEN 0 THEN '12:07 AM' WHEN 1 THEN '14:30' ELSE '9:05 pm' END) AS plain FROM {orders}")
def plain_dates(t):
    hour = F.when(F.col("o_orderkey") % 3 == 0, "00:07 AM").when(F.col("o_orderkey") % 3 == 1, "14:30 PM").otherwise("9:05 pm")
    return t.orders.select("o_orderkey", dates.normal_date(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\t "), hour)).alias("plain"))


@query("code_bodies", f"SELECT url, _ord, CASE WHEN strpos(code, '{{{{') > 0 THEN substr(code, strpos(code, '{{{{')) ELSE code END AS body FROM ({CODES}) c")
def code_bodies(t):
    return t.sql(CODES).select("url", "_ord", text.code_body(F.col("code")).alias("body"))


@query("simple_types", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'List' WHEN p_partkey % 3 = 1 THEN replace(p_brand, '#', '') ELSE replace(p_brand, '#', '') END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS filled FROM {part}")
def simple_types(t):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("java.util.List<"), brand, F.lit(">"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a.b."), brand, F.lit("[]"))).otherwise(brand)
    return t.part.select("p_partkey", text.simple_type(kind).alias("kind"), text.first_filled(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")), F.col("p_type")).alias("filled"))


# ---- lookups --------------------------------------------------------------------------------


@query("first_code", f"SELECT l.from_url, l.to_url, l._ord, c.code FROM (SELECT * FROM ({LINKS}) l0) l JOIN ({first_of(CODES, 'url')}) c ON c.url = l.to_url")
def first_code(t):
    rows = t.sql(LINKS).drop("l_partkey").withColumn("url", F.col("to_url"))
    return relational.attach_unique(rows, t.sql(CODES).select("url", "code", "_ord").withColumnRenamed("_ord", "__o"), ["url"], "__o").drop("url")


@query("depth_of_pairs", f"SELECT p.from_url, p.to_url, p._ord, coalesce(d.to_call_depth, '1') AS to_call_depth FROM ({PAIRS}) p LEFT JOIN (SELECT from_url, to_url, arg_min(to_call_depth, _ord) AS to_call_depth FROM (SELECT concat('t', CAST(l_orderkey AS STRING)) AS from_url, concat('m', CAST(o_custkey AS STRING)) AS to_url, CAST(l_linenumber AS STRING) AS to_call_depth, CAST(l_linenumber AS BIGINT) AS _ord FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linenumber > 2) c GROUP BY 1, 2) d USING (from_url, to_url)")
def depth_of_pairs(t):
    calls = t.lineitem.where("l_linenumber > 2").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("from_url"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("to_url"),
        F.col("l_linenumber").cast("string").alias("to_call_depth"), F.col("l_linenumber").cast("long").alias("_ord"),
    )
    return relational.lookup(t.sql(PAIRS).select("from_url", "to_url", "_ord"), calls, ["from_url", "to_url"], "to_call_depth", "1")


@query("last_predictions", f"SELECT p.from_url, p.to_url, p._ord, d.tech AS tech_model FROM ({PAIRS}) p LEFT JOIN (SELECT concat('t', CAST(l_orderkey AS STRING)) AS from_url, arg_max(CAST(l_linenumber % 2 AS BIGINT), l_linenumber) AS tech FROM {{lineitem}} GROUP BY 1) d USING (from_url)")
def last_predictions(t):
    pairs = t.sql(PAIRS).select("from_url", "to_url", "_ord")
    known = t.lineitem.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("from_url"), (F.col("l_linenumber") % 2).cast("long").alias("tech_model"), F.col("l_linenumber").alias("__o"))
    predictions = known.join(pairs.select("from_url", "to_url"), "from_url").withColumnRenamed("__o", "_ord")
    return relational.prediction_columns(pairs, predictions, "tech_model")


@query("narrowed_lines", "WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 5 AS s, l_linenumber * 5 + CAST(l_quantity AS INT) AS e, CAST(20 + l_orderkey % 9 AS INT) AS f FROM {lineitem}), m AS (SELECT *, s <= f AND f + 2 <= e AS i FROM p), w AS (SELECT *, bool_or(i) OVER (PARTITION BY k) AS a, count(*) OVER (PARTITION BY k) AS c FROM m) SELECT k, n FROM w WHERE c = 1 OR NOT a OR i")
def narrowed_lines(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") * 5).alias("s"),
        (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("int")).alias("e"), (20 + F.col("l_orderkey") % 9).cast("int").alias("f"),
    ).withColumn("g", F.col("f") + 2)
    return smell_bridge.narrow_by_range(rows, ["k"], "s", "e", "f", "g").select("k", "n")


@query("unsmelled_methods", f"SELECT url, min(_ord) IS NOT NULL AS here, count(*) FILTER (WHERE smell <> '') AS smelled FROM (SELECT url, smell, _ord FROM ({SMELLS}) s UNION ALL SELECT url, '', 1 FROM (SELECT DISTINCT concat('t', CAST(user_id AS STRING)) AS url FROM {{events}}) b WHERE url NOT IN (SELECT url FROM ({SMELLS}) s)) x GROUP BY url")
def unsmelled_methods(t):
    bridge = t.events.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("url"), F.lit("n").alias("name"), F.lit(3).alias("loc"))
    out = smell_bridge.append_unsmelled(t.sql(SMELLS).select("url", "smell", F.lit("n").alias("name"), F.lit(3).alias("loc")), bridge)
    return out.groupBy("url").agg(F.lit(True).alias("here"), F.count_if(F.col("smell") != "").alias("smelled"))


@query("method_histories", "SELECT DISTINCT p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE -p_partkey END AS history_id FROM {part} WHERE p_partkey % 3 <> 2")
def method_histories(t):
    key, path = F.col("p_partkey"), F.concat(F.lit("src/a/F"), F.col("p_partkey").cast("string"), F.lit(".java"))
    methods = t.part.select(key.alias("url"), F.col("p_name").alias("name"), F.concat(F.lit("mod/"), path).alias("file"))
    none = F.array(F.lit("x/Other.java"))
    direct = t.part.where(key % 3 == 0).select(key.alias("history_id"), F.col("p_name").alias("name"), path.alias("source_path"), F.array(F.lit("y.java")).alias("detail_paths"))
    detail = t.part.where(key % 3 != 2).select((-key).alias("history_id"), F.col("p_name").alias("name"), F.lit("old/Gone.java").alias("source_path"), F.concat(none, F.array(path)).alias("detail_paths"))
    return smell_bridge.find_histories(methods, direct.unionByName(detail)).select("url", "history_id")


@query("introduced_links", """WITH c AS (SELECT o_custkey AS u, o_orderkey AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderstatus = 'F' AS born FROM {orders}),
 b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY CASE WHEN born THEN 0 ELSE 1 END, CASE WHEN born THEN place ELSE -place END) = 1)
 SELECT concat('t', CAST(b.u AS VARCHAR)) AS from_url, concat('m', CAST(b.u % 50 AS VARCHAR)) AS to_url, concat('n', CAST(b.h AS VARCHAR)) AS from_old_name, CAST(5 AS INTEGER) AS from_old_start, CAST(6 AS BIGINT) AS from_old_end,
 CASE WHEN b.h % 2 = 0 THEN concat('o', CAST(b.h AS VARCHAR)) END AS to_old_name FROM b""")
def introduced_links(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    c = t.orders.select("o_custkey", "o_orderkey", place.alias("place"), F.when(F.col("o_orderstatus") == "F", "Yintroduced").otherwise("Ybodychange").alias("type"))
    at = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    tests = c.select(at("t", "o_custkey").alias("url"), at("c", "o_orderkey").alias("commit"), at("n", "o_orderkey").alias("name"), at("u", "o_orderkey").alias("old_url"), F.lit(5).alias("start"), F.lit("@@ -1,1 +5,2 @@\n+a\n b").alias("diff"), "type", "place")
    links = t.orders.select(at("t", "o_custkey").alias("from_url"), F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("to_url")).distinct()
    then = t.orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("url"), at("c", "o_orderkey").alias("commit"), at("o", "o_orderkey").alias("name"), at("v", "o_orderkey").alias("old_url"))
    out = smell_bridge.introduction_bridge(links, tests, then)
    return out.select("from_url", "to_url", "from_old_name", "from_old_start", F.col("from_old_end").cast("long").alias("from_old_end"), "to_old_name")


@query("distinct_bridge", f"SELECT from_url, project, _ord FROM ({first_of(TESTS, 'from_url, project')}) b")
def distinct_bridge(t):
    return smell_bridge.bridge_tests(t.sql(TESTS), ["from_url", "project"]).select("from_url", "project", "_ord")


@query("adapter_rows", "SELECT l_returnflag AS \"appName\", concat('t', CAST(l_orderkey AS STRING)) AS \"pathToTestFile\", CASE WHEN count(DISTINCT CASE WHEN l_linenumber > 4 THEN l_shipmode_ END) = 1 THEN max(CASE WHEN l_linenumber > 4 THEN l_shipmode_ END) ELSE '' END AS \"pathToProductionFile\" FROM (SELECT *, l_linestatus AS l_shipmode_ FROM {lineitem}) l GROUP BY 1, 2")
def adapter_rows(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("appName"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("pathToTestFile"), F.when(F.col("l_linenumber") > 4, F.col("l_linestatus")).otherwise("").alias("pathToProductionFile"))
    return smell_bridge.adapter_input(rows)


@query("one_signature_urls", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'known' WHEN n.c = 1 THEN n.u ELSE '' END AS url FROM {supplier} LEFT JOIN (SELECT c_nationkey, min(c_name) AS u, count(*) AS c FROM {customer} WHERE c_custkey < 40 GROUP BY 1) n ON n.c_nationkey = s_nationkey")
def one_signature_urls(t):
    methods = t.customer.where("c_custkey < 40").select(F.col("c_nationkey").cast("string").alias("fqs"), F.col("c_name").alias("url"))
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("sig"), F.when(F.col("s_suppkey") % 4 == 0, "known").otherwise("").alias("url"))
    return relational.signature_urls(rows, methods, "sig", "url").select("s_suppkey", "url")


@query("compared_files", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) END AS file FROM {part}")
def compared_files(t):
    key = F.col("p_partkey")
    found = t.part.select("p_partkey", F.concat(F.lit("src/"), key.cast("string"), F.lit("/A"), key.cast("string"), F.lit(".java")).alias("path"))
    known = t.part.where(key % 4 == 0).select(F.concat(F.lit("root/mod/src/"), key.cast("string"), F.lit("/A"), key.cast("string"), F.lit(".java")).alias("file"))
    out = smell_bridge.match_paths(found, known, both_ways=True)
    return out.select("p_partkey", F.regexp_extract("file", r"A(\d+)\.java$", 1).alias("file")).withColumn("file", F.when(F.col("file") != "", F.col("file")))


# ---- selection and evaluation ---------------------------------------------------------------


def _selected(where: str) -> str:
    return f"SELECT from_url, to_url, _ord FROM ({first_of(f'SELECT * FROM ({SCORED}) s WHERE {where}', 'from_url, to_url')}) k"


@query("link_max", _selected(f"{NUMBER.replace('{c}', 'tech_nc')} > 0 OR {NUMBER.replace('{c}', 'tech_lcba')} > 0 OR tech_lcs_u > 0"))
def link_max(t):
    return linking.select_links(t.sql(SCORED), "max").select("from_url", "to_url", "_ord")


@query("link_language_model", _selected("tech_gpt_oss_20b > 0"))
def link_language_model(t):
    return linking.select_links(t.sql(SCORED), "gpt-oss-20b").select("from_url", "to_url", "_ord")


@query("link_neural_model", _selected("tech_testlinker > 0"))
def link_neural_model(t):
    return linking.select_links(t.sql(SCORED), "testlinker").select("from_url", "to_url", "_ord")


@query("link_three_stages", _selected(f"{NUMBER.replace('{c}', 'tech_nc')} > 0 OR {NUMBER.replace('{c}', 'tech_lcba')} > 0 OR tech_lcs_u >= 0.75"))
def link_three_stages(t):
    return linking.select_links(t.sql(SCORED), "nc--lcba--lcs-u").select("from_url", "to_url", "_ord")


@query("labelled_candidates", f"WITH g AS (SELECT DISTINCT from_url, to_url FROM ({SCORED}) s WHERE tech_nc = '1' AND to_url < 'm2') SELECT c.from_url, c.to_url, c.tech_lcs_u AS score, CAST(g.to_url IS NOT NULL AS INTEGER) AS label FROM ({first_of(SCORED, 'from_url, to_url')}) c LEFT JOIN g USING (from_url, to_url) WHERE c.from_url IN (SELECT from_url FROM g)")
def labelled_candidates(t):
    scored = t.sql(SCORED)
    truth = scored.where("tech_nc = '1' AND to_url < 'm2'").select("from_url", "to_url")
    return evaluation.scored_candidates(scored, truth, "tech_lcs_u")


@query("positive_pairs", f"SELECT from_url, to_url, _ord FROM ({REVIEW}) r WHERE label = '1'")
def positive_pairs(t):
    return evaluation.positive_truth(t.sql(REVIEW)).select("from_url", "to_url", "_ord")


@query("tech_files", "SELECT n_name AS project, CAST(n_nationkey AS BIGINT) AS _ord, concat('x/', n_name, '.csv') AS path FROM {nation} WHERE n_regionkey IN (1, 2)")
def tech_files(t):
    catalog = t.nation.select(F.col("n_name").alias("project"), F.col("n_nationkey").cast("long").alias("_ord"))
    files = t.nation.where("n_regionkey IN (1, 2)").select(F.concat(F.lit("x/"), F.url_encode("n_name"), F.lit(".csv")).alias("path"))
    return linking.tech_files(catalog, files).withColumn("path", F.replace("path", F.lit("+"), F.lit(" ")))


# ---- smells and tables ----------------------------------------------------------------------

DIFFERENCES = """SELECT concat('s', CAST(p_size AS STRING)) AS smell, CASE WHEN p_partkey % 2 = 0 THEN 'HTR' ELSE 'ATR' END AS focal_group, 'NTR' AS baseline_group,
  max(p_retailprice) AS difference_pp, min(p_retailprice) / 100000 AS fisher_p_adjusted, min(p_size) / 500.0 AS mh_p_adjusted FROM {part} GROUP BY 1, 2, p_size"""


@query("greatest_differences", f"SELECT smell, difference_pp FROM ({DIFFERENCES}) d WHERE focal_group = 'HTR' ORDER BY difference_pp DESC, smell LIMIT 7")
def greatest_differences(t):
    return smells.top_smells(t.sql(DIFFERENCES), "HTR", "NTR", 7)


@query("robust_smells", f"SELECT DISTINCT smell FROM ({DIFFERENCES}) d WHERE focal_group = 'HTR' AND fisher_p_adjusted < 0.05 AND mh_p_adjusted < 0.05")
def robust_smells(t):
    return smells.robust_smells(t.sql(DIFFERENCES), "HTR", "NTR")


@query("effect_order", f"SELECT smell, min(difference_pp) AS difference_pp FROM ({DIFFERENCES}) d WHERE focal_group = 'ATR' GROUP BY smell")
def effect_order(t):
    return reporting.effect_order(t.sql(DIFFERENCES), ("ATR", "NTR"))


@query("comparison_pairs", f"SELECT DISTINCT focal_group, baseline_group FROM ({DIFFERENCES}) d")
def comparison_pairs(t):
    return reporting.comparison_pairs(t.sql(DIFFERENCES))


@query("group_names", f"SELECT from_url, _ord, CASE rg_all WHEN 'AHTR' THEN 'MTR' ELSE rg_all END AS grp FROM ({TESTS}) x")
def group_names(t):
    return t.sql(TESTS).select("from_url", "_ord", smells.normal_group(F.col("rg_all")).alias("grp"))


@query("projects_then_total", "SELECT CASE WHEN n_nationkey = 3 THEN 'all' ELSE n_name END AS project, n_regionkey FROM {nation}")
def projects_then_total(t):
    return reporting.projects_then_total(t.nation.select(F.when(F.col("n_nationkey") == 3, "all").otherwise(F.col("n_name")).alias("project"), "n_regionkey"))


# ---- review ---------------------------------------------------------------------------------


@query("updated_labels", f"SELECT from_url, to_url, _ord, CASE WHEN _ord % 10 = 3 THEN '1' WHEN _ord % 10 = 4 THEN '' ELSE label END AS label FROM ({REVIEW}) r")
def updated_labels(t):
    rows = t.sql(REVIEW).select("from_url", "to_url", "_ord", "label")
    updates = rows.where("_ord % 10 IN (3, 4)").select("from_url", "to_url", F.when(F.col("_ord") % 10 == 3, "1").otherwise(" ").alias("label"))
    return review.update_labels(rows, updates)


@query("updated_note", f"SELECT from_url, to_url, _ord, CASE WHEN to_url = 'm7' THEN 'seen' ELSE notes END AS notes FROM ({REVIEW}) r")
def updated_note(t):
    rows = t.sql(REVIEW).select("from_url", "to_url", "_ord", "notes")
    test = t.orders.where("o_orderkey = 7").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).first()[0]
    return review.update_note(rows, test, "m7", {"notes": "seen"})


@query("refreshed_columns", f"SELECT r.from_url, r._ord, coalesce(m.p_name, r.notes) AS to_name FROM ({REVIEW}) r LEFT JOIN (SELECT concat('m', CAST(p_partkey AS STRING)) AS to_url, p_name FROM {{part}}) m USING (to_url)")
def refreshed_columns(t):
    truth = t.sql(REVIEW).select("from_url", "to_url", "_ord", F.col("notes").alias("to_name"))
    methods = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("_ord"))
    return review.refresh_manual(truth, methods, ["to_name"]).select("from_url", "_ord", "to_name")


@query("review_values", f"SELECT from_url, to_url, CASE WHEN _ord % 3 = 0 THEN concat(label, '!') ELSE label END AS label, notes FROM ({REVIEW}) r")
def review_values(t):
    rows = t.sql(REVIEW).select("from_url", "to_url", "label", "notes")
    old = t.sql(REVIEW).where("_ord % 3 = 0").select("from_url", "to_url", "_ord", F.concat("label", F.lit("!")).alias("label"), F.lit("other").alias("notes"))
    return review.review_rows(rows, old, ["notes"], ["label", "notes"])


@query("scope_progress", f"SELECT count(*) FILTER (WHERE label <> '') AS labelled, count(*) AS total, round_even(CAST(count(*) FILTER (WHERE label <> '') AS DOUBLE) / count(*) * 100, 2) AS percent FROM ({REVIEW}) r WHERE project = 'p1'")
def scope_progress(t):
    return review.scope_progress(t.sql(REVIEW), F.col("project") == "p1")


@query("tag_dictionary", "SELECT unnest(['#One', '#Two', '#one', '#two']) AS tag")
def tag_dictionary(t):
    return review.tag_dictionary(t.sql(REVIEW))


@query("candidates_of_test", f"SELECT from_url, to_url, label FROM ({REVIEW}) r WHERE from_url = 't1'")
def candidates_of_test(t):
    return review.candidates_of(t.sql(REVIEW), "t1").select("from_url", "to_url", "label")


@query("review_links", f"SELECT to_url, concat('http://h/revision?project=', project, '&from_url=', from_url, '&to_url=', to_url) AS revision_url FROM ({REVIEW}) r")
def review_links(t):
    return review.with_links(t.sql(REVIEW), "http://h/").select("to_url", "revision_url")


@query("disagreements", f"SELECT from_url, to_url, project, CASE WHEN _ord % 5 = 0 THEN 'only_left' WHEN label NOT IN ('0', '1') THEN 'unlabeled_or_invalid' WHEN _ord % 5 = 1 THEN 'label_mismatch' END AS reason FROM ({REVIEW}) r")
def disagreements(t):
    rows = t.sql(REVIEW).select("project", "from_url", "to_url", "label", "_ord")
    flipped = F.when(F.col("_ord") % 5 != 1, F.col("label")).when(F.col("label") == "1", "0").when(F.col("label") == "0", "1").otherwise(F.col("label"))
    other = rows.where("_ord % 5 <> 0").withColumn("label", flipped)
    return agreement.compare_labels(rows, other).select("from_url", "to_url", "project", "reason")


@query("agreed_labels", f"SELECT from_url, to_url, _ord, label FROM ({first_of(REVIEW, 'from_url, to_url')}) r")
def agreed_labels(t):
    rows = t.sql(REVIEW)
    again = rows.withColumn("_ord", F.col("_ord") + 1_000_000_000)
    return agreement.checked_labels(rows.unionByName(again)).select("from_url", "to_url", "_ord", "label")


@query("test_pool", f"SELECT e.from_url, m.artifact, e._ord FROM (SELECT from_url, min(_ord) AS _ord FROM ({LINKS}) l GROUP BY 1) e JOIN ({METHOD}) m ON m.url = e.from_url WHERE list_contains({TAG_LIST.replace('{c}', 'artifact')}, 'test-case-method') AND NOT regexp_matches(artifact, 'helper')")
def test_pool(t):
    return sampling.test_pool(t.sql(LINKS), t.sql(METHOD), "helper")


@query("barred_methods", "SELECT o_custkey AS url, max(o_orderkey) AS _ord FROM {orders} GROUP BY 1")
def barred_methods(t):
    rows = t.orders.select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("_ord"))
    cut = 5000
    return sampling.barred(rows.where(F.col("_ord") <= cut), rows.where(F.col("_ord") > cut))


@query("enough_commits", "SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY 1 HAVING count(*) >= 4")
def enough_commits(t):
    histories = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("commits"))
    return sampling.rare_histories(histories, 4)[0].select("l_orderkey", F.size("commits").cast("long").alias("n"))


@query("flagged_samples", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS sampled FROM {orders}")
def flagged_samples(t):
    rows = t.orders.select("o_orderkey")
    return sampling.sampled_flags(rows, t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])


# ---- signatures and models ------------------------------------------------------------------

CALLS = """SELECT CAST(l_orderkey AS STRING) AS call_id, concat('sig', CAST(l_partkey % 300 AS STRING)) AS signature, round(l_discount * 100) / 10.0 AS score FROM {lineitem}"""


@query("best_signatures", f"SELECT call_id, signature, score FROM ({CALLS}) c WHERE score > 0.5 QUALIFY rank() OVER (PARTITION BY call_id ORDER BY score DESC) = 1")
def best_signatures(t):
    return signatures.best_signatures(t.sql(CALLS))


@query("mapped_signatures", f"WITH b AS (SELECT call_id, signature FROM ({CALLS}) c WHERE score > 0.9 QUALIFY rank() OVER (PARTITION BY call_id ORDER BY score DESC) = 1) SELECT o.call_id, coalesce(b.signature, 'own') AS signature FROM (SELECT CAST(o_orderkey AS STRING) AS call_id FROM {{orders}}) o LEFT JOIN b USING (call_id)")
def mapped_signatures(t):
    calls = t.orders.select(F.col("o_orderkey").cast("string").alias("call_id"), F.lit("own").alias("signature"))
    return signatures.mapped_signatures(calls, signatures.best_signatures(t.sql(CALLS), 0.9))


@query("signature_url_lists", "SELECT CAST(l_orderkey AS STRING) AS call_id, array_to_string(list(u ORDER BY o), ' ') AS urls FROM (SELECT DISTINCT l_orderkey, u, o FROM {lineitem} JOIN (SELECT concat('sig', CAST(p_partkey % 300 AS STRING)) AS s, concat('u', CAST(p_partkey AS STRING)) AS u, p_partkey AS o FROM {part}) p ON s = concat('sig', CAST(l_partkey % 300 AS STRING))) x GROUP BY 1")
def signature_url_lists(t):
    methods = t.part.select(F.concat(F.lit("sig"), (F.col("p_partkey") % 300).cast("string")).alias("signature"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_partkey").cast("long").alias("_ord"))
    return signatures.signatures_to_urls(t.sql(CALLS).select("call_id", "signature"), methods, joined=" ")


@query("author_invocations", "SELECT CAST(o_orderkey AS STRING) AS test_id, CAST(i AS INTEGER) AS place, 's' || CAST((o_custkey + i) % 5 AS VARCHAR) AS signature, CASE WHEN (o_custkey + i) % 5 < 3 THEN CAST((o_custkey + i) % 5 + 1 AS BIGINT) END AS rank, CAST((o_custkey + i) % 5 < 3 AS INTEGER) AS label_pred, CAST((o_custkey + i) % 5 = 1 AS INTEGER) AS label FROM {orders}, (SELECT unnest([0, 1, 2, 3]) AS i)")
def author_invocations(t):
    made = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("s"), ((F.col("o_custkey") + i) % 5).cast("string")))
    tests = t.orders.select(F.col("o_orderkey").cast("string").alias("test_id"), made.alias("invocations"), F.array(F.lit("s0"), F.lit("s1"), F.lit("s2")).alias("recommended"), F.array(F.lit("s1")).alias("truth"))
    return signatures.invocations_of(tests).withColumn("rank", F.col("rank").cast("long"))


@query("class_prefixes", "SELECT CAST(s_suppkey AS STRING) AS call_id, p AS prefix FROM (SELECT s_suppkey, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['a.N' || n_name] WHEN 1 THEN ['a.b.N' || n_name] ELSE ['q.N' || n_name] END) AS p FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey) x")
def class_prefixes(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    third, name = F.col("s_suppkey") % 3, F.concat(F.lit("N"), F.col("n_name"))
    prefix = F.when(third == 0, F.concat(F.lit("a."), name)).when(third == 1, F.lit("a.b")).otherwise(F.concat(F.lit("z."), name, F.lit("x")))
    calls = rows.select(F.col("s_suppkey").cast("string").alias("call_id"), prefix.alias("prefix"), name.alias("name"))
    known = t.nation.select(F.explode(F.array(F.concat(F.lit("a.N"), F.col("n_name")), F.concat(F.lit("a.b.N"), F.col("n_name")))).alias("prefix"))
    classes = t.nation.select(F.concat(F.lit("N"), F.col("n_name"), F.lit("x")).alias("name"), F.concat(F.lit("q.N"), F.col("n_name")).alias("fqn"))
    return signatures.prefixes(calls, known, classes)


@query("function_classes", f"SELECT name, count(DISTINCT url) AS classes, max(n) AS most FROM (SELECT name, url, count(DISTINCT start_line) AS n FROM ({METHODS}) m GROUP BY 1, 2) x GROUP BY 1")
def function_classes(t):
    rows = t.sql(METHODS).select("name", F.col("url").alias("fqn"), F.col("start_line").alias("testlinker_fqp"), "_ord")
    sizes = F.transform(F.map_values("classes"), lambda c: F.size(c))
    return signatures.function_map(rows).select("name", F.size("classes").cast("long").alias("classes"), F.array_max(sizes).cast("long").alias("most"))


@query("candidate_names", "SELECT CAST(n_nationkey AS STRING) AS case_id, n_name AS name, CAST(n_nationkey AS STRING) AS candidate_id FROM {nation} WHERE n_nationkey % 3 <> 2")
def candidate_names(t):
    third = F.col("n_nationkey") % 3
    case = F.col("n_nationkey").cast("string").alias("case_id")
    named = t.nation.select(case, F.col("n_name").alias("name"))
    given = F.when(third == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(third == 1, F.concat("n_name", F.lit("(int)"))).otherwise(F.lit("none"))
    own = t.nation.select(case, F.col("n_nationkey").cast("string").alias("candidate_id"), given.alias("signature"))
    return signatures.candidate_ids(named, own.unionByName(t.nation.select(case, F.lit("x").alias("candidate_id"), F.lit("zzz()").alias("signature"))))


@query("open_cases", "SELECT DISTINCT concat('t', CAST(l_orderkey AS STRING)) AS from_url FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F')")
def open_cases(t):
    cases = t.lineitem.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("from_url")).distinct()
    runs = t.orders.select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("from_url"), F.when(F.col("o_orderstatus") == "F", model_runs.DONE).otherwise(model_runs.ERROR).alias("status"))
    return model_runs.open_cases(cases, runs, "error")


@query("model_links", "SELECT concat('t', CAST(o_orderkey AS STRING)) AS from_url, concat('m', CAST(i AS VARCHAR)) AS to_url, CAST(i = o_orderkey % 3 AS INTEGER) AS prediction, CASE WHEN i = o_orderkey % 3 THEN CAST(0.5 AS DOUBLE) END AS confidence FROM {orders}, (SELECT unnest([0, 1, 2]) AS i) WHERE o_orderstatus <> 'P'")
def model_links(t):
    test = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("from_url")
    each = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), F.concat(F.lit("f"), i.cast("string"), F.lit("(int)")).alias("signature")))
    cases = t.orders.select(test, each.alias("candidates"), F.to_json(F.struct((F.col("o_orderkey") % 3).alias("k"))).alias("prompt_text"), "o_orderstatus")

    def provider(asked):
        import json

        return ["thinking\n" + json.dumps({"methods": [{"name": f"f{json.loads(p)['k']}", "confidence": 0.5}]}) for p in asked]

    runs = model_runs.run_cases(cases.where("o_orderstatus <> 'P'"), provider)
    urls = cases.select("from_url", F.explode("candidates").alias("c")).select("from_url", F.col("c.id").alias("candidate_id"), F.replace(F.col("c.id"), F.lit("c"), F.lit("m")).alias("to_url"))
    return model_runs.predicted_links(cases, runs, urls)


FILES = """SELECT 'p' AS project, concat(CASE p_partkey % 4 WHEN 0 THEN 'core-test/' WHEN 1 THEN 'core/' WHEN 2 THEN 'docs/' ELSE '' END,
  CASE p_size % 7 WHEN 0 THEN 'src/test/java/' WHEN 1 THEN 'src/main/java/' WHEN 2 THEN 'src/test/resources/' WHEN 3 THEN 'src/it/java/' WHEN 4 THEN 'build/generated/sources/test/' WHEN 5 THEN 'target/generated-sources/' ELSE 'lib/' END, CAST(p_partkey AS STRING), '.java') AS file,
  p_size % 7 AS kind_at, p_partkey % 4 AS module_at FROM {part}"""


@query("file_kinds", f"""SELECT file, CASE module_at WHEN 0 THEN 'core-test' WHEN 1 THEN 'core' WHEN 2 THEN 'docs' ELSE '' END AS module,
 CASE WHEN kind_at IN (0, 3) THEN 'test-code' WHEN kind_at = 2 THEN 'test-resource' WHEN kind_at = 4 THEN 'test-code-generated' WHEN kind_at = 5 THEN 'main-code-generated' ELSE 'main-code' END AS kind,
 array_to_string(list_filter(['#' || CASE module_at WHEN 0 THEN 'test-module' WHEN 2 THEN 'doc-module' ELSE '' END, CASE WHEN kind_at IN (0, 3, 4) THEN '#test-code' WHEN kind_at IN (1, 5, 6) THEN '#main-code' ELSE '#' END, CASE kind_at WHEN 2 THEN '#test-resource' WHEN 4 THEN '#test-code-generated' WHEN 5 THEN '#main-code-generated' ELSE '#' END], lambda t: t <> '#'), ' ') AS artifact FROM ({FILES}) f""")
def file_kinds(t):
    modules = t.spark.createDataFrame([("p", ""), ("p", "core"), ("p", "core-test"), ("p", "docs")], "project string, module string")
    return classification.classify_files(t.sql(FILES).select("project", "file"), modules).select("file", "module", "kind", "artifact")


@query("method_tags", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '#main-code' WHEN p_partkey % 5 = 1 OR (p_partkey % 5 = 2 AND p_size % 2 = 0) THEN '#test-code #test-case-method' WHEN p_partkey % 5 = 3 THEN '#test-code #test-fixture-method' ELSE '#test-code #test-helper-method' END AS artifact FROM {part}")
def method_tags(t):
    fifth, none = F.col("p_partkey") % 5, F.lit(None).cast("string")
    marks = F.when(fifth == 1, F.array(F.lit("org.testng.annotations.Test"))).when(fifth == 3, F.array(F.lit("BeforeEach"))).otherwise(F.array(F.lit("a.b.Other")))
    rows = t.part.select(
        "p_partkey", F.when(fifth == 0, "#main-code").otherwise("#test-code").alias("file_artifact"), marks.alias("annotations"),
        F.when(fifth == 2, "testIt").otherwise("run").alias("name"), F.when(F.col("p_size") % 2 == 0, "junit.framework.TestCase").otherwise("a.B").alias("superclass"),
        F.lit("Widget").alias("class_name"), F.lit(0).alias("parameters"), F.lit("int").alias("return_type"),
    )
    return classification.method_roles(rows).select("p_partkey", "artifact")


@query("steps_at_markers", "SELECT m.marker, coalesce((SELECT arg_max(y, x) FROM (SELECT o_orderkey AS x, CAST(o_custkey AS DOUBLE) AS y FROM {orders} WHERE o_orderstatus = 'F') s WHERE x <= m.marker), (SELECT arg_min(CAST(o_custkey AS DOUBLE), o_orderkey) FROM {orders} WHERE o_orderstatus = 'F')) AS y FROM (SELECT CAST(n_nationkey * 100 AS DOUBLE) AS marker FROM {nation}) m")
def steps_at_markers(t):
    steps = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return revisions.value_at_marker(steps, t.nation.select((F.col("n_nationkey") * 100).cast("double").alias("marker")), "x", "y")
