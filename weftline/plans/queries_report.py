"""Registered queries: reports, stores, ingestion state, sampling and mapping steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import tags
from weftline.operators import filters, ingest, relational, reporting, review, revisions, sampling, signatures, smells
from weftline.plans.queries_study import LINES, LOCS, UNIQUE
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, PAIRS, SMELLS, TESTS, TRUTH
from weftline.sources import config, store

SUMMARY = """coalesce(project, 'all') AS project, count(*) AS {n}_rows, count(DISTINCT from_url) AS {n}_tests, count(DISTINCT to_url) AS {n}_productions, count(DISTINCT (from_url, to_url)) AS {n}_pairs"""


@query("filter_summary", f"SELECT * FROM (SELECT {SUMMARY.replace('{n}', 'before')} FROM ({EDGES}) e GROUP BY GROUPING SETS ((project), ())) b JOIN (SELECT {SUMMARY.replace('{n}', 'after')} FROM ({EDGES}) e WHERE from_url IN (SELECT from_url FROM ({TRUTH}) g) GROUP BY GROUPING SETS ((project), ())) a USING (project)")
def filter_summary(t):
    edges = t.sql(EDGES)
    return reporting.filter_summary(edges, filters.only_with(edges, t.sql(TRUTH)))


@query("effect_percentages", """SELECT l_returnflag, round_even(count(*) FILTER (WHERE l_linenumber = 1) / count(*)::DOUBLE * 100.0::DOUBLE, 1) AS negligible, round_even(count(*) FILTER (WHERE l_linenumber = 2) / count(*)::DOUBLE * 100.0::DOUBLE, 1) AS small,
 round_even(count(*) FILTER (WHERE l_linenumber = 3) / count(*)::DOUBLE * 100.0::DOUBLE, 1) AS medium, round_even(count(*) FILTER (WHERE l_linenumber > 3) / count(*)::DOUBLE * 100.0::DOUBLE, 1) AS large FROM {lineitem} GROUP BY 1""")
def effect_percentages(t):
    size = F.element_at(F.array(*[F.lit(s) for s in revisions.MARKERS.values()]), F.least("l_linenumber", F.lit(4)))
    return reporting.effect_percentages(t.lineitem.withColumn("effect_size", size), ["l_returnflag"])


@query("average_rows", "SELECT CASE n_nationkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS dataset, concat('avg-', CASE n_nationkey % 2 WHEN 0 THEN 'a' ELSE 'b' END) AS project, n_name AS strategy, n_regionkey AS f1 FROM {nation} WHERE n_nationkey < 2")
def average_rows(t):
    names = [r[0] for r in t.nation.where("n_nationkey < 2").orderBy("n_nationkey").select("n_name").collect()]
    metrics = t.nation.select(F.concat(F.lit("avg-"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b")).alias("project"), F.col("n_name").alias("strategy"), F.col("n_regionkey").alias("f1"))
    return reporting.average_rows(metrics, ["a"], names[:1]).unionByName(reporting.average_rows(metrics, ["b"], names[1:]))


@query("runtime_rows_above", "SELECT 'a' AS tool, count(*) FILTER (WHERE o_totalprice / 1000 > 300) AS above FROM {orders} WHERE o_totalprice > 0")
def runtime_rows_above(t):
    return reporting.above_limit(reporting.runtime_rows(t.orders.select(F.col("o_totalprice").alias("a_runtime"))), 300)


@query("box_values", f"SELECT rg_all AS grp, CAST(CASE WHEN smells = '' THEN 0 ELSE len(string_split(smells, ' ')) END AS BIGINT) AS smell_count, count(*) AS n FROM {UNIQUE} u GROUP BY 1, 2")
def box_values(t):
    return reporting.box_values(smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS), "rg_all")


@query("five_numbers", "SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM {lineitem} GROUP BY 1")
def five_numbers(t):
    return reporting.five_numbers(t.lineitem, "l_quantity", ["l_returnflag"])


@query("smell_display_order", f"WITH k AS (SELECT unnest(CASE WHEN smells = '' THEN ['none'] ELSE list_concat(['any'], string_split(smells, ' ')) END) AS smell FROM {UNIQUE} u) SELECT smell, count(*) AS total FROM k GROUP BY 1")
def smell_display_order(t):
    out = reporting.smell_display_order(smells.prevalence(t.sql(TESTS), "rg_all"))
    return out.where("total > 0")


@query("ranked_groups", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM {customer} QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def ranked_groups(t):
    return reporting.ranked_groups(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).drop("c_acctbal")


@query("method_index", f"SELECT name, list(url ORDER BY _ord) AS urls FROM ({METHODS}) m WHERE _ord % 3 <> 0 GROUP BY 1")
def method_index(t):
    rows = t.sql(METHODS).withColumn("expression", F.when(F.col("_ord") % 3 != 0, "method").otherwise("constructor"))
    return reporting.method_index(rows, ["name"])


@query("project_index", f"SELECT concat('p', CAST(n_nationkey % 8 AS VARCHAR)) AS project, coalesce(any_value(e.n), 0) AS edges, coalesce(any_value(m.n), 0) AS methods FROM {{nation}} LEFT JOIN (SELECT project, count(*) AS n FROM ({EDGES}) e GROUP BY 1) e ON e.project = concat('p', CAST(n_nationkey % 8 AS VARCHAR)) LEFT JOIN (SELECT project, count(*) AS n FROM ({METHODS}) m GROUP BY 1) m ON m.project = concat('p', CAST(n_nationkey % 8 AS VARCHAR)) GROUP BY 1")
def project_index(t):
    projects = t.nation.select(F.concat(F.lit("p"), (F.col("n_nationkey") % 8).cast("string")).alias("project")).distinct()
    return config.project_index(projects, {"edges": t.sql(EDGES), "methods": t.sql(METHODS)})


@query("store_upserts", "SELECT user_id AS url, CASE WHEN user_id < 100 AND user_id >= 50 THEN 'new' WHEN user_id < 50 THEN 'old' ELSE 'new' END AS prompt, CASE WHEN user_id >= 50 THEN 'unknown' ELSE '' END AS error, CASE WHEN user_id < 100 THEN 't0' ELSE 't1' END AS created_at FROM (SELECT DISTINCT user_id FROM {events}) u")
def store_upserts(t):
    users = t.events.select(F.col("user_id").alias("url")).distinct()
    old = users.where("url < 100").select("url", F.lit("old").alias("prompt"), F.lit("").alias("error"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"))
    asked = users.where("url >= 50").select("url", F.lit("new").alias("prompt"))
    return store.upsert_requests(old, asked, "t1", overwrite=True).select("url", "prompt", "error", "created_at")


@query("pending_orders", "SELECT o_orderkey AS url FROM {orders} WHERE o_orderstatus <> 'F'")
def pending_orders(t):
    known = t.orders.select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "").otherwise("late").alias("error"))
    return store.pending(t.orders.select(F.col("o_orderkey").alias("url")), known, "error")


@query("pending_cases", "SELECT DISTINCT user_id AS url FROM {events} WHERE user_id % 2 = 1 OR user_id % 4 = 0")
def pending_cases(t):
    users = t.events.select(F.col("user_id").alias("url")).distinct()
    stored = users.where("url % 2 = 0").select("url", F.when(F.col("url") % 4 == 0, "failed").otherwise("").alias("error"))
    return store.pending(users, stored, "error")


@query("merge_members", "SELECT o_custkey AS member, 'archive' AS origin FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, 'file' FROM {orders} WHERE o_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderkey % 2 = 0) GROUP BY 1")
def merge_members(t):
    a = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("member"), F.lit("archive").alias("origin")).distinct()
    b = t.orders.select(F.col("o_custkey").alias("member"), F.lit("file").alias("origin")).distinct()
    return store.merge_members(a, b)


@query("failed_files", "SELECT event_id // 2 AS file FROM {events} GROUP BY 1 HAVING bool_and(event_type = 'error')")
def failed_files(t):
    cache = t.events.select(F.floor(F.col("event_id") / 2).alias("file"), F.when(F.col("event_type") == "error", ingest.FAILED).alias("_flag"))
    return ingest.failed_files(cache)


@query("appended_rows", "SELECT event_id // 3 AS file, event_id FROM {events} WHERE event_type = 'click' UNION ALL SELECT event_id // 3, event_id FROM {events} WHERE event_type <> 'click' AND event_id // 3 NOT IN (SELECT event_id // 3 FROM {events} WHERE event_type = 'click')")
def appended_rows(t):
    rows = t.events.select(F.floor(F.col("event_id") / 3).alias("file"), "event_id", "event_type", F.lit(None).cast("string").alias("_flag"))
    return ingest.appended(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'")).select("file", "event_id")


@query("union_of_tops", f"WITH u AS (SELECT u.*, CASE WHEN loc < 30 THEN 'Small' WHEN loc <= 60 THEN 'Medium' ELSE 'Large' END AS g FROM {UNIQUE} u JOIN ({LOCS}) l USING (from_url) WHERE rg_all IN ('HTR', 'NTR')), s AS (SELECT g, count(*) FILTER (WHERE rg_all = 'HTR') AS f, count(*) FILTER (WHERE rg_all = 'NTR') AS b FROM u GROUP BY 1), k AS (SELECT g, rg_all, unnest(string_split(smells, ' ')) AS smell FROM u WHERE smells <> ''),\n d AS (SELECT k.g, smell, round_even(CASE WHEN any_value(f) > 0 THEN round_even(count(*) FILTER (WHERE rg_all = 'HTR') / any_value(f)::DOUBLE * 100.0::DOUBLE, 2) ELSE 0 END - CASE WHEN any_value(b) > 0 THEN round_even(count(*) FILTER (WHERE rg_all = 'NTR') / any_value(b)::DOUBLE * 100.0::DOUBLE, 2) ELSE 0 END, 2) AS difference FROM k JOIN s USING (g) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY difference DESC, smell) AS rk FROM d)\n SELECT smell, CAST(min(rk) AS INTEGER) AS rank, max(difference) AS difference FROM r WHERE rk <= 2 GROUP BY 1")
def union_of_tops(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS).where(F.col("rg_all").isin("HTR", "NTR"))
    sized = unique.join(smells.first_valid_loc(t.sql(SMELLS)), "from_url").withColumn("g", smells.control_group(F.col("loc")))
    return smells.union_of_tops(smells.smell_differences(sized, "rg_all", "HTR", "NTR", ["g"]), ["g"], 2)


@query("linked_locs", f"SELECT from_url, arg_min(e - s + 1, _ord) AS loc FROM (SELECT from_url, _ord, _ord % 17 AS s, _ord % 23 AS e FROM ({EDGES}) x) y WHERE e - s + 1 > 0 GROUP BY 1")
def linked_locs(t):
    rows = t.sql(EDGES).select("from_url", "_ord", (F.col("_ord") % 17).alias("from_start"), (F.col("_ord") % 23).alias("from_end"))
    return smells.linked_locs(rows)


@query("change_comparison", f"SELECT from_url, 'ch_all' AS change, CAST(TRY_CAST(from_ch_all AS BIGINT) AS BIGINT) AS from_count, CAST(to_ch_all AS BIGINT) AS to_count FROM ({PAIRS}) p WHERE from_url = 't1' UNION ALL SELECT from_url, 'ch_diff', CAST(from_ch_diff AS BIGINT), CAST(to_ch_diff AS BIGINT) FROM ({PAIRS}) p WHERE from_url = 't1'")
def change_comparison(t):
    pair = t.sql(PAIRS).where("from_url = 't1'")
    return review.change_comparison(pair, ["ch_all", "ch_diff"]).withColumn("from_url", F.lit("t1"))


@query("renamed_tags", f"SELECT _ord, array_to_string(list_transform(string_split(artifact, ' '), lambda x: CASE WHEN x = '#main-code' THEN '#prod' ELSE x END), ' ') AS artifact FROM ({METHODS}) m")
def renamed_tags(t):
    return review.rename_tag(t.sql(METHODS), "#main-code", "#prod", "artifact").select("_ord", "artifact")


@query("deleted_pairs", f"SELECT from_url, to_url, _ord FROM ({EDGES}) e WHERE from_url <> 't7' AND NOT (from_url = 't9' AND to_url = 'm9')")
def deleted_pairs(t):
    rows = review.delete_pair(review.delete_test(t.sql(EDGES), "t7"), "t9", "m9")
    return rows.select("from_url", "to_url", "_ord")


@query("population_counts", f"SELECT project, count(*) AS total, count(DISTINCT url) FILTER (WHERE artifact LIKE '%test-case-method%') AS test, count(DISTINCT url) FILTER (WHERE artifact LIKE '%main-code%') AS production FROM ({METHODS}) m GROUP BY 1")
def population_counts(t):
    return revisions.population_counts(t.sql(METHODS).withColumn("method_kind", tags.method_kind(F.col("artifact"))))


@query("rank_sums", f"WITH h AS (SELECT project, ch_all AS v, count(*) FILTER (WHERE method_kind = 'main-code') AS a, count(*) AS n FROM ({LINES}) x GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS mid FROM h) SELECT project, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(n - a) AS BIGINT) AS n2, sum(CAST(n AS DOUBLE) * n * n - n) AS ties, CAST(sum(mid * a) AS DOUBLE) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u1 FROM r GROUP BY 1")
def rank_sums(t):
    rows = t.sql(LINES)
    return revisions.rank_sums(rows, "ch_all", F.col("method_kind") == "main-code", ["project"])


@query("class_maps", "SELECT name, list_sort(list(DISTINCT fqn)) AS fqns FROM (SELECT p_name AS name, concat(p_brand, '.', p_name) AS fqn FROM {part}) x GROUP BY 1")
def class_maps(t):
    rows = t.part.select(F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"), F.lit("A|B").alias("parent_names"), F.col("p_partkey").alias("_ord"))
    return signatures.class_maps(rows)[1]


@query("appended_in_groups", "SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY e, s, c_custkey) - 1 AS _ord FROM (SELECT c_nationkey, c_custkey, c_custkey AS e, 0 AS s FROM {customer} WHERE c_custkey % 5 <> 0 UNION ALL SELECT c.c_nationkey, c_custkey, m.e, 1 FROM {customer} c LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS e FROM {customer} WHERE c_custkey % 5 <> 0 GROUP BY 1) m USING (c_nationkey) WHERE c_custkey % 5 = 0) x")
def appended_in_groups(t):
    rows = t.customer.select("c_nationkey", "c_custkey", F.col("c_custkey").alias("_ord"))
    return relational.append_after_group(rows.where("c_custkey % 5 <> 0"), rows.where("c_custkey % 5 = 0"), ["c_custkey"], "c_nationkey")
