"""Registered queries: regenerated ground truth, apportionment, samples for review, seeded draws, histories as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import apportion, constraints, cubes, regeneration, review, revisions, sampling, smell_bridge, smells
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, PAIRS, TRUTH
from weftline.sources import history

#: Methods on both sides of the call edges; tests are test cases, some of them slow, and helpers.
SIDES = f"""SELECT DISTINCT project, from_url AS url, upper(from_name) AS name,
  CASE CAST(substr(from_url, 2) AS INTEGER) % 6 WHEN 0 THEN '#test-code #test-helper-method' WHEN 1 THEN '#test-code #test-case-method #slow' ELSE '#test-code#test-case-method' END AS artifact,
  CAST(1 AS BIGINT) AS _ord FROM ({EDGES}) e1
UNION ALL SELECT DISTINCT project, to_url AS url, upper(to_name) AS name, CASE WHEN CAST(substr(to_url, 2) AS INTEGER) % 9 = 0 THEN '#test-code' ELSE '#main-code' END AS artifact,
  CAST(2 AS BIGINT) AS _ord FROM ({EDGES}) e2"""
#: Labels from before: returned lines of some tests, some of pairs that no call explains any more.
WORKING = f"""SELECT project, from_url, CASE WHEN _ord % 7 = 0 THEN concat(to_url, 'x') ELSE to_url END AS to_url, 'old' AS to_name, 'z' AS to_call_depth,
  CASE _ord % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '1' END AS label, concat('#', CAST(_ord % 5 AS STRING)) AS tags, from_name AS notes, _ord
FROM ({EDGES}) e0 WHERE to_lcba = '1' AND from_url LIKE 't1%'"""
_PAIRS = "project, from_url, to_url"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY project, from_url, to_url ORDER BY {o}) = 1"

REGENERATED = f"""WITH e AS (SELECT * FROM ({EDGES}) x), m AS (SELECT DISTINCT ON (project, url) * FROM ({SIDES}) x ORDER BY project, url, _ord), w AS (SELECT * FROM ({WORKING}) x),
 pool AS (SELECT DISTINCT e.project, from_url, artifact LIKE '%slow%' AS barred FROM e JOIN m ON m.project = e.project AND m.url = e.from_url WHERE artifact LIKE '%test-case-method%'),
 there AS (SELECT DISTINCT project, from_url FROM w), have AS (SELECT project, count(*) AS n FROM there GROUP BY 1),
 added AS (SELECT p.project, p.from_url FROM pool p LEFT JOIN have USING (project) WHERE NOT barred AND (p.project, p.from_url) NOT IN (SELECT * FROM there)
   QUALIFY row_number() OVER (PARTITION BY p.project ORDER BY md5(concat('11|', p.project, '|', p.from_url)), p.from_url) <= 400 - coalesce(any_value(n) OVER (PARTITION BY p.project), 0)),
 sel AS (SELECT * FROM there UNION ALL SELECT * FROM added),
 f0 AS (SELECT e.* FROM e WHERE (project, from_url) IN (SELECT project, from_url FROM pool) AND (project, from_url) IN (SELECT * FROM sel) {_FIRST.format(o="TRY_CAST(to_call_depth AS DOUBLE), _ord")}),
 last AS (SELECT * FROM w {_FIRST.format(o="_ord DESC")}),
 f AS (SELECT f0.project, f0.from_url, f0.to_url, f0.to_name, f0.to_call_depth, CASE WHEN l.project IS NOT NULL THEN l.label WHEN coalesce(a.artifact, '') LIKE '%test-code%' THEN '0' ELSE '' END AS label,
   coalesce(l.tags, '') AS tags, 'fresh' AS origin, l.project IS NOT NULL AS carried, l.project IS NOT NULL AS refreshed, f0._ord FROM f0 LEFT JOIN last l ON (l.project, l.from_url, l.to_url) = (f0.project, f0.from_url, f0.to_url) LEFT JOIN m a ON a.project = f0.project AND a.url = f0.to_url),
 man AS (SELECT w.project, w.from_url, w.to_url, coalesce(m.name, w.to_name) AS to_name, w.to_call_depth, w.label, w.tags, 'manual' AS origin, true AS carried, m.url IS NOT NULL AS refreshed, w._ord
   FROM (SELECT * FROM w {_FIRST.format(o="_ord")}) w LEFT JOIN m ON m.project = w.project AND m.url = w.to_url WHERE (w.project, w.from_url, w.to_url) NOT IN (SELECT {_PAIRS} FROM f)),
 fm AS (SELECT * FROM f UNION ALL SELECT * FROM man),
 mis AS (SELECT project, from_url, to_url, to_name, to_call_depth, '' AS label, '' AS tags, 'missing' AS origin, false AS carried, false AS refreshed, _ord FROM (SELECT * FROM e {_FIRST.format(o="_ord")}) e
   WHERE (project, from_url) IN (SELECT * FROM there) AND (project, from_url, to_url) NOT IN (SELECT {_PAIRS} FROM fm)),
 c AS (SELECT project, from_url, to_url, to_call_depth AS depth FROM e {_FIRST.format(o="_ord")}),
 r AS (SELECT fm.*, CASE origin WHEN 'fresh' THEN 1 WHEN 'manual' THEN 2 END AS k FROM fm UNION ALL SELECT mis.*, NULL FROM mis),
 own AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY k, CASE WHEN k = 1 THEN from_url END, CASE WHEN k = 1 THEN to_url END, _ord) AS place FROM r WHERE k IS NOT NULL),
 ends AS (SELECT project, from_url, max(place) AS place FROM own GROUP BY 1, 2),
 every AS (SELECT * EXCLUDE (k) FROM own UNION ALL SELECT mis.*, ends.place FROM mis LEFT JOIN ends USING (project, from_url))
 SELECT project, from_url, to_url, to_name, coalesce(depth, to_call_depth) AS to_call_depth, CASE WHEN depth IS NULL THEN '0' ELSE '1' END AS candidate, label, tags, origin, carried, refreshed OR depth IS NOT NULL AS refreshed,
   row_number() OVER (PARTITION BY project ORDER BY place NULLS LAST, origin = 'missing', _ord) - 1 AS _ord FROM every LEFT JOIN c USING (project, from_url, to_url)"""


def _regenerated(t):
    return regeneration.regenerate(
        t.sql(WORKING), t.sql(EDGES), t.sql(SIDES), 400, seed=11, exclude="slow", columns=["to_name", "to_call_depth"], add_missing=True
    )


@query("regenerated_truth", REGENERATED)
def regenerated_truth(t):
    return _regenerated(t).select(
        "project", "from_url", "to_url", "to_name", "to_call_depth", "candidate", "label", "tags", "origin", "carried", "refreshed", "_ord"
    )


@query("regeneration_counts", f"""SELECT project, count(DISTINCT from_url) AS tests, count(*) AS rows, count(*) FILTER (WHERE origin = 'fresh') AS fresh_rows, count(*) FILTER (WHERE origin = 'manual') AS manual_rows,
 count(*) FILTER (WHERE origin = 'missing') AS missing_rows, count(*) FILTER (WHERE carried AND label <> '') AS carried_labels, count(*) FILTER (WHERE refreshed) AS refreshed_rows, count(*) FILTER (WHERE label = '') AS unlabelled_rows FROM ({REGENERATED}) g GROUP BY 1""")
def regeneration_counts(t):
    return regeneration.regeneration_counts(_regenerated(t))


def units(rows: str, goal: str) -> str:
    """SQL of proportional shares of (name, size): units beyond the floors are rows, dealt in their order."""
    return f"""WITH RECURSIVE g AS (SELECT name, CAST(size AS BIGINT) AS size FROM ({rows}) r0), s AS (SELECT *, least({goal}, sum(size) OVER ()) AS goal, sum(size) OVER () AS total, count(*) FILTER (WHERE size > 0) OVER () AS groups FROM g),
 q AS (SELECT *, CAST(goal * size AS DOUBLE) / CAST(total AS DOUBLE) AS quota, CASE WHEN goal >= groups THEN 1 ELSE 0 END AS least FROM s),
 b AS (SELECT *, CASE WHEN size = 0 OR goal = 0 THEN 0 ELSE least(size, greatest(least, CAST(floor(quota) AS BIGINT))) END AS base FROM q),
 p AS (SELECT *, goal - sum(base) OVER () AS gap, quota - floor(quota) AS rest FROM b),
 o AS (SELECT *, CASE WHEN gap > 0 THEN size - base WHEN size = 0 THEN 0 ELSE greatest(base - least, 0) END AS room,
   CASE WHEN gap > 0 THEN row_number() OVER (ORDER BY rest DESC, size DESC, name DESC) ELSE row_number() OVER (ORDER BY rest, size, name) END AS nth FROM p),
 u AS (SELECT name, gap, unnest(range(CAST(least(room, abs(gap)) AS BIGINT))) AS k, nth FROM o),
 d AS (SELECT name, count(*) AS n FROM (SELECT name, gap, row_number() OVER (ORDER BY k, nth) AS place FROM u) x WHERE place <= abs(gap) GROUP BY 1)
 SELECT o.name, o.size, CAST(base + CASE WHEN gap > 0 THEN 1 ELSE -1 END * coalesce(d.n, 0) AS BIGINT) AS share FROM o LEFT JOIN d USING (name)"""


SUPPLIERS = "SELECT concat('s', CAST(l_suppkey AS STRING)) AS name, count(*) AS size FROM {lineitem} GROUP BY 1"
CUSTOMERS = "SELECT concat('c', CAST(c_custkey AS STRING)) AS name, CAST(CASE WHEN c_custkey % 3 = 0 THEN floor(greatest(c_acctbal, 0)) ELSE c_custkey % 2 END AS BIGINT) AS size FROM {customer}"


@query("shares_by_remainder", units(SUPPLIERS, "777"))
def shares_by_remainder(t):
    """More groups than the floors take: units go round upwards."""
    return apportion.allocate(t.sql(SUPPLIERS), F.lit(777), "name")


@query("shares_with_floors", units(CUSTOMERS, "(SELECT CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) + 40 FROM g)"))
def shares_with_floors(t):
    """Floors of 1 take nearly all: the large groups give back, round after round."""
    rows = t.sql(CUSTOMERS)
    goal = rows.agg((F.count_if(F.col("size") > 0) + 40).alias("goal"))
    return apportion.allocate(rows.crossJoin(F.broadcast(goal)), F.col("goal"), "name").drop("goal")


#: A review from before: part of the pairs, labelled and sampled.
REVIEWED = f"""SELECT project, from_url, to_url, CASE WHEN _ord % 2 = 0 THEN '1' ELSE '0' END AS label, '#seen' AS tags, concat('n', CAST(_ord % 9 AS STRING)) AS notes,
  CASE WHEN _ord % 5 = 0 THEN 'true' WHEN _ord % 3 = 0 THEN ' 1 ' ELSE '0' END AS sampled, _ord FROM ({PAIRS}) p0 WHERE to_ch_all = '3' OR _ord % 91 = 0"""
_SIZE = "least(ceil(384.16 / (1 + 383.16 / sum(size))), sum(size))"
REVIEW_SAMPLE = f"""WITH cur AS (SELECT p.project, p.from_url, p.to_url, coalesce(r.label, '') AS label, coalesce(r.tags, '') AS tags, coalesce(r.notes, '') AS notes, coalesce(trim(r.sampled) IN ('1', 'true', 'True'), false) AS was
   FROM ({PAIRS}) p LEFT JOIN ({REVIEWED}) r USING (from_url, to_url)),
 n AS (SELECT project AS name, count(*) AS size, count(*) FILTER (WHERE was) AS existing FROM cur GROUP BY 1), goal AS (SELECT CAST({_SIZE} AS BIGINT) AS goal, CAST(sum(existing) AS BIGINT) AS there FROM n),
 sh AS ({units("SELECT name, size FROM n", "(SELECT goal FROM goal)")}),
 lack AS (SELECT n.name, least(n.size - existing, greatest(share - existing, 0)) AS size FROM n JOIN sh USING (name)),
 open AS (SELECT greatest(goal - there, 0) AS open, (SELECT sum(size) FROM lack) AS lacks FROM goal),
 pro AS ({units("SELECT name, size FROM lack", "(SELECT open FROM open)")}),
 more AS (SELECT lack.name, CASE WHEN lacks <= open THEN lack.size ELSE pro.share END AS more FROM lack JOIN pro USING (name), open)
 SELECT project, from_url, to_url, label, tags, notes, CASE WHEN was OR row_number() OVER (PARTITION BY project, was ORDER BY md5(concat('5|', from_url, '|', to_url)), from_url, to_url) <= more THEN '1' ELSE '0' END AS sampled FROM cur JOIN more ON name = project"""


@query("review_samples", REVIEW_SAMPLE)
def review_samples(t):
    columns = ["project", "from_url", "to_url", "label", "tags", "notes", "sampled"]
    return apportion.review_sample(t.sql(PAIRS), 5, t.sql(REVIEWED)).select(*columns)


@query("body_coverage", f"SELECT project, count(*) AS tests, count(*) FILTER (WHERE body = '') AS without_body FROM (SELECT project, from_url, arg_min(CASE WHEN score > 0.07 THEN '' ELSE from_name END, _ord) AS body FROM ({EDGES}) e GROUP BY from_url, project QUALIFY row_number() OVER (PARTITION BY from_url ORDER BY min(_ord)) = 1) x GROUP BY 1")
def body_coverage(t):
    rows = t.sql(EDGES).withColumn("body", F.when(F.col("score") > 0.07, "").otherwise(F.col("from_name")))
    return constraints.coverage(rows)


@query("seeded_sample", "SELECT c_nationkey, c_custkey FROM {customer} QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat('7|', c_custkey)), c_custkey) <= 5")
def seeded_sample(t):
    return sampling.seeded_sample(t.customer, ["c_custkey"], 5, 7, ["c_nationkey"]).select("c_nationkey", "c_custkey")


@query("sampled_flags", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(concat('3|', c_custkey)), c_custkey) <= 20 THEN '1' ELSE '0' END AS sampled FROM {customer}")
def sampled_flags(t):
    picked = sampling.seeded_sample(t.customer.select("c_custkey"), ["c_custkey"], 20, 3)
    return sampling.sampled_flags(t.customer.select("c_custkey"), picked, ["c_custkey"])


@query("missing_methods", f"WITH r AS (SELECT DISTINCT project, url FROM ({METHODS}) m), x AS (SELECT * FROM r WHERE url LIKE '%0'), h AS (SELECT project, count(*) AS n FROM x GROUP BY 1) SELECT r.project, r.url, 12 AS required FROM r LEFT JOIN h USING (project) WHERE r.url NOT IN (SELECT url FROM x) QUALIFY row_number() OVER (PARTITION BY r.project ORDER BY md5(concat('5|', r.url)), r.url) <= 12 - coalesce(any_value(n) OVER (PARTITION BY r.project), 0)")
def missing_methods(t):
    required = t.sql(METHODS).select("project", "url").distinct().withColumn("required", F.lit(12))
    existing = required.where(F.substring("url", -1, 1) == "0").select("project", "url")
    return sampling.missing_methods(required, existing, existing.limit(0), 5)


@query("reused_samples", "WITH r AS (SELECT o_orderkey AS from_url FROM {orders} WHERE o_orderstatus = 'P') SELECT from_url, true AS reused FROM r UNION ALL SELECT * FROM (SELECT o_orderkey, false FROM {orders} WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (ORDER BY md5(concat('5|', o_orderkey)), o_orderkey) <= 1000 - (SELECT count(*) FROM r)) f")
def reused_samples(t):
    rows = t.orders.select(F.col("o_orderkey").alias("from_url"))
    return sampling.sample_with_reuse(rows, t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("from_url")), 1000, 5)


@query("first_of_sample", "SELECT o_orderkey FROM {orders} ORDER BY md5(concat('7|', o_orderkey)), o_orderkey LIMIT 50")
def first_of_sample(t):
    return sampling.seeded_sample(t.orders.select("o_orderkey"), ["o_orderkey"], 50, 7)


# ---- histories ------------------------------------------------------------------------------

#: Histories of orders: their lines are commits, in one of the four layouts, some with fields of their own.
HISTORIES = """SELECT o_orderkey AS member, concat('{{"sourceFilePath":"f', CAST(o_custkey AS STRING), '",', CASE o_orderkey % 5
  WHEN 0 THEN concat('"changeHistory":[', n, '],"changeHistoryDetails":{{', d, '}}') WHEN 1 THEN concat('"changeHistory":[],"commitDetails":[', l, ',{{"commitName":" "}}]')
  WHEN 2 THEN concat('"changeHistoryDetails":{{', d, '}}') WHEN 3 THEN concat('"commits":[', h, '],"commitDetails":[]') ELSE '"commits":[]' END, '}}') AS json
FROM {orders} JOIN (SELECT l_orderkey, array_join(array_sort(collect_list(concat('"', c, '"'))), ',') AS n,
   array_join(reverse(array_sort(collect_list(concat('"', c, '":{{"commitAuthor":"', CAST(l_suppkey AS STRING), '","odd":{{"tax":"', CAST(l_tax AS STRING), '"}}}}')))), ',') AS d,
   array_join(array_sort(collect_list(concat('{{"commitName":"', c, '","commitAuthor":"', l_returnflag, '"}}'))), ',') AS l, array_join(array_sort(collect_list(concat('{{"commitHash":"', c, ' "}}'))), ',') AS h
   FROM (SELECT *, substr(md5(concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_extendedprice AS STRING))), 1, 12) AS c FROM {lineitem}) x GROUP BY l_orderkey) y ON o_orderkey = l_orderkey"""
#: The same text in the other engine's functions.
_TEXTS = HISTORIES.replace("array_join(", "array_to_string(").replace("reverse(", "list_reverse(").replace("array_sort(", "list_sort(").replace("collect_list(", "list(")
_ENTRIES = f"""WITH m AS (SELECT member, json FROM ({_TEXTS}) t), k AS (SELECT *, json_extract(json, '$.changeHistoryDetails') AS d FROM m),
 o AS (SELECT *, CASE WHEN json_array_length(json, '$.changeHistory') > 0 THEN 'changeHistory' WHEN json_array_length(json, '$.commitDetails') > 0 THEN 'commitDetails' WHEN d IS NOT NULL THEN 'changeHistoryDetails' WHEN json_array_length(json, '$.commits') > 0 THEN 'commits' END AS source FROM k),
 n AS (SELECT *, CASE source WHEN 'changeHistory' THEN json_extract_string(json, '$.changeHistory[*]') WHEN 'commitDetails' THEN json_extract_string(json, '$.commitDetails[*].commitName') WHEN 'changeHistoryDetails' THEN json_keys(d) ELSE json_extract_string(json, '$.commits[*].commitHash') END AS names FROM o WHERE source IS NOT NULL),
 e AS (SELECT member, json, source, d, unnest(list_filter(list_transform(names, lambda x: trim(x)), lambda x: x <> '')) AS commit, unnest(range(len(list_filter(names, lambda x: trim(x) <> '')))) AS place FROM n)
 SELECT member, source, CAST(place AS INTEGER) AS place, commit, coalesce(json_extract_string(d, concat('$."', commit, '".commitAuthor')), json_extract_string(json, '$.commitDetails[*].commitAuthor')[list_position(json_extract_string(json, '$.commitDetails[*].commitName'), commit)]) AS author,
   json_extract_string(d, concat('$."', commit, '".odd.tax')) AS odd, json_extract_string(json, '$.sourceFilePath') AS path FROM e"""


@query("history_entries", _ENTRIES)
def history_entries(t):
    """The order of commits from each of its four sources; a field that no schema knows."""
    entries = history.history_entries(t.sql(HISTORIES).withColumn("status", F.lit("ok")))
    odd = F.try_variant_get("detail", "$.odd.tax", "string").alias("odd")
    return entries.select("member", "source", "place", "commit", "author", odd, "path")


# ---- ranges and distributions ---------------------------------------------------------------

#: Nested and overlapping ranges of lines in files, and elements some of which no range contains.
RANGES = "SELECT concat('f', CAST(o_custkey % 50 AS STRING)) AS file, o_orderkey AS id, CAST(o_custkey + o_orderkey % 700 AS INTEGER) AS s, CAST(o_custkey + o_orderkey % 700 + floor(o_totalprice / 400) AS INTEGER) AS e FROM {orders}"
ELEMENTS = "SELECT concat('f', CAST(p_partkey % 60 AS STRING)) AS file, p_partkey AS k, CAST(p_partkey * 3 % 1700 AS INTEGER) AS f, CAST(p_partkey * 3 % 1700 + p_size AS INTEGER) AS l FROM {part}"


@query("narrowed_ranges", f"WITH p AS (SELECT k, id, s <= f AND l <= e AS inside FROM ({ELEMENTS}) a JOIN ({RANGES}) b USING (file)) SELECT k, id FROM p QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY k)")
def narrowed_ranges(t):
    return smell_bridge.narrowed(t.sql(ELEMENTS), t.sql(RANGES), ["file"], "k", "s", "e", "f", "l").select("k", "id")


@query("cdf_steps", "WITH h AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v, count(*) AS n FROM {orders} GROUP BY 1) SELECT v, coalesce(lead(v) OVER (ORDER BY v) - 1, v) AS until, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 9) AS cdf FROM h")
def cdf_steps(t):
    """Values far apart: a row for each, none in between."""
    steps = revisions.step_cdf(t.orders.select(F.floor("o_totalprice").cast("long").alias("v")), "v")
    return steps.select("v", "until", F.round("cdf", 9).alias("cdf"))


# ---- cubes over all dimensions --------------------------------------------------------------

#: Linked tests by strategy, tool and detector, with groups of two change types and smells.
LINKED = """SELECT l_returnflag AS strategy, l_linestatus AS tool, CASE WHEN l_tax > 0.04 THEN 'x' ELSE 'y' END AS smell_detector, concat('t', CAST(l_orderkey AS STRING)) AS from_url,
  CASE WHEN l_orderkey % 7 = 0 AND l_linenumber > 3 THEN '' WHEN l_orderkey % 3 = 0 THEN 'NTR' WHEN l_orderkey % 3 = 1 THEN 'ATR' ELSE 'HTR' END AS rg_all,
  CASE WHEN l_quantity < 20 THEN 'NTR' WHEN l_quantity < 30 THEN 'AHTR' ELSE 'HTR' END AS rg_diff,
  CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN concat('c', CAST(l_linenumber AS STRING), ' a') ELSE 'b' END AS smells FROM {lineitem}"""
STRATA = "SELECT concat('t', CAST(o_orderkey AS STRING)) AS from_url, CASE WHEN o_totalprice < 100000 THEN 'Small' WHEN o_totalprice < 200000 THEN 'Medium' ELSE 'Large' END AS loc_group FROM {orders} WHERE o_orderkey % 11 <> 0"
_LONG = f"""l AS (SELECT strategy, tool, smell_detector, 'all' AS change, from_url, rg_all AS rg, smells FROM ({LINKED}) a UNION ALL SELECT strategy, tool, smell_detector, 'diff', from_url, CASE WHEN rg_diff = 'AHTR' THEN 'MTR' ELSE rg_diff END, smells FROM ({LINKED}) b),
 m AS (SELECT strategy, tool, smell_detector, change, from_url, min(rg) AS rg, list_distinct(flatten(list(CASE WHEN smells = '' THEN [] ELSE string_split(smells, ' ') END))) AS smells FROM l WHERE rg IN ('NTR', 'ATR', 'HTR', 'MTR') GROUP BY ALL HAVING count(DISTINCT rg) = 1)"""
_LONG = _LONG.replace("GROUP BY ALL", "GROUP BY strategy, tool, smell_detector, change, from_url")
_PAIRS_OF = smells.group_pairs("HTR,NTR; HTR,ATR;MHTR , NTR")
_BY = "strategy, tool, smell_detector, change"


@query("comparison_cube", f"""WITH {_LONG}, s AS ({STRATA}), p AS (SELECT unnest([{{{{'g1': 'HTR', 'g2': 'NTR'}}}}, {{{{'g1': 'HTR', 'g2': 'ATR'}}}}, {{{{'g1': 'MTR', 'g2': 'NTR'}}}}], recursive := true)),
 r AS (SELECT {_BY}, rg, len(smells) AS n, unnest(CASE WHEN loc_group IS NULL THEN ['ALL'] ELSE ['ALL', loc_group] END) AS loc_group FROM m LEFT JOIN s USING (from_url)),
 x AS (SELECT r.*, g1, g2, rg = g1 AS one FROM r JOIN p ON rg IN (g1, g2)),
 k AS (SELECT *, rank() OVER (PARTITION BY {_BY}, loc_group, g1, g2 ORDER BY n) + (count(*) OVER (PARTITION BY {_BY}, loc_group, g1, g2, n) - 1) / 2.0::DOUBLE AS mid FROM x),
 u AS (SELECT {_BY}, loc_group, g1, g2, count(*) FILTER (WHERE one) AS g1_size, count(*) FILTER (WHERE NOT one) AS g2_size, median(n) FILTER (WHERE one) AS g1_median, median(n) FILTER (WHERE NOT one) AS g2_median,
   sum(mid) FILTER (WHERE one) - count(*) FILTER (WHERE one) * (count(*) FILTER (WHERE one) + 1) / 2.0::DOUBLE AS u1 FROM k GROUP BY {_BY}, loc_group, g1, g2),
 d AS (SELECT *, CAST(g1_size AS DOUBLE) * g2_size AS pairs, 2 * u1 / (CAST(g1_size AS DOUBLE) * g2_size) - 1 AS delta FROM u WHERE g1_size > 0 AND g2_size > 0)
 SELECT concat(g1, ',', g2) AS comparison, {_BY}, loc_group, g1_size + g2_size AS size, g1, g2, g1_size, g2_size, round_even(CAST(g1_median AS DOUBLE), 2) AS g1_median, round_even(CAST(g2_median AS DOUBLE), 2) AS g2_median,
   round_even(u1, 2) AS mww_u1, round_even(pairs - u1, 2) AS mww_u2, round_even(delta, 2) AS d_value, CASE WHEN delta > 0 THEN '+' WHEN delta < 0 THEN '-' ELSE '=' END AS d_sign,
   CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect_size FROM d""")
def comparison_cube(t):
    return cubes.comparison_cube(t.sql(LINKED), ["all", "diff", "absent"], _PAIRS_OF, t.sql(STRATA)).drop("mww_p", "N", "S", "M", "L")


_SHARES = f"""{_LONG}, g AS (SELECT unnest(['NTR', 'ATR', 'HTR', 'MTR']) AS rg), c AS (SELECT {_BY}, rg, unnest(CASE WHEN len(smells) = 0 THEN ['none'] ELSE list_concat(['any'], smells) END) AS smell FROM m),
 names AS (SELECT DISTINCT {_BY}, smell FROM c UNION SELECT DISTINCT {_BY}, unnest(['any', 'none']) FROM m),
 full_ AS (SELECT {_BY}, g.rg AS rg_group, smell, (SELECT count(*) FROM m WHERE (m.strategy, m.tool, m.smell_detector, m.change, m.rg) = (names.strategy, names.tool, names.smell_detector, names.change, g.rg)) AS methods,
   (SELECT count(*) FROM c WHERE (c.strategy, c.tool, c.smell_detector, c.change, c.rg, c.smell) = (names.strategy, names.tool, names.smell_detector, names.change, g.rg, names.smell)) AS smell_n FROM names, g),
 shares AS (SELECT *, CASE WHEN methods > 0 THEN round_even(smell_n / methods::DOUBLE * 100.0::DOUBLE, 2) ELSE 0.0 END AS percent FROM full_)"""


@query("prevalence_cube", f"WITH {_SHARES} SELECT * FROM shares")
def prevalence_cube(t):
    return cubes.prevalence_cube(t.sql(LINKED), ["all", "diff"], ["NTR", "ATR", "HTR", "MTR"])


@query("greatest_cube", f"""WITH {_SHARES}, d AS (SELECT a.strategy, a.tool, a.smell_detector, a.change, a.smell, a.rg_group AS g1, b.rg_group AS g2, round_even(a.percent - b.percent, 2) AS difference FROM shares a JOIN shares b USING (strategy, tool, smell_detector, change, smell)
   WHERE a.smell NOT IN ('any', 'none') AND (a.rg_group, b.rg_group) IN (('HTR', 'NTR'), ('HTR', 'ATR'), ('MTR', 'NTR')))
 SELECT *, CAST(row_number() OVER (PARTITION BY {_BY}, g1, g2 ORDER BY difference DESC, smell) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY {_BY}, g1, g2 ORDER BY difference DESC, smell) <= 3""")
def greatest_cube(t):
    shares = cubes.prevalence_cube(t.sql(LINKED), ["all", "diff"], ["NTR", "ATR", "HTR", "MTR"])
    return cubes.greatest_cube(shares, _PAIRS_OF, 3)


# ---- lookups --------------------------------------------------------------------------------

_LABELLED = f"SELECT project, from_url, to_url, CAST(0 AS BIGINT) AS _ord FROM ({TRUTH}) g WHERE CAST(substr(to_url, 2) AS INTEGER) % 3 <> 0"


@query("calling_tests", f"""WITH g AS ({_LABELLED}), e AS (SELECT project, from_url, to_url, min(_ord) AS _ord FROM ({EDGES}) x GROUP BY 1, 2, 3)
 SELECT project, to_url, from_url, 'labels' AS source, _ord FROM g UNION ALL SELECT project, to_url, from_url, 'calls', _ord FROM e WHERE (project, to_url) NOT IN (SELECT project, to_url FROM g)""")
def calling_tests(t):
    """The tests of every method: labelled ones, else those that call it."""
    return review.calling_tests([("labels", t.sql(_LABELLED)), ("calls", t.sql(EDGES))], ["project"])


@query("nearest_of_all", """WITH a AS (SELECT event_id, ts FROM {events} WHERE event_type <> 'click'), b AS (SELECT DISTINCT ts FROM {events} WHERE event_type = 'click'),
 p AS (SELECT event_id, a.ts, b.ts AS x FROM a ASOF LEFT JOIN b ON a.ts >= b.ts), n AS (SELECT event_id, b.ts AS y FROM a ASOF LEFT JOIN b ON a.ts <= b.ts)
 SELECT event_id, round(least(epoch(ts) - epoch(x), epoch(y) - epoch(ts)) / 86400, 6) AS gap_days FROM p JOIN n USING (event_id)""")
def nearest_of_all(t):
    """An as-of join over all events, without a key."""
    mine, others = (t.events.where(c).select("event_id", "ts") for c in ("event_type <> 'click'", "event_type = 'click'"))
    return review.nearest_gap(mine, others).select("event_id", F.round("gap_days", 6).alias("gap_days"))
