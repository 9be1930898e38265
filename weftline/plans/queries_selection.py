"""Registered queries: selections by name, place and strategy, and the steps of a project's linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators import evaluation, filters, linking, relational, reporting, scoring, smells
from weftline.plans.queries_sampling import SIDES
from weftline.plans.queries_study import COUNTS, CUTS, FIRST_PAIR, LOCS, METRIC, PRED, PREVALENCE, SCORE_SQL, TRUTH, UNIQUE
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, SMELLS, TESTS

_ARTIFACT = f"SELECT url, min(artifact) AS artifact FROM ({SIDES}) s GROUP BY url"
_SCORED = f"SELECT project, from_url, to_url, CASE WHEN score > 0.07 THEN '1' ELSE '0' END AS tech_nc, _ord FROM ({EDGES}) e"


@query("linked_project", f"""WITH a AS ({_ARTIFACT}), k AS (SELECT s.* FROM ({_SCORED}) s JOIN a f ON f.url = from_url JOIN a t ON t.url = to_url WHERE f.artifact LIKE '%test-case-method%' AND t.artifact LIKE '%main-code%'),
 n AS (SELECT from_url, count(DISTINCT to_url) AS n FROM k GROUP BY 1) SELECT from_url, to_url, _ord FROM k JOIN n USING (from_url) WHERE tech_nc = '1' OR n = 1 {FIRST_PAIR}""")
def linked_project(t):
    """Roles first, then the strategy: tests with one main target, or equal names."""
    return linking.link_project(t.sql(_SCORED), t.sql(_ARTIFACT), "nc--omc").select("from_url", "to_url", "_ord")


@query("selected_projects", f"SELECT project, url, _ord FROM ({METHODS}) m WHERE project IN ('p1', 'p3')")
def selected_projects(t):
    """Names from the environment, as none are given, within a slice of the catalog."""
    found = filters.resolve_filters({}, {"projects": " p3,p0 , p1,p3"}, {"projects": "p2", "tools": ":"})
    catalog = [f"p{i}" for i in range(4)]
    chosen = filters.select_projects(catalog, found["projects"], "1::2,-2,0:0")
    return t.sql(METHODS).where(F.col("project").isin(*chosen)).select("project", "url", "_ord")


@query("average_of_all_groups", f"SELECT 'all' AS grp, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, {METRIC.replace('tp', 'sum(tp)').replace('fp', 'sum(fp)').replace('fn', 'sum(fn)')} FROM ({COUNTS}) c WHERE project IN ('p0', 'p1', 'p3')")
def average_of_all_groups(t):
    name, members = evaluation.resolve_groups({"a": ["p0", "p1"], "b": ["p1", "p3"]}, None)
    pairs = t.spark.createDataFrame([(name, m) for m in members], "grp string, experiment string")
    a, b = (t.sql(s).withColumn("experiment", F.col("project")) for s in (PRED, TRUTH))
    return evaluation.micro_average(a, b, pairs)


@query("masked_scores", f"SELECT e.from_url, e.to_url, e._ord, round_even(s.tech_nc, 2) AS tech_nc, round_even(s.tech_lcba, 2) AS tech_lcba, CAST(NULL AS DOUBLE) AS tech_tfidf, CASE WHEN e._ord = max(e._ord) OVER (PARTITION BY e.from_url) THEN 1 ELSE 0 END AS tech_lc FROM ({EDGES}) e JOIN ({SCORE_SQL}) s USING (from_url, to_url)")
def masked_scores(t):
    """The scores that two strategies read; the others are null."""
    columns = linking.strategy_columns(["nc", "lcba"])
    rows = scoring.score_candidates(t.sql(EDGES), columns, by=[])
    return rows.select("from_url", "to_url", "_ord", "tech_nc", "tech_lcba", "tech_tfidf", "tech_lc")


@query("box_values_by_size", f"SELECT CASE WHEN loc <= p70 THEN 'S' WHEN loc <= p80 THEN 'M' WHEN loc <= p90 THEN 'L' ELSE 'XL' END AS grp, CAST(CASE WHEN smells = '' THEN 0 ELSE len(string_split(smells, ' ')) END AS BIGINT) AS smell_count, count(*) AS n FROM {UNIQUE} u JOIN ({LOCS}) l USING (from_url), {CUTS} c GROUP BY 1, 2")
def box_values_by_size(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS)
    groups = smells.with_loc_groups(smells.first_valid_loc(t.sql(SMELLS)))
    return reporting.box_values(unique.join(groups.select("from_url", "loc_group"), "from_url"), "loc_group")


@query("distinct_links", f"SELECT from_url, to_url, project, _ord FROM ({EDGES}) e {FIRST_PAIR}")
def distinct_links(t):
    return relational.keep_first(t.sql(EDGES), ["from_url", "to_url"]).select("from_url", "to_url", "project", "_ord")


# ---- associations without their p-values ----------------------------------------------------

_TABLE = ["smell", "baseline_n", "baseline_smell_n", "baseline_percent", "focal_n", "focal_smell_n", "focal_percent", "difference_pp"]


def _association(rows: str, by: str = "") -> str:
    """SQL of counts, shares, their difference and the stratified odds of (by, project, rg_all, marks)."""
    k = by + ", " if by else ""
    on = f"USING ({k}project)"
    return f"""WITH u AS ({rows}), s AS (SELECT {k}project, count(*) FILTER (WHERE rg_all = 'HTR') AS f, count(*) FILTER (WHERE rg_all = 'NTR') AS g FROM u GROUP BY {k}project),
 x AS (SELECT {k}project, rg_all, unnest(marks) AS smell FROM u), h AS (SELECT {k}project, smell, count(*) FILTER (WHERE rg_all = 'HTR') AS a, count(*) FILTER (WHERE rg_all = 'NTR') AS c FROM x GROUP BY {k}project, smell),
 t AS (SELECT {k}CAST(sum(f) AS BIGINT) AS f, CAST(sum(g) AS BIGINT) AS g FROM s {"GROUP BY " + by if by else ""}), p AS (SELECT {k}smell, CAST(sum(a) AS BIGINT) AS a, CAST(sum(c) AS BIGINT) AS c FROM h GROUP BY {k}smell),
 m AS (SELECT {k}smell, sum(CAST(a AS DOUBLE) * (g - c) / (f + g)) AS num, sum(CAST(f - a AS DOUBLE) * c / (f + g)) AS den FROM h JOIN s {on} WHERE f > 0 AND g > 0 GROUP BY {k}smell)
 SELECT {k}smell, g AS baseline_n, c AS baseline_smell_n, round_even(CAST(c AS DOUBLE) / g * 100, 2) AS baseline_percent, f AS focal_n, a AS focal_smell_n, round_even(CAST(a AS DOUBLE) / f * 100, 2) AS focal_percent,
  round_even(CAST(a AS DOUBLE) / f * 100 - CAST(c AS DOUBLE) / g * 100, 2) AS difference_pp, CASE WHEN den > 0 THEN round_even(num / den, 2) END AS mh_odds_ratio FROM p JOIN t {"USING (" + by + ")" if by else "ON true"} LEFT JOIN m USING ({k}smell) WHERE f > 0 AND g > 0"""


_MARKS = "CASE WHEN smells = '' THEN ['none'] ELSE list_concat(['any'], string_split(smells, ' ')) END"
_KEPT = "list_filter(string_split(smells, ' '), lambda x: x IN ('error', 'click'))"
_SIZED = f"SELECT CASE WHEN loc < 30 THEN 'Small' WHEN loc <= 60 THEN 'Medium' ELSE 'Large' END AS control_group, project, rg_all, CASE WHEN len({_KEPT}) > 0 THEN list_concat({_KEPT}, ['ROBUST']) ELSE [] END AS marks FROM {UNIQUE} u JOIN ({LOCS}) l USING (from_url) WHERE rg_all IN ('HTR', 'NTR')"


def _finite(df):
    odds = F.col("mh_odds_ratio")
    return df.withColumn("mh_odds_ratio", F.when(F.abs(odds) < float("inf"), odds))


@query("association_rows", _association(f"SELECT project, rg_all, {_MARKS} AS marks FROM {UNIQUE} u WHERE rg_all IN ('HTR', 'NTR')"))
def association_rows(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    return _finite(smells.association(unique, "rg_all", "HTR", "NTR")).select(*_TABLE, "mh_odds_ratio")


@query("size_controlled_rows", _association(_SIZED, "control_group"))
def size_controlled_rows(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    controls = smells.first_valid_loc(t.sql(SMELLS)).select("from_url", smells.control_group(F.col("loc")).alias("control_group"))
    found = smells.size_controlled(unique, controls, "rg_all", "HTR", "NTR", ["error", "click"])
    return _finite(found).select("control_group", *_TABLE, "mh_odds_ratio")


# ---- exact tests and correlations -----------------------------------------------------------


@query("fisher_p", """WITH t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS a, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) FILTER (WHERE event_type = 'view') AS c, count(*) FILTER (WHERE event_type = 'signup') AS d FROM {events} GROUP BY 1),
 f AS (SELECT *, (a + b) * (c + d) * (a + c) * (b + d) = 0 AS flat FROM t), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM f WHERE NOT flat),
 w AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS x FROM k),
 o AS (SELECT *, max(CASE WHEN k = a THEN x END) OVER (PARTITION BY user_id) AS mine FROM w)
 SELECT user_id, round(least(1.0, sum(x) FILTER (WHERE x <= mine * 1.0000001)), 6) AS p FROM o GROUP BY 1 UNION ALL SELECT user_id, 1.0 FROM f WHERE flat""")
def fisher_p(t):
    """The two-sided p of exact tests; the odds ratio and its interval have no closed form."""
    kinds = ("error", "click", "view", "signup")
    counts = t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(e) for e in kinds])
    found = counts.select("user_id", statistics.fisher_column(*[F.col(e) for e in kinds]).alias("x"))
    return found.select("user_id", F.round("x.p", 6).alias("p"))


@query("linear_correlations", f"""WITH u AS (SELECT CAST(loc AS DOUBLE) AS x, CAST(len(list_filter(string_split(smells, ' '), lambda s: s IN ('error', 'click'))) AS DOUBLE) AS y FROM {UNIQUE} u0 JOIN ({LOCS}) l USING (from_url)),
 r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM u)
 SELECT 'pearson' AS correlation_algorithm, round(corr(x, y), 9) AS correlation FROM r UNION ALL SELECT 'spearman', round(corr(rx, ry), 9) FROM r""")
def linear_correlations(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS)
    found = smells.size_correlations(unique.join(smells.first_valid_loc(t.sql(SMELLS)), "from_url"), ["error", "click"])
    return found.where("correlation_algorithm <> 'kendall'").select("correlation_algorithm", F.round("correlation", 9).alias("correlation"))


@query("paired_ranks", f"""WITH s AS ({PREVALENCE}), d AS (SELECT a.percent - b.percent AS d FROM s a JOIN s b USING (smell) WHERE a.rg_group = 'HTR' AND b.rg_group = 'NTR' AND smell NOT IN ('any', 'none')),
 r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS mid FROM d WHERE d <> 0)
 SELECT (SELECT count(*) FROM d) AS size, coalesce(least(sum(mid) FILTER (WHERE d > 0), sum(mid) FILTER (WHERE d < 0)), 0.0) AS w_stat FROM r""")
def paired_ranks(t):
    pairs = smells.paired_smells(smells.prevalence(t.sql(TESTS), "rg_all"), "HTR", "NTR")
    return smells.signed_rank(pairs).select("size", "w_stat")
