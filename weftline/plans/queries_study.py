"""Registered queries: scoring, linking, evaluation, revision statistics, smells, agreement, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import statistics, text
from weftline.operators import (
    agreement, evaluation, filters, graph, linking, relational, review, revisions, sampling, scoring, signatures,
    smell_bridge, smells,
)
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, PAIRS, SMELLS, TESTS, TRUTH

R6 = lambda c: F.round(c, 6).alias(c)

PAIR_SQL = f"""SELECT from_url, to_url, arg_max(lower(from_name), _ord) AS from_name, arg_max(lower(to_name), _ord) AS to_name, min(CAST(to_call_depth AS INTEGER)) AS depth,
 max(CASE WHEN CAST(to_lcba AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS lcba FROM ({EDGES}) e GROUP BY 1, 2"""
SCORE_SQL = f"""WITH p AS ({PAIR_SQL}), s AS (SELECT p.*, regexp_replace(regexp_replace(from_name, '^test_?', ''), '_?test$', '') AS subject,
  count(*) OVER (PARTITION BY from_url) AS functions, count(*) OVER (PARTITION BY to_url) AS callers FROM p), n AS (SELECT count(DISTINCT from_url) AS tests FROM p),
 b AS (SELECT from_url, to_url, depth, CAST(subject = to_name AS INTEGER)::DOUBLE AS nc, CAST(contains(from_name, to_name) AS INTEGER)::DOUBLE AS ncc, lcba::DOUBLE AS lcba,
  (1.0 - levenshtein(to_name, subject) / CAST(greatest(length(to_name), length(subject)) AS DOUBLE)) * pow(0.5, depth - 1) AS leven,
  CASE WHEN tests > 1 THEN 1.0 / (1.0 + (callers - 1) / CAST(tests - 1 AS DOUBLE)) ELSE 0 END * pow(0.5, depth - 1) AS tarantula,
  ln(1 + 1 / CAST(functions AS DOUBLE)) * ln(tests / CAST(callers AS DOUBLE)) * pow(0.5, depth - 1) AS tfidf FROM s, n)
 SELECT from_url, to_url, depth, nc AS tech_nc, ncc AS tech_ncc, lcba AS tech_lcba,
  round(CASE WHEN max(leven) OVER w > 0 THEN leven / max(leven) OVER w ELSE leven END, 6) AS tech_leven,
  round(CASE WHEN max(tarantula) OVER w > 0 THEN tarantula / max(tarantula) OVER w ELSE tarantula END, 6) AS tech_tarantula,
  round(CASE WHEN max(tfidf) OVER w > 0 THEN tfidf / max(tfidf) OVER w ELSE tfidf END, 6) AS tech_tfidf FROM b WINDOW w AS (PARTITION BY from_url)"""


@query("pair_scores", SCORE_SQL)
def pair_scores(t):
    s = scoring.pair_scores(t.sql(EDGES))
    return s.select("from_url", "to_url", "depth", "tech_nc", "tech_ncc", "tech_lcba", *map(R6, ("tech_leven", "tech_tarantula", "tech_tfidf")))


_SCALED = ("lcs_b", "lcs_u", "leven", "tarantula", "tfidf")
ALL_SCORES_SQL = f"""WITH RECURSIVE p AS (SELECT project, from_url, to_url, arg_max(lower(from_name), _ord) AS from_name, arg_max(lower(to_name), _ord) AS name, min(CAST(to_call_depth AS INTEGER)) AS depth,
  max(CASE WHEN CAST(to_lcba AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS lcba FROM ({EDGES}) e GROUP BY 1, 2, 3), t AS (SELECT project, count(DISTINCT from_url) AS tests FROM p GROUP BY 1),
 s AS (SELECT p.*, tests, regexp_replace(regexp_replace(from_name, '^test_?', ''), '_?test$', '') AS subject, count(*) OVER (PARTITION BY project, from_url) AS functions, count(*) OVER (PARTITION BY project, to_url) AS callers, pow(0.5, depth - 1) AS fall FROM p JOIN t USING (project)),
 q AS (SELECT DISTINCT name AS a, subject AS b FROM s), d AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM q
  UNION ALL SELECT a, b, i + 1, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN r[k] + 1 ELSE r[k + 1] END)))) FROM d WHERE i < len(a)),
 c AS (SELECT a AS name, b AS subject, CAST(r[len(b) + 1] AS DOUBLE) AS common FROM d WHERE i = len(a)),
 x AS (SELECT project, from_url, to_url, CAST(subject = name AS INTEGER)::DOUBLE AS nc, CAST(contains(from_name, name) AS INTEGER)::DOUBLE AS ncc, common / greatest(length(name), length(subject)) * fall AS lcs_b, common / length(name) * fall AS lcs_u,
  (1.0 - levenshtein(name, subject) / CAST(greatest(length(name), length(subject)) AS DOUBLE)) * fall AS leven, lcba::DOUBLE AS lcba, CASE WHEN tests > 1 THEN 1.0 / (1.0 + (callers - 1) / CAST(tests - 1 AS DOUBLE)) ELSE 0 END * fall AS tarantula,
  ln(1 + 1 / CAST(functions AS DOUBLE)) * ln(tests / CAST(callers AS DOUBLE)) * fall AS tfidf FROM s JOIN c USING (name, subject)),
 z AS (SELECT project, from_url, to_url, nc, ncc, lcba, {", ".join(f"CASE WHEN max({c}) OVER w > 0 THEN {c} / max({c}) OVER w ELSE {c} END AS {c}" for c in _SCALED)} FROM x WINDOW w AS (PARTITION BY project, from_url)),
 m AS (SELECT *, (nc + ncc + lcs_b + lcs_u + leven + lcba + tarantula + tfidf) / 8 AS combined FROM z),
 o AS (SELECT * EXCLUDE (combined), CASE WHEN max(combined) OVER w > 0 THEN combined / max(combined) OVER w ELSE combined END AS combined FROM m WINDOW w AS (PARTITION BY project, from_url))
 SELECT e.*, {", ".join(f"round_even(o.{c}, 2) AS tech_{c}" for c in ("nc", "ncc", "lcba", *_SCALED, "combined"))}, CASE WHEN e._ord = max(e._ord) OVER (PARTITION BY e.project, e.from_url) THEN 1 ELSE 0 END AS tech_lc FROM ({EDGES}) e JOIN o USING (project, from_url, to_url)"""


@query("scored_candidates", ALL_SCORES_SQL)
def scored_candidates(t):
    """All nine techniques of every candidate row, the common subsequences included."""
    return scoring.score_candidates(t.sql(EDGES))


@query("last_calls", f"SELECT from_url, to_url, _ord, CASE WHEN _ord = max(_ord) OVER (PARTITION BY from_url) THEN 1 ELSE 0 END AS tech_lc FROM ({EDGES}) e")
def last_calls(t):
    return scoring.last_call(t.sql(EDGES)).select("from_url", "to_url", "_ord", "tech_lc")


@query("model_ranks", f"SELECT from_url, to_name, _ord, dense_rank() OVER (PARTITION BY from_url ORDER BY best DESC, first) AS rank, CAST(dense_rank() OVER (PARTITION BY from_url ORDER BY best DESC, first) <= 2 AS INTEGER) AS label_pred FROM (SELECT *, max(score) OVER (PARTITION BY from_url, to_name) AS best, min(_ord) OVER (PARTITION BY from_url, to_name) AS first FROM ({EDGES}) e) x")
def model_ranks(t):
    ranked = scoring.predict_top(scoring.model_rank(t.sql(EDGES), "from_url", "to_name"), 2)
    return ranked.select("from_url", "to_name", "_ord", F.col("rank").cast("long").alias("rank"), "label_pred")


# ---- linking --------------------------------------------------------------------------------

TECH = f"""SELECT e.*, CASE WHEN _ord % 3 = 0 THEN 1 ELSE 0 END AS tech_nc, CAST(_ord % 101 AS DOUBLE) / 100 AS tech_tfidf, CASE WHEN _ord % 11 = 0 THEN '' ELSE CAST(_ord % 2 AS STRING) END AS tech_testlinker
FROM ({EDGES}) e"""
FIRST_PAIR = "QUALIFY row_number() OVER (PARTITION BY from_url, to_url ORDER BY _ord) = 1"


@query("link_threshold", f"SELECT from_url, to_url, _ord FROM ({TECH}) x WHERE tech_tfidf >= 0.9 {FIRST_PAIR}")
def link_threshold(t):
    return linking.select_links(t.sql(TECH), "tfidf").select("from_url", "to_url", "_ord")


@query("link_model_column", f"SELECT from_url, to_url, _ord FROM ({TECH}) x WHERE TRY_CAST(tech_testlinker AS DOUBLE) > 0 {FIRST_PAIR}")
def link_model_column(t):
    return linking.select_links(t.sql(TECH), "testlinker").select("from_url", "to_url", "_ord")


#: Tests that call few methods.
CALLERS = "SELECT concat('t', CAST(l_orderkey AS STRING)) AS from_url, concat('m', CAST(l_suppkey % 3 AS STRING)) AS to_url, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(l_orderkey AS BIGINT) AS _ord FROM {lineitem}"


@query("link_one_target", f"SELECT from_url, to_url, min(_ord) AS _ord FROM ({CALLERS}) x WHERE from_url IN (SELECT from_url FROM ({CALLERS}) y GROUP BY 1 HAVING count(DISTINCT to_url) = 1) GROUP BY 1, 2")
def link_one_target(t):
    return linking.select_links(t.sql(CALLERS), "omc").select("from_url", "to_url", "_ord")


@query("link_union_of_stages", f"SELECT from_url, to_url, _ord FROM ({TECH}) x WHERE tech_nc > 0 OR tech_tfidf >= 0.9 {FIRST_PAIR}")
def link_union_of_stages(t):
    return linking.select_links(t.sql(TECH), "tfidf--nc").select("from_url", "to_url", "_ord")


@query("link_exclusive", f"WITH s AS (SELECT *, CASE WHEN tech_nc > 0 THEN 0 WHEN tech_tfidf >= 0.9 THEN 1 END AS stage FROM ({TECH}) x), b AS (SELECT *, min(stage) OVER (PARTITION BY from_url) AS best FROM s WHERE stage IS NOT NULL) SELECT from_url, to_url, _ord FROM b WHERE stage = best {FIRST_PAIR}")
def link_exclusive(t):
    return linking.select_links(t.sql(TECH), "nc--tfidf", exclusive=True).select("from_url", "to_url", "_ord")


# ---- evaluation -----------------------------------------------------------------------------

PRED = f"SELECT project, from_url, to_url, score, _ord FROM ({EDGES}) e WHERE score >= 0.05"
METRIC = """round_even(tp / nullif(tp + fp, 0)::DOUBLE, 2) AS precision, round_even(tp / nullif(tp + fn, 0)::DOUBLE, 2) AS recall, round_even(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 2) AS f1"""
COUNTS = f"""SELECT project, count(*) FILTER (WHERE t = 1) AS gt_links, count(*) FILTER (WHERE p = 1) AS pred_links, count(*) FILTER (WHERE p = 1 AND t = 1) AS tp, count(*) FILTER (WHERE p = 1 AND t IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn
 FROM (SELECT DISTINCT project, from_url, to_url, 1 AS p FROM ({PRED}) a) a FULL JOIN (SELECT *, 1 AS t FROM ({TRUTH}) g) b USING (project, from_url, to_url) GROUP BY project"""


@query("link_metrics", f"SELECT *, {METRIC} FROM ({COUNTS}) c")
def link_metrics(t):
    return evaluation.link_metrics(t.sql(PRED), t.sql(TRUTH), ["project"])


@query("micro_average", f"SELECT g AS grp, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round_even(sum(tp) / sum(tp + fp)::DOUBLE, 2) AS precision, round_even(sum(tp) / sum(tp + fn)::DOUBLE, 2) AS recall, round_even(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 2) AS f1 FROM ({COUNTS}) c JOIN (SELECT 'a' AS g, 'p0' AS project UNION ALL SELECT 'a', 'p1' UNION ALL SELECT 'b', 'p1' UNION ALL SELECT 'b', 'p3') m USING (project) GROUP BY g")
def micro_average(t):
    members = t.spark.createDataFrame([("a", "p0"), ("a", "p1"), ("b", "p1"), ("b", "p3")], "grp string, experiment string")
    a, b = (t.sql(s).withColumn("experiment", F.col("project")) for s in (PRED, TRUTH))
    return evaluation.micro_average(a, b, members)


@query("mismatch_rows", f"WITH p AS (SELECT from_url, to_url FROM ({PRED}) a GROUP BY 1, 2), g AS (SELECT DISTINCT from_url, to_url FROM ({TRUTH}) x) SELECT coalesce(p.from_url, g.from_url) AS from_url, coalesce(p.to_url, g.to_url) AS to_url, CASE WHEN p.from_url IS NULL THEN 'FN' WHEN g.from_url IS NULL THEN 'FP' ELSE 'TP' END AS label FROM p FULL JOIN g ON p.from_url = g.from_url AND p.to_url = g.to_url")
def mismatch_rows(t):
    truth = t.sql(TRUTH).withColumn("_ord", F.lit(0).cast("long"))
    return evaluation.mismatches(t.sql(PRED), truth).select("from_url", "to_url", "label")


@query("mean_average_precision", f"""WITH f AS (SELECT * FROM ({PRED}) a QUALIFY row_number() OVER (PARTITION BY project, from_url, to_url ORDER BY _ord) = 1),
 n AS (SELECT project, from_url, count(*) AS links FROM ({TRUTH}) g GROUP BY 1, 2), r AS (SELECT f.*, g.to_url IS NOT NULL AS hit, row_number() OVER (PARTITION BY f.project, f.from_url ORDER BY score DESC, f._ord) AS rk FROM f LEFT JOIN ({TRUTH}) g USING (project, from_url, to_url)),
 h AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY project, from_url ORDER BY rk) AS hits FROM r), s AS (SELECT project, from_url, sum(hits / CAST(rk AS DOUBLE)) FILTER (WHERE hit) AS s FROM h GROUP BY 1, 2)
 SELECT n.project, round(avg(coalesce(s.s, 0) / links), 6) AS map FROM n LEFT JOIN s USING (project, from_url) GROUP BY n.project""")
def mean_average_precision(t):
    out = evaluation.mean_average_precision(t.sql(PRED), t.sql(TRUTH), "score", ["project"])
    return out.select("project", R6("map"))


@query("pr_auc", """WITH p AS (SELECT value AS s, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS pos, count(*) AS n FROM {events} GROUP BY 1),
 c AS (SELECT s, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER () AS total FROM p WINDOW w AS (ORDER BY s DESC)), d AS (SELECT s, tp / al::DOUBLE AS pr, tp / total::DOUBLE AS rc FROM c)
 SELECT round(sum((rc - prev_rc) * (pr + prev_pr) / 2), 6) AS auc FROM (SELECT *, lag(rc, 1, 0) OVER (ORDER BY s DESC) AS prev_rc, lag(pr, 1, 1) OVER (ORDER BY s DESC) AS prev_pr FROM d) x""")
def pr_auc(t):
    rows = t.events.select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("long").alias("label"))
    return evaluation.pr_auc(rows).select(R6("auc"))


OWN = f"SELECT * FROM ({PRED}) a0 WHERE (project, from_url) IN (SELECT project, from_url FROM ({TRUTH}) g0)"


@query("evaluate_projects", f"""WITH own AS ({OWN}), t AS ({TRUTH}), c AS (SELECT project, count(*) FILTER (WHERE t = 1) AS gt_links, count(*) FILTER (WHERE p = 1) AS pred_links, count(*) FILTER (WHERE p = 1 AND t = 1) AS tp, count(*) FILTER (WHERE p = 1 AND t IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn
  FROM (SELECT DISTINCT project, from_url, to_url, 1 AS p FROM own) a FULL JOIN (SELECT *, 1 AS t FROM t) b USING (project, from_url, to_url) GROUP BY project),
 f AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY project, from_url, to_url ORDER BY _ord) = 1), n AS (SELECT project, from_url, count(*) AS links FROM t GROUP BY 1, 2),
 r AS (SELECT f.*, t.to_url IS NOT NULL AS hit, row_number() OVER (PARTITION BY f.project, f.from_url ORDER BY score DESC, f._ord) AS rk FROM f LEFT JOIN t USING (project, from_url, to_url)),
 h AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY project, from_url ORDER BY rk) AS hits FROM r), s AS (SELECT project, from_url, sum(hits / CAST(rk AS DOUBLE)) FILTER (WHERE hit) AS s FROM h GROUP BY 1, 2),
 m AS (SELECT n.project, round_even(avg(coalesce(s.s, 0) / links), 2) AS map FROM n LEFT JOIN s USING (project, from_url) GROUP BY n.project),
 l AS (SELECT e.project, e.score, t.to_url IS NOT NULL AS hit FROM (SELECT * FROM ({EDGES}) e0 WHERE (project, from_url) IN (SELECT project, from_url FROM t) QUALIFY row_number() OVER (PARTITION BY project, from_url, to_url ORDER BY _ord) = 1) e LEFT JOIN t USING (project, from_url, to_url)),
 p AS (SELECT project, score, count(*) FILTER (WHERE hit) AS pos, count(*) AS n FROM l GROUP BY 1, 2),
 k AS (SELECT project, score, sum(pos) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS pr, sum(pos) OVER w / CAST(sum(pos) OVER (PARTITION BY project) AS DOUBLE) AS rc FROM p WINDOW w AS (PARTITION BY project ORDER BY score DESC)),
 z AS (SELECT project, round_even(sum((rc - prev_rc) * (pr + prev_pr) / 2), 2) AS auc FROM (SELECT *, lag(rc, 1, 0) OVER (PARTITION BY project ORDER BY score DESC) AS prev_rc, lag(pr, 1, 1) OVER (PARTITION BY project ORDER BY score DESC) AS prev_pr FROM k) x GROUP BY 1)
 SELECT c.*, {METRIC}, map, auc FROM c LEFT JOIN m USING (project) LEFT JOIN z USING (project)""")
def evaluate_projects(t):
    truth = t.sql(TRUTH)
    return evaluation.evaluate(t.sql(PRED), truth, t.sql(EDGES), "score")


# ---- revisions ------------------------------------------------------------------------------

LINES = "SELECT 'tool' AS tool, l_linestatus AS project, CASE WHEN l_returnflag = 'R' THEN 'main-code' ELSE 'test-case-method' END AS method_kind, CAST(l_quantity AS BIGINT) AS ch_all, CAST(l_linenumber AS BIGINT) AS ch_diff FROM {lineitem}"
RANKED = f"""WITH long AS (SELECT 'tool' AS tool, project, method_kind, 'all' AS change, greatest(ch_all - 1, 0) AS v FROM ({LINES}) a UNION ALL SELECT 'tool', project, method_kind, 'diff', greatest(ch_diff - 1, 0) FROM ({LINES}) b),
 pooled AS (SELECT * FROM long UNION ALL SELECT tool, 'all', method_kind, change, v FROM long), h AS (SELECT project, change, v, count(*) FILTER (WHERE method_kind = 'main-code') AS a, count(*) AS t FROM pooled GROUP BY 1, 2, 3),
 r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY project, change ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mid FROM h),
 u AS (SELECT project, change, CAST(sum(t) AS BIGINT) AS size, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t - a) AS BIGINT) AS n2, CAST(sum(mid * a) AS DOUBLE) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u1 FROM r GROUP BY 1, 2)"""
DELTA = "(2 * u1 / (CAST(n1 AS DOUBLE) * n2) - 1)"
SIZE = f"CASE WHEN abs({DELTA}) < 0.147 THEN 'negligible' WHEN abs({DELTA}) < 0.33 THEN 'small' WHEN abs({DELTA}) < 0.474 THEN 'medium' ELSE 'large' END"


@query("revision_comparison", f"""{RANKED} SELECT project, 'tool' AS tool, change, size, n1 AS main_size, n2 AS test_size, round_even(u1, 2) AS mww_u1, round_even(CAST(n1 AS DOUBLE) * n2 - u1, 2) AS mww_u2,
 round_even({DELTA}, 2) AS d_value, CASE WHEN {DELTA} > 0 THEN '+' WHEN {DELTA} < 0 THEN '-' ELSE '=' END AS d_sign, {SIZE} AS effect_size FROM u""")
def revision_comparison(t):
    return revisions.revision_comparison(t.sql(LINES), ["ch_all", "ch_diff"]).drop("mww_p", "N", "S", "M", "L")


def tail(z: str) -> str:
    """SQL of twice the normal tail beyond ``z``, at most 1, by the series of the integral (exact to 1e-8)."""
    term = f"pow(-1, k) * exp((2 * k + 1) * ln({z}) - lgamma(k + 1) - k * ln(2)) / (2 * k + 1)"
    return f"CASE WHEN {z} <= 0 THEN 1.0 WHEN {z} > 6 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - 2 * list_sum(list_transform(range(0, 90), lambda k: {term})) / sqrt(2 * pi()))) END"


SPREAD = "(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))))"
Z_SQL = f"((greatest(u1, CAST(n1 AS DOUBLE) * n2 - u1) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / sqrt({SPREAD}))"
WITH_TIES = RANKED.replace(" AS u1 FROM r", " AS u1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM r")
MARKS = ", ".join(f"CASE WHEN effect_size = '{n}' THEN 'x' ELSE '' END AS \"{m}\"" for m, n in (("N", "negligible"), ("S", "small"), ("M", "medium"), ("L", "large")))
TESTED = f"""SELECT project, 'tool' AS tool, change, size, n1 AS main_size, n2 AS test_size, round_even(u1, 2) AS mww_u1, round_even(CAST(n1 AS DOUBLE) * n2 - u1, 2) AS mww_u2, round_even(p, 2) AS mww_p,
 round_even({DELTA}, 2) AS d_value, CASE WHEN {DELTA} > 0 THEN '+' WHEN {DELTA} < 0 THEN '-' ELSE '=' END AS d_sign, {SIZE} AS effect_size FROM (SELECT *, {tail("z")} AS p FROM (SELECT *, {Z_SQL} AS z FROM u WHERE n1 > 0 AND n2 > 0) z0) z1 WHERE project = 'all' OR size >= 30"""


@query("revision_comparison_p", f"{WITH_TIES} SELECT *, {MARKS} FROM ({TESTED}) x")
def revision_comparison_p(t):
    """With p-values: their SQL sums the series of the normal integral."""
    return revisions.revision_comparison(t.sql(LINES), ["ch_all", "ch_diff"])


CORRELATED = f"""WITH l AS (SELECT project, 'all' AS change, TRY_CAST(to_ch_all AS DOUBLE) AS x, TRY_CAST(from_ch_all AS DOUBLE) AS y FROM ({PAIRS}) a UNION ALL SELECT project, 'diff', TRY_CAST(to_ch_diff AS DOUBLE), TRY_CAST(from_ch_diff AS DOUBLE) FROM ({PAIRS}) b),
 sizes AS (SELECT project, change, count(*) AS size FROM l GROUP BY 1, 2), c AS (SELECT project, change, x, y, CAST(count(*) AS DOUBLE) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3, 4),
 dis AS (SELECT project, change, sum(a.n * b.n) AS discordant FROM c a JOIN c b USING (project, change) WHERE a.x < b.x AND a.y > b.y GROUP BY 1, 2),
 tx AS (SELECT project, change, sum(t * (t - 1) / 2) AS nx, sum(t * (t - 1) * (2 * t + 5)) AS cx, sum(t * (t - 1) * (t - 2)) AS rx, sum(t) AS n FROM (SELECT project, change, x, sum(n) AS t FROM c GROUP BY 1, 2, 3) i GROUP BY 1, 2),
 ty AS (SELECT project, change, sum(t * (t - 1) / 2) AS ny, sum(t * (t - 1) * (2 * t + 5)) AS cy, sum(t * (t - 1) * (t - 2)) AS ry FROM (SELECT project, change, y, sum(n) AS t FROM c GROUP BY 1, 2, 3) i GROUP BY 1, 2),
 txy AS (SELECT project, change, sum(n * (n - 1) / 2) AS nxy FROM c GROUP BY 1, 2),
 k AS (SELECT project, change, n * (n - 1) / 2 AS total, n * (n - 1) / 2 - nx - ny + nxy - 2 * coalesce(discordant, 0) AS difference, nx, ny,
   (n * (n - 1) * (2 * n + 5) - cx - cy) / 18 + 2 * nx * ny / (n * (n - 1)) + rx * ry / (9 * n * (n - 1) * (n - 2)) AS variance FROM tx JOIN ty USING (project, change) JOIN txy USING (project, change) LEFT JOIN dis USING (project, change)),
 tau AS (SELECT project, change, difference / sqrt(total - nx) / sqrt(total - ny) AS tau, abs(difference) / sqrt(variance) AS z FROM k),
 v AS (SELECT project, change, x AS v, 1 AS one FROM l WHERE x IS NOT NULL UNION ALL SELECT project, change, y, 0 FROM l WHERE y IS NOT NULL), h AS (SELECT project, change, v, sum(one) AS a, count(*) AS t FROM v GROUP BY 1, 2, 3),
 r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY project, change ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mid FROM h),
 u AS (SELECT project, change, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t - a) AS BIGINT) AS n2, CAST(sum(mid * a) AS DOUBLE) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM r GROUP BY 1, 2)
 SELECT project, 't' AS tool, 's' AS strategy, size, change, round_even(tau, 2) AS corr, round_even({tail("z")}, 2) AS corr_p, round_even(u1, 2) AS mwu_u1, round_even(CAST(n1 AS DOUBLE) * n2 - u1, 2) AS mwu_u2,
  round_even({tail("zu")}, 2) AS mwu_p, round_even({DELTA}, 2) AS mwu_d, {SIZE} AS mwu_size FROM sizes JOIN tau USING (project, change) JOIN (SELECT *, {Z_SQL} AS zu FROM u) u1 USING (project, change)"""


@query("pair_correlation", CORRELATED)
def pair_correlation(t):
    pairs = t.sql(PAIRS).withColumns({"tool": F.lit("t"), "strategy": F.lit("s"), "from_ch_all": text.number(F.col("from_ch_all"))})
    return revisions.pair_correlation(pairs, ["ch_all", "ch_diff"])


@query("change_counts", """SELECT user_id AS url, count(*) AS ch_all, count(*) FILTER (WHERE event_id % 3 <> 0 OR event_id % 2 = 0) AS ch_diff, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS ch_body, count(*) FILTER (WHERE event_type = 'click') AS ch_rename, count(*) FILTER (WHERE event_type = 'click') AS ch_multi FROM {events} GROUP BY 1""")
def change_counts(t):
    kind = F.when(F.col("event_type") == "click", "Ymultichange(Ybodychange, Yrename)").when(F.col("event_type") == "error", "Ybodychange").otherwise("Yformatchange")
    rows = t.events.select(
        F.col("user_id").alias("url"), kind.alias("type"), F.when(F.col("event_id") % 3 != 0, "+x").otherwise("").alias("diff"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit(""), F.lit("+y"))).alias("subchange_diffs"),
    )
    return revisions.change_counts(rows).select("url", "ch_all", "ch_diff", "ch_body", "ch_rename", "ch_multi")


@query("call_statistics", f"""WITH m AS (SELECT DISTINCT project, url, first(artifact ORDER BY _ord) OVER (PARTITION BY project, url) AS artifact FROM ({METHODS}) x), e AS (SELECT DISTINCT project, replace(from_url, 't', 'm') AS from_url, to_url FROM ({EDGES}) y),
 k AS (SELECT e.* FROM e JOIN m ON m.project = e.project AND m.url = e.to_url), tests AS (SELECT * FROM m WHERE artifact LIKE '%test-case-method%'),
 c AS (SELECT t.project, t.url, count(k.to_url) AS n FROM tests t LEFT JOIN k ON k.project = t.project AND k.from_url = t.url GROUP BY 1, 2)
 SELECT s.project, s.prod_methods, s.tests, coalesce(x.unique_calls, 0) AS unique_calls, x.median_calls FROM (SELECT project, count(*) FILTER (WHERE artifact LIKE '%main-code%') AS prod_methods, count(*) FILTER (WHERE artifact LIKE '%test-case-method%') AS tests FROM m GROUP BY 1) s
 LEFT JOIN (SELECT project, CAST(sum(n) AS BIGINT) AS unique_calls, CAST(median(n) AS DOUBLE) AS median_calls FROM c GROUP BY 1) x USING (project)""")
def call_statistics(t):
    methods = relational.keep_first(t.sql(METHODS), ["project", "url"])
    edges = t.sql(EDGES).withColumn("from_url", F.replace("from_url", F.lit("t"), F.lit("m")))
    return revisions.call_statistics(methods, edges)


_BY_QUANTITY = f"SELECT * REPLACE (concat(project, CAST(ch_all % 5 AS VARCHAR)) AS project) FROM ({LINES}) l0"


@query("direction_summary", f"""{WITH_TIES.replace(LINES, _BY_QUANTITY)}, x AS ({TESTED}) SELECT d_sign, count(*) AS projects, count(*) FILTER (WHERE mww_p <= 0.05) AS significant,
 {", ".join(f"round_even(count(*) FILTER (WHERE effect_size = '{n}') / count(*)::DOUBLE * 100, 1) AS {n}" for n in ("negligible", "small", "medium", "large"))} FROM x WHERE project <> 'all' AND change = 'diff' GROUP BY 1""")
def direction_summary(t):
    rows = t.sql(LINES).withColumn("project", F.concat("project", (F.col("ch_all") % 5).cast("string")))
    return revisions.direction_summary(revisions.revision_comparison(rows, ["ch_diff"]))


@query("revision_groups", f"SELECT from_url, CASE WHEN TRY_CAST(from_ch_all AS DOUBLE) IS NULL THEN '' WHEN TRY_CAST(from_ch_all AS DOUBLE) <= CAST(to_ch_all AS DOUBLE) THEN 'NTR' WHEN CAST(from_ch_all AS DOUBLE) - CAST(to_ch_all AS DOUBLE) >= 5 THEN 'HTR' ELSE 'ATR' END AS rg_all FROM ({PAIRS}) p")
def revision_groups(t):
    return smells.attach_groups(t.sql(PAIRS), ["ch_all"]).select("from_url", "rg_all")


# ---- smells ---------------------------------------------------------------------------------


@query("smell_summary", f"SELECT url AS from_url, coalesce(string_agg(DISTINCT nullif(trim(smell), ''), ' ' ORDER BY nullif(trim(smell), '')), '') AS smells FROM ({SMELLS}) s GROUP BY 1")
def smell_summary(t):
    return smells.smell_summary(t.sql(SMELLS))


UNIQUE = f"""(SELECT from_url, any_value(rg) AS rg_all, arg_min(project, _ord) AS project, coalesce(string_agg(DISTINCT nullif(s, ''), ' ' ORDER BY nullif(s, '')), '') AS smells FROM
 (SELECT *, CASE WHEN rg_all IN ('AHTR', 'MHTR') THEN 'MTR' ELSE rg_all END AS rg, unnest(string_split(smells, ' ')) AS s FROM ({TESTS}) t) x WHERE rg IN ('NTR', 'ATR', 'HTR') GROUP BY 1 HAVING count(DISTINCT rg) = 1)"""


@query("unique_methods", f"SELECT from_url, rg_all, project, smells FROM {UNIQUE} u")
def unique_methods(t):
    return smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS).select("from_url", "rg_all", "project", "smells")


@query("smell_order", f"SELECT smell, count(*) AS n FROM (SELECT unnest(string_split(smells, ' ')) AS smell FROM ({TESTS}) t) x WHERE smell <> '' GROUP BY 1")
def smell_order(t):
    return smells.smell_order(t.sql(TESTS))


PREVALENCE = f"""WITH u AS (SELECT * FROM {UNIQUE} u), m AS (SELECT rg_all, count(*) AS methods FROM u GROUP BY 1), k AS (SELECT rg_all, unnest(CASE WHEN smells = '' THEN ['none'] ELSE list_concat(['any'], string_split(smells, ' ')) END) AS smell FROM u),
 c AS (SELECT rg_all, smell, count(*) AS n FROM k GROUP BY 1, 2), g AS (SELECT * FROM (SELECT unnest(['NTR', 'ATR', 'HTR']) AS rg_group) a, (SELECT smell FROM c UNION SELECT 'any' UNION SELECT 'none') b)
 SELECT g.rg_group, coalesce(methods, 0) AS methods, g.smell, coalesce(round_even(coalesce(n, 0) / methods::DOUBLE * 100.0::DOUBLE, 2), 0.0) AS percent, coalesce(methods, 0) AS smell_total, coalesce(n, 0) AS smell_n
 FROM g LEFT JOIN m ON m.rg_all = g.rg_group LEFT JOIN c ON c.rg_all = g.rg_group AND c.smell = g.smell"""


@query("prevalence", PREVALENCE)
def prevalence(t):
    return smells.prevalence(t.sql(TESTS), "rg_all")


LOCS = f"SELECT url AS from_url, arg_min(CAST(loc AS BIGINT), _ord) AS loc FROM ({SMELLS}) s WHERE TRY_CAST(loc AS DOUBLE) > 0 GROUP BY 1"
CUTS = f"(SELECT min(loc) FILTER (WHERE up > round_even((al - 1) * 0.7, 0)) AS p70, min(loc) FILTER (WHERE up > round_even((al - 1) * 0.8, 0)) AS p80, min(loc) FILTER (WHERE up > round_even((al - 1) * 0.9, 0)) AS p90 FROM (SELECT loc, sum(count(*)) OVER (ORDER BY loc) AS up, sum(count(*)) OVER () AS al FROM ({LOCS}) l GROUP BY loc) x)"


@query("first_valid_loc", LOCS)
def first_valid_loc(t):
    return smells.first_valid_loc(t.sql(SMELLS))


@query("loc_groups", f"SELECT from_url, loc, CASE WHEN loc <= p70 THEN 'S' WHEN loc <= p80 THEN 'M' WHEN loc <= p90 THEN 'L' ELSE 'XL' END AS loc_group FROM ({LOCS}) l, {CUTS} c")
def loc_groups(t):
    return smells.with_loc_groups(smells.first_valid_loc(t.sql(SMELLS)))


@query("loc_group_table", f"WITH g AS (SELECT loc, CASE WHEN loc <= p70 THEN 'S' WHEN loc <= p80 THEN 'M' WHEN loc <= p90 THEN 'L' ELSE 'XL' END AS loc_group FROM ({LOCS}) l, {CUTS} c), n AS (SELECT unnest(['S', 'M', 'L', 'XL']) AS loc_group) SELECT n.loc_group, count(g.loc) AS methods, min(loc) AS loc_min, max(loc) AS loc_max, round_even(count(g.loc) / sum(count(g.loc)) OVER () * 100.0::DOUBLE, 2) AS percent FROM n LEFT JOIN g USING (loc_group) GROUP BY 1")
def loc_group_table(t):
    return smells.loc_group_table(smells.first_valid_loc(t.sql(SMELLS)))


@query("control_groups", f"SELECT from_url, CASE WHEN loc < 30 THEN 'Small' WHEN loc <= 60 THEN 'Medium' ELSE 'Large' END AS control_group FROM ({LOCS}) l")
def control_groups(t):
    return smells.first_valid_loc(t.sql(SMELLS)).select("from_url", smells.control_group(F.col("loc")).alias("control_group"))


@query("smell_counts", f"SELECT url AS from_url, count(DISTINCT nullif(trim(smell), '')) AS smell_count FROM ({SMELLS}) s GROUP BY 1")
def smell_counts(t):
    return smells.smell_count_frame(t.sql(SMELLS)).select("from_url", "smell_count")


@query("outliers", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM {lineitem} GROUP BY 1) SELECT l.l_returnflag, count(*) FILTER (WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS extreme, count(*) AS n FROM {lineitem} l JOIN q USING (l_returnflag) GROUP BY 1")
def outliers(t):
    return smells.outliers(t.lineitem, "l_extendedprice", ["l_returnflag"])


@query("count_comparison", f"""WITH m AS (SELECT rg_all = 'HTR' AS one, CASE WHEN smells = '' THEN 0 ELSE len(string_split(smells, ' ')) END AS n FROM {UNIQUE} u0 WHERE rg_all IN ('HTR', 'NTR')),
 h AS (SELECT n, count(*) FILTER (WHERE one) AS a, count(*) AS t FROM m GROUP BY 1), r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mid FROM h),
 u AS (SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t - a) AS BIGINT) AS n2, CAST(sum(mid * a) AS DOUBLE) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM r),
 d AS (SELECT (SELECT median(n) FROM m WHERE one) AS g1_median, (SELECT median(n) FROM m WHERE NOT one) AS g2_median),
 x AS (SELECT 'HTR' AS g1, 'NTR' AS g2, n1 AS g1_size, n2 AS g2_size, g1_median, g2_median, round_even(u1, 2) AS mww_u1, round_even(CAST(n1 AS DOUBLE) * n2 - u1, 2) AS mww_u2, round_even({tail("z")}, 2) AS mww_p,
   round_even({DELTA}, 2) AS d_value, CASE WHEN {DELTA} > 0 THEN '+' WHEN {DELTA} < 0 THEN '-' ELSE '=' END AS d_sign, {SIZE} AS effect_size FROM (SELECT *, {Z_SQL} AS z FROM u) z0, d) SELECT *, {MARKS} FROM x""")
def count_comparison(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS)
    return smells.count_comparison(unique, "rg_all", "HTR", "NTR")


@query("paired_prevalence_test", None)
def paired_prevalence_test(t):
    return smells.signed_rank(smells.paired_smells(smells.prevalence(t.sql(TESTS), "rg_all"), "HTR", "NTR"))


@query("association", None)
def association(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    return smells.association(unique, "rg_all", "HTR", "NTR")


ABCD = f"""(WITH u AS (SELECT * FROM {UNIQUE} u WHERE rg_all IN ('HTR', 'NTR')), s AS (SELECT project, count(*) FILTER (WHERE rg_all = 'HTR') AS f, count(*) FILTER (WHERE rg_all = 'NTR') AS g FROM u GROUP BY 1),
 n AS (SELECT DISTINCT unnest(list_concat(['any', 'none'], string_split(smells, ' '))) AS smell FROM u), h AS (SELECT project, rg_all, unnest(CASE WHEN smells = '' THEN ['none'] ELSE list_concat(['any'], string_split(smells, ' ')) END) AS smell FROM u)
 SELECT s.project, n.smell, f, g, count(h.smell) FILTER (WHERE h.rg_all = 'HTR') AS a, count(h.smell) FILTER (WHERE h.rg_all = 'NTR') AS c FROM s CROSS JOIN n LEFT JOIN h ON h.project = s.project AND h.smell = n.smell WHERE n.smell <> '' GROUP BY ALL)"""


@query("association_counts", f"SELECT smell, CAST(sum(g) AS BIGINT) AS baseline_n, CAST(sum(c) AS BIGINT) AS baseline_smell_n, CAST(sum(f) AS BIGINT) AS focal_n, CAST(sum(a) AS BIGINT) AS focal_smell_n, round_even(sum(a) / sum(f)::DOUBLE * 100 - sum(c) / sum(g)::DOUBLE * 100, 2) AS difference_pp FROM {ABCD} x GROUP BY smell")
def association_counts(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    table = smells.association(unique, "rg_all", "HTR", "NTR")
    return table.select("smell", "baseline_n", "baseline_smell_n", "focal_n", "focal_smell_n", "difference_pp")


@query("stratified_odds", f"SELECT smell, round_even(sum(a * (g - c) / (f + g)::DOUBLE) / sum((f - a) * c / (f + g)::DOUBLE), 2) AS mh_odds_ratio FROM {ABCD} x WHERE f > 0 AND g > 0 GROUP BY smell HAVING sum((f - a) * c) > 0")
def stratified_odds(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    table = smells.association(unique, "rg_all", "HTR", "NTR")
    return table.where(~F.isnan("mh_odds_ratio") & (F.col("mh_odds_ratio") != float("inf"))).select("smell", "mh_odds_ratio")


@query("size_controlled_association", None)
def size_controlled_association(t):
    unique = smells.comparison_methods(t.sql(TESTS), "rg_all", "HTR", "NTR")
    controls = smells.first_valid_loc(t.sql(SMELLS)).select("from_url", smells.control_group(F.col("loc")).alias("control_group"))
    return smells.size_controlled(unique, controls, "rg_all", "HTR", "NTR", ["error", "click"])


@query("size_correlations", None)
def size_correlations(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS)
    return smells.size_correlations(unique.join(smells.first_valid_loc(t.sql(SMELLS)), "from_url"), ["error", "click"])


@query("smell_differences", f"WITH u AS (SELECT * FROM {UNIQUE} u WHERE rg_all IN ('HTR', 'NTR')), s AS (SELECT count(*) FILTER (WHERE rg_all = 'HTR') AS f, count(*) FILTER (WHERE rg_all = 'NTR') AS g FROM u), k AS (SELECT rg_all, unnest(string_split(smells, ' ')) AS smell FROM u WHERE smells <> '') SELECT smell, round_even(round_even(count(*) FILTER (WHERE rg_all = 'HTR') / f::DOUBLE * 100.0::DOUBLE, 2) - round_even(count(*) FILTER (WHERE rg_all = 'NTR') / g::DOUBLE * 100.0::DOUBLE, 2), 2) AS difference FROM k, s GROUP BY smell, f, g")
def smell_differences(t):
    unique = smells.unique_methods(t.sql(TESTS), "rg_all", smells.GROUPS).where(F.col("rg_all").isin("HTR", "NTR"))
    return smells.smell_differences(unique, "rg_all", "HTR", "NTR")


@query("adjusted_p", """WITH p AS (SELECT p_partkey AS id, p_brand AS grp, (p_partkey * 37 % 1009) / 1009.0::DOUBLE AS p FROM {part}), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p)
 SELECT id, round(least(min(p * n / k) OVER (PARTITION BY grp ORDER BY k DESC), 1.0), 9) AS adjusted FROM r""")
def adjusted_p(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), ((F.col("p_partkey") * 37 % 1009) / 1009.0).alias("p"))
    return smells.adjust(rows, "p", "adjusted", ["grp"], ["id"]).select("id", F.round("adjusted", 9).alias("adjusted"))


@query("wilson_intervals", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS k, count(*) AS n FROM {events} GROUP BY 1) SELECT user_id, round((k / n::DOUBLE + z * z / (2 * n) - z * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS low, round((k / n::DOUBLE + z * z / (2 * n) + z * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS high FROM c, (SELECT 1.959963984540054::DOUBLE AS z) z""")
def wilson_intervals(t):
    c = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = statistics.wilson_low_high(F.col("k"), F.col("n"))
    return c.select("user_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("fisher_tests", None)
def fisher_tests(t):
    c = t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(e) for e in ("error", "click", "view", "signup")])
    return c.select("user_id", statistics.fisher_column(*[F.col(e) for e in ("error", "click", "view", "signup")]).alias("x")).select("user_id", "x.*")


# ---- agreement and review -------------------------------------------------------------------


@query("cohen_kappa", """SELECT grp, n, CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 END ELSE round((po - pe) / (1 - pe), 9) END AS kappa FROM (SELECT grp, n, (n - l - r + 2 * b) / n::DOUBLE AS po, (l / n::DOUBLE) * (r / n::DOUBLE) + (1 - l / n::DOUBLE) * (1 - r / n::DOUBLE) AS pe
 FROM (SELECT doc_id % 4 AS grp, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS l, count(*) FILTER (WHERE toxic = 1) AS r, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS b FROM {labels} GROUP BY 1) x) y""")
def cohen_kappa(t):
    rows = t.labels.withColumn("grp", F.col("doc_id") % 4)
    return agreement.cohen_kappa(rows, "quality", "toxic", ["grp"]).withColumn("kappa", F.round("kappa", 9))


@query("agreement_summary", """WITH p AS (SELECT doc_id, quality, toxic, quality IS NOT NULL AND (quality = 1 OR toxic = 0) AS a, toxic IS NOT NULL AND (toxic = 1 OR quality = 1) AS b FROM {labels}),
 c AS (SELECT concat('p', CAST(doc_id % 3 AS VARCHAR)) AS project, CASE WHEN a THEN quality END AS l, CASE WHEN b THEN toxic END AS r, a, b FROM p WHERE a OR b),
 s AS (SELECT coalesce(project, 'total') AS project, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT b) AS only_left, count(*) FILTER (WHERE NOT a) AS only_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS labelled, count(*) FILTER (WHERE l = r) AS agreed,
   count(*) FILTER (WHERE r IS NOT NULL AND l = 1)::DOUBLE AS l1, count(*) FILTER (WHERE l IS NOT NULL AND r = 1)::DOUBLE AS r1 FROM c GROUP BY GROUPING SETS ((project), ())),
 k AS (SELECT *, agreed / labelled::DOUBLE AS observed, l1 / labelled * (r1 / labelled) + (labelled - l1) / labelled * ((labelled - r1) / labelled) AS expected FROM s)
 SELECT project, "both", only_left, only_right, labelled, agreed, CASE WHEN labelled > 0 THEN round_even(agreed / labelled::DOUBLE * 100.0::DOUBLE, 2) ELSE 0.0 END AS agreement,
   round(CASE WHEN labelled > 0 THEN CASE WHEN expected = 1 THEN CASE WHEN observed = 1 THEN 1.0 END ELSE (observed - expected) / (1 - expected) END END, 9) AS kappa FROM k""")
def agreement_summary(t):
    """Two raters: one calls a document good or harmless, the other toxic or good; each leaves some out."""
    key = F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("project")
    ends = [F.col("doc_id").cast("string").alias("from_url"), F.lit("x").alias("to_url")]
    a = t.labels.where("quality IS NOT NULL AND (quality = 1 OR toxic = 0)").select(key, *ends, F.col("quality").alias("label"))
    b = t.labels.where("toxic IS NOT NULL AND (toxic = 1 OR quality = 1)").select(key, *ends, F.col("toxic").alias("label"))
    return agreement.agreement_summary(agreement.compare_labels(a, b)).withColumn("kappa", F.round("kappa", 9))


@query("truth_statistics", f"""WITH r AS (SELECT project, from_url, to_url, _ord % 2 = 0 AND _ord % 5 <> 0 AS ok, score > 0.05 AS hit FROM ({EDGES}) e), t AS (SELECT project, from_url, count(DISTINCT to_url) FILTER (WHERE ok) AS n, count(DISTINCT to_url) FILTER (WHERE ok AND hit) AS pos FROM r GROUP BY 1, 2)
 SELECT project, count(*) AS tests, CAST(sum(n) AS BIGINT) AS pairs, CAST(median(n) AS DOUBLE) AS median_pairs, CAST(sum(pos) AS BIGINT) AS positive_links FROM t GROUP BY 1""")
def truth_statistics(t):
    rows = t.sql(EDGES).select("project", "from_url", "to_url", (F.col("_ord") % 2 == 0).cast("int").alias("candidate"), F.when(F.col("_ord") % 5 == 0, "#a #skip").otherwise("#a").alias("tags"), (F.col("score") > 0.05).cast("int").alias("label"))
    return agreement.truth_statistics(rows, ["#skip"])


@query("test_progress", f"SELECT from_url, count(*) AS total, count(*) FILTER (WHERE _ord % 3 <> 0) AS labelled, count(*) FILTER (WHERE _ord % 3 = 1) AS true_links FROM ({EDGES}) e GROUP BY 1")
def test_progress(t):
    label = F.element_at(F.array(F.lit(""), F.lit("1"), F.lit("0")), (F.col("_ord") % 3 + 1).cast("int"))
    rows = t.sql(EDGES).select("from_url", "_ord", label.alias("label"), F.lit("1").alias("candidate"), F.lit("a,#b").alias("tags"), F.lit("").alias("notes"))
    return review.test_progress(rows).select("from_url", "total", "labelled", "true_links")


@query("project_progress", f"SELECT project, CAST(sum(n) AS BIGINT) AS rows, count(*) AS tests, count(*) FILTER (WHERE n = d) AS complete_tests FROM (SELECT project, from_url, count(*) AS n, count(*) FILTER (WHERE _ord % 3 <> 0) AS d FROM ({EDGES}) e GROUP BY 1, 2) x GROUP BY 1")
def project_progress(t):
    rows = t.sql(EDGES).select("project", "from_url", F.when(F.col("_ord") % 3 != 0, "1").otherwise("").alias("label"))
    return review.project_progress(rows)


@query("timelines", """SELECT commit, a.ts AS ts_left, b.ts AS ts_right, greatest(coalesce(a.ts, b.ts), coalesce(b.ts, a.ts)) AS ts FROM (SELECT event_id AS commit, ts FROM {events} WHERE event_type <> 'error') a FULL JOIN (SELECT event_id AS commit, ts FROM {events} WHERE event_type <> 'view') b USING (commit)""")
def timelines(t):
    rows = t.events.select(F.col("event_id").alias("commit"), "ts", F.col("event_id").alias("place"), "user_id", "event_type")
    a, b = rows.where("event_type <> 'error'"), rows.where("event_type <> 'view'")
    return review.timeline(a, b).select("commit", "ts_left", "ts_right", "ts")


@query("pair_summaries", """WITH a AS (SELECT DISTINCT user_id % 20 AS g, event_id % 50 AS c FROM {events} WHERE user_id < 75), b AS (SELECT DISTINCT user_id % 20 AS g, event_id % 50 AS c FROM {events} WHERE user_id >= 75)
 SELECT coalesce(a.g, b.g) AS g, count(*) FILTER (WHERE a.g IS NOT NULL AND b.g IS NOT NULL) AS shared, count(*) FILTER (WHERE b.g IS NULL) AS left_only, count(*) FILTER (WHERE a.g IS NULL) AS right_only FROM a FULL JOIN b ON a.g = b.g AND a.c = b.c GROUP BY 1""")
def pair_summaries(t):
    rows = t.events.select((F.col("user_id") % 20).alias("g"), (F.col("event_id") % 50).alias("commit"), "ts", "user_id")
    out = review.pair_summary(rows.where("user_id < 75"), rows.where("user_id >= 75"), ["g"])
    return out.select("g", "shared", "left_only", "right_only")


@query("path_matches", """WITH k AS (SELECT concat('src/a', CAST(p_partkey % 7 AS VARCHAR), '/F', CAST(p_partkey AS VARCHAR), '.java') AS file FROM {part}), f AS (SELECT event_id, concat('/home/x/src/a', CAST(event_id % 5 AS VARCHAR), '/F', CAST(event_id % 300 AS VARCHAR), '.java') AS path FROM {events})
 SELECT event_id, max(k.file) AS file FROM f LEFT JOIN k ON ends_with(f.path, '/' || k.file) GROUP BY 1""")
def path_matches(t):
    known = t.part.select(F.concat(F.lit("src/a"), (F.col("p_partkey") % 7).cast("string"), F.lit("/F"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file"))
    found = t.events.select("event_id", F.concat(F.lit("/home/x/src/a"), (F.col("event_id") % 5).cast("string"), F.lit("/F"), (F.col("event_id") % 300).cast("string"), F.lit(".java")).alias("path"))
    return smell_bridge.match_paths(found, known).select("event_id", "file")


@query("introductions", """SELECT user_id, event_id AS commit FROM (SELECT *, event_type = 'signup' AS hit FROM {events}) e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN event_id ELSE -event_id END) = 1""")
def introductions(t):
    rows = t.events.select("user_id", F.col("event_id").alias("commit"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "signup", "Yintroduced").otherwise("Ybodychange").alias("type"))
    return smell_bridge.introduction(rows, ["user_id"]).select("user_id", "commit")


@query("production_files", """WITH p AS (SELECT concat('f', CAST(o_custkey % 90 AS VARCHAR)) AS test_file, concat('n', CAST(o_custkey % 90 AS VARCHAR), 'x') AS c, concat('g', CAST(o_orderkey % 400 AS VARCHAR)) AS to_file, concat('n', CAST(o_orderkey % 400 AS VARCHAR), 'y') AS d FROM {orders})
 SELECT test_file, to_file FROM p QUALIFY row_number() OVER (PARTITION BY test_file ORDER BY c = d DESC, 1.0 - levenshtein(c, d) / greatest(length(c), length(d))::DOUBLE DESC, to_file) = 1""")
def production_files(t):
    n = lambda c, m, s: F.concat(F.lit("n"), (F.col(c) % m).cast("string"), F.lit(s))
    rows = t.orders.select(F.concat(F.lit("f"), (F.col("o_custkey") % 90).cast("string")).alias("test_file"), n("o_custkey", 90, "xTest").alias("test_class"), F.concat(F.lit("g"), (F.col("o_orderkey") % 400).cast("string")).alias("to_file"), n("o_orderkey", 400, "y").alias("to_class"))
    return smell_bridge.pick_production_file(rows).select("test_file", "to_file")


@query("best_confidence", """SELECT user_id AS case_id, event_type AS method, value AS confidence, event_id AS _ord FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) = 1""")
def best_confidence(t):
    rows = t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("method"), F.col("value").alias("confidence"), F.col("event_id").alias("_ord"))
    return signatures.best_confidence(rows)


@query("label_lookup", f"SELECT from_url, list_sort(list(DISTINCT to_url)) AS urls FROM ({TRUTH}) g GROUP BY 1")
def label_lookup(t):
    rows = t.sql(TRUTH).select("from_url", "to_url", F.lit(1).alias("label"), F.col("to_url").alias("to_fqs"), F.lit(0).alias("_ord"))
    return signatures.label_lookup(rows).select("from_url", "urls")


@query("call_targets", """WITH c AS (SELECT l_orderkey % 500 AS call_id, l_partkey, l_linenumber AS level, l_suppkey, l_extendedprice AS o FROM {lineitem})
 SELECT call_id, l_partkey FROM c WHERE l_suppkey % 3 = 1 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY level, CASE WHEN l_partkey % 2 = 0 THEN 350 ELSE 50 END DESC, o) = 1""")
def call_targets(t):
    c = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("call_id"), "l_partkey", F.lit(1).alias("direction"), F.col("l_linenumber").alias("level"), F.col("l_extendedprice").alias("_ord"),
        (F.col("l_suppkey") % 3).alias("c_arity"), F.lit(1).alias("e_arity"), F.lit("a").alias("e_fqn"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b").alias("c_fqn"),
        F.lit("x").alias("c_file"), F.lit("y").alias("e_file"), F.lit("f(").alias("c_fqs"), F.lit("g(").alias("e_fqs"),
    )
    return graph.best_call_target(c).select("call_id", "l_partkey")


@query("attach_smells", f"SELECT DISTINCT from_url, coalesce(s.smells, '') AS smells FROM ({EDGES}) e LEFT JOIN (SELECT url AS from_url, coalesce(string_agg(DISTINCT nullif(trim(smell), ''), ' ' ORDER BY nullif(trim(smell), '')), '') AS smells FROM ({SMELLS}) s GROUP BY 1) s USING (from_url)")
def attach_smells(t):
    return smells.attach_smells(t.sql(EDGES).select("from_url").distinct(), t.sql(SMELLS))


@query("attach_revisions", f"SELECT e.from_url, e.to_url, e._ord, 'h' AS tool, a.ch_all AS from_ch_all, b.ch_all AS to_ch_all FROM (SELECT *, replace(from_url, 't', 'm') AS f FROM ({EDGES}) e) e JOIN (SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS url, p_size AS ch_all FROM {{part}}) a ON a.url = e.f JOIN (SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS url, p_size AS ch_all FROM {{part}}) b ON b.url = e.to_url".replace("{{part}}", "{part}"))
def attach_revisions(t):
    history = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_size").alias("ch_all"))
    links = t.sql(EDGES).select(F.replace("from_url", F.lit("t"), F.lit("m")).alias("from_url"), "to_url", "_ord")
    out = relational.attach_revisions(links, history, ["ch_all"], "h")
    return out.withColumn("from_url", F.replace("from_url", F.lit("m"), F.lit("t")))


@query("select_change_columns", f"SELECT from_url, from_ch_all, to_ch_all FROM ({PAIRS}) p")
def select_change_columns(t):
    rows = t.sql(PAIRS)
    names = filters.complete_changes(rows, ["ch_all", "ch_move"])
    return rows.select("from_url", *[f"{s}_{c}" for c in names for s in ("from", "to")])
