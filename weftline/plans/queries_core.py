"""Registered queries: tags, scalar functions, filters, joins, windows, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import dates, strings, tags, text
from weftline.operators import classification, filters, graph, ingest, relational, revisions, sampling
from weftline.plans.registry import query
from weftline.plans.relations import COMMITS, EDGES, METHODS, PAIRS, SMELLS, TRUTH

TAG_LIST = "list_distinct(list_filter(regexp_split_to_array(coalesce(artifact, ''), '[\\s#]+'), lambda t: t <> ''))"
ORDERED = "['test-module','doc-module','test-code','main-code','test-case-method','test-fixture-method','test-helper-method','test-resource','main-resource','test-code-generated','main-code-generated']"
ROLE = f"""CASE WHEN list_contains({TAG_LIST}, 'test-case-method') THEN 'test-case-method' WHEN list_contains({TAG_LIST}, 'test-fixture-method') THEN 'test-fixture-method'
 WHEN list_contains({TAG_LIST}, 'test-helper-method') THEN 'test-helper-method' WHEN list_contains({TAG_LIST}, 'test-code') THEN 'test-code'
 WHEN list_contains({TAG_LIST}, 'main-code') THEN 'main-code' ELSE 'unknown' END"""


@query(
    "tags_roles",
    f"""SELECT url, _ord, array_to_string(list_transform(list_filter({ORDERED}, lambda t: list_contains({TAG_LIST}, t)), lambda t: '#' || t), ' ') AS encoded,
 {ROLE} AS role, list_contains({TAG_LIST}, 'main-code') AND len(list_filter({TAG_LIST}, lambda t: t LIKE 'test-%' OR t LIKE 'doc-%')) = 0 AS production,
 CASE WHEN list_contains({TAG_LIST}, 'test-case-method') THEN 'test-case-method' WHEN list_contains({TAG_LIST}, 'main-code') THEN 'main-code' END AS method_kind
 FROM ({METHODS}) m""",
)
def tags_roles(t):
    a = F.col("artifact")
    return t.sql(METHODS).select(
        "url", "_ord", tags.encode_tags(tags.split_tags(a)).alias("encoded"), tags.artifact_role(a).alias("role"),
        tags.is_production(a).alias("production"), tags.method_kind(a).alias("method_kind"),
    )


@query("filter_by_artifact", f"SELECT url, _ord FROM ({METHODS}) m WHERE list_contains({TAG_LIST}, 'test-helper-method') OR list_contains({TAG_LIST}, 'doc-module')")
def filter_by_artifact(t):
    return filters.by_artifact(t.sql(METHODS), ("test-helper-method", "doc-module")).select("url", "_ord")


@query("concrete_methods", f"SELECT project, url, _ord FROM ({METHODS}) m WHERE TRY_CAST(abstract AS DOUBLE) = 0")
def concrete_methods(t):
    return filters.concrete(t.sql(METHODS)).select("project", "url", "_ord")


@query(
    "invalid_abstract_counts",
    f"""SELECT project, count(*) FILTER (WHERE coalesce(TRY_CAST(abstract AS DOUBLE) NOT IN (0, 1), true)) AS invalid, count(*) AS rows
 FROM ({METHODS}) m GROUP BY project HAVING count(*) FILTER (WHERE coalesce(TRY_CAST(abstract AS DOUBLE) NOT IN (0, 1), true)) > 0""",
)
def invalid_abstract_counts(t):
    return filters.invalid_abstract(t.sql(METHODS))


@query(
    "base_population",
    f"""SELECT url, _ord, kind AS method_kind FROM (SELECT *, CASE WHEN list_contains({TAG_LIST}, 'test-case-method') THEN 'test-case-method'
 WHEN list_contains({TAG_LIST}, 'main-code') THEN 'main-code' END AS kind FROM ({METHODS}) m WHERE TRY_CAST(abstract AS DOUBLE) = 0) x WHERE kind IS NOT NULL""",
)
def base_population(t):
    return filters.base_population(t.sql(METHODS)).select("url", "_ord", "method_kind")


@query("numbers_in_text", f"""SELECT _ord, TRY_CAST(abstract AS DOUBLE) AS number, CASE WHEN TRY_CAST(abstract AS DOUBLE) = floor(TRY_CAST(abstract AS DOUBLE)) THEN CAST(CAST(TRY_CAST(abstract AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE abstract END AS normal,
 CASE WHEN TRY_CAST(start_line AS DOUBLE) >= 1 THEN CAST(floor(TRY_CAST(start_line AS DOUBLE)) AS BIGINT) END AS loc, CAST(CAST(end_line AS BIGINT) - CAST(start_line AS BIGINT) + 1 AS VARCHAR) AS lines FROM ({METHODS}) m""")
def numbers_in_text(t):
    c = F.col
    return t.sql(METHODS).select(
        "_ord", text.number(c("abstract")).alias("number"), text.normal_integer(c("abstract")).alias("normal"),
        text.valid_loc(c("start_line")).alias("loc"), text.method_loc(c("start_line"), c("end_line")).alias("lines"),
    )


@query("round_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * l_discount / 7, 2) AS r FROM {lineitem}")
def round_half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.round_even(F.col("l_extendedprice") * F.col("l_discount") / 7).alias("r"))


CODE = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'getSize' ELSE 'setSize' END AS name, '1' AS start_line, CAST(2 + p_partkey % 5 AS STRING) AS end_line,
 CASE p_partkey % 6 WHEN 0 THEN 'public int getSize() {{ return 1; }}' WHEN 1 THEN 'void setSize(int a) {{ this.a = a; }}' WHEN 2 THEN 'abstract int getSize();'
 WHEN 3 THEN '' WHEN 4 THEN 'public static void getSize(int a, int b) {{ x(); }}' ELSE '@A(1) protected final void setSize(List<A> a) {{}}' END AS code FROM {part}"""


@query(
    "trivial_code",
    f"""SELECT id, code = '' OR (code LIKE '%;' AND code NOT LIKE '%{{{{%') OR NOT (code LIKE '%{{{{%' AND code LIKE '%}}}}%') AS empty_code,
 (CAST(end_line AS INT) < 5) AND id % 6 IN (0, 1, 2, 5) AS accessor,
 CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 1 END AS parameters,
 CASE id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'void' WHEN 2 THEN 'int' WHEN 4 THEN 'void' WHEN 5 THEN 'void' END AS kind FROM ({CODE}) c""",
)
def trivial_code(t):
    rows = t.sql(CODE)
    n, s, e, c = (F.col(x) for x in ("name", "start_line", "end_line", "code"))
    return rows.select(
        "id", text.is_empty_code(c).alias("empty_code"), text.is_short_accessor(n, s, e, c).alias("accessor"),
        text.parameter_count(c, n).alias("parameters"), text.return_type(c, n).alias("kind"),
    )


URLS = "SELECT o_orderkey AS id, concat('https://github.com/acme/tool/blob/', md5(CAST(o_orderkey AS STRING)), '/src/a%20b/File', CAST(o_custkey AS STRING), '.java#L', CAST(o_orderkey % 900 AS STRING)) AS url FROM {orders}"


@query(
    "url_parts",
    f"""SELECT id, CAST(id % 900 AS VARCHAR) AS line, regexp_extract(url, '/blob/[^/]+/([^#?]*)', 1) AS path, md5(CAST(id AS VARCHAR)) AS commit,
 'tool' AS project, replace(regexp_extract(url, '/blob/[^/]+/([^#?]*)', 1), '%20', ' ') AS file FROM ({URLS}) u""",
)
def url_parts(t):
    u = F.col("url")
    parsed = text.parse_method_url(u)
    return t.sql(URLS).select(
        "id", text.url_line(u).alias("line"), text.url_path(u).alias("path"), text.url_commit(u).alias("commit"),
        parsed["project"].alias("project"), parsed["path"].alias("file"),
    )


@query(
    "page_urls",
    """SELECT page_id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') AS repository, regexp_extract(url, '#L(\\d+)', 1) AS line FROM {pages}""",
)
def page_urls(t):
    return t.pages.select("page_id", text.repository_url(F.col("url")).alias("repository"), text.url_line(F.col("url")).alias("line"))


@query(
    "history_names",
    """SELECT o_orderkey AS id, concat('src/F', CAST(o_custkey AS VARCHAR), '--run--', CAST(o_orderkey AS VARCHAR), '.json') AS suffix,
 concat('https://h/r/blob/abc/src/F', CAST(o_custkey AS VARCHAR), '.java#L', CAST(o_orderkey AS VARCHAR)) AS url FROM {orders}""",
)
def history_names(t):
    file = F.concat(F.lit("src/F"), F.col("o_custkey").cast("string"), F.lit(".java"))
    suffix = text.history_suffix(file, F.lit("run"), F.col("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), suffix.alias("suffix"), text.history_file_url(F.lit("https://h/r"), F.lit("abc"), suffix).alias("url"))


@query("smell_ranges", """SELECT event_id, CAST(least(event_id % 7, user_id) AS BIGINT) AS low, CAST(greatest(event_id % 7, user_id) AS BIGINT) AS high FROM {events}""")
def smell_ranges(t):
    begin = F.concat(F.lit("99, "), (F.col("event_id") % 7).cast("string"))
    end = F.col("user_id").cast("string")
    span = text.smell_range(begin, end, F.lit(1))
    return t.events.select("event_id", span["first"].alias("low"), span["last"].alias("high"))


@query("signatures", """SELECT p_partkey AS id, 'make' AS name, concat('a.B.make(Map<String, int[]>,', p_brand, '...)') AS compact, concat('a.B.make(Map,', p_brand, '[])') AS linker, 2 AS n FROM {part}""")
def signatures(t):
    s = F.concat(F.lit("a.B.make(Map<String, int[]>,"), F.col("p_brand"), F.lit("...)"))
    return t.part.select(
        F.col("p_partkey").alias("id"), text.invocation_name(s).alias("name"), text.compact_signature(s).alias("compact"),
        text.linker_signature(s).alias("linker"), F.size(text.parameter_list(s)).alias("n"),
    )


@query("diff_lines", """SELECT event_id, 2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM {events}""")
def diff_lines(t):
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n x\n-y\n+z\n"), F.when(F.col("event_id") % 2 == 0, "+w").otherwise("-w"))
    return t.events.select("event_id", text.new_side_lines(diff).alias("n"))


@query("stable_shards", """SELECT o_orderkey AS id, CAST(list_reduce(list_transform(string_split(sha1(CAST(o_orderkey AS VARCHAR)), ''), lambda d: CAST(strpos('0123456789abcdef', d) - 1 AS BIGINT)), lambda r, d: (r * 16 + d) % 7, 0::BIGINT) + 1 AS INTEGER) AS shard FROM {orders}""")
def stable_shards(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), text.stable_shard(F.col("o_orderkey").cast("string"), 7).alias("shard"))


@query(
    "commit_dates",
    """SELECT o_orderkey AS id, 'dmy' AS date_order, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 75 MINUTE AS parsed FROM {orders}""",
)
def commit_dates(t):
    value = F.date_format("o_orderdate", "dd/MM/yyyy, '01:15 AM'")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), dates.date_order(value).alias("date_order"), dates.parse_commit_date(value).cast("timestamp_ntz").alias("parsed")
    )


@query("name_similarity", """SELECT p_partkey AS id, CASE WHEN greatest(length(p_name), length(p_type)) > 0 THEN 1.0 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE) ELSE 0.0 END AS sim FROM {part}""")
def name_similarity(t):
    return t.part.select(F.col("p_partkey").alias("id"), strings.similarity(F.col("p_name"), F.col("p_type")).alias("sim"))


@query(
    "longest_common",
    """WITH RECURSIVE p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM {part}),
 d AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM p
 UNION ALL SELECT a, b, i + 1, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
   lambda k: CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN r[k] + 1 ELSE r[k + 1] END)))) FROM d WHERE i < len(a)),
 s AS (SELECT a, b, max(l) AS n FROM p, range(1, 40) x(i), range(0, 40) y(l) WHERE x.i + y.l <= len(a) + 1 AND contains(b, substr(a, x.i, y.l)) GROUP BY 1, 2)
 SELECT p_partkey, CAST(d.r[len(d.b) + 1] AS INTEGER) AS lcs, CAST(s.n AS INTEGER) AS substring FROM {part} JOIN d ON d.a = p_name AND d.b = lower(p_type) AND d.i = len(d.a) JOIN s ON s.a = p_name AND s.b = lower(p_type)""",
)
def longest_common(t):
    return t.part.select("p_partkey", strings.lcs(F.col("p_name"), F.lower("p_type")).alias("lcs"), strings.common_substring(F.col("p_name"), F.lower("p_type")).alias("substring"))


# ---- joins and sets -------------------------------------------------------------------------

FIRST_METHOD = f"(SELECT * FROM ({METHODS}) m QUALIFY row_number() OVER (PARTITION BY url ORDER BY _ord) = 1)"


@query("keep_first_last", f"SELECT f.url, f._ord AS first_ord, l._ord AS last_ord FROM {FIRST_METHOD} f JOIN (SELECT * FROM ({METHODS}) m QUALIFY row_number() OVER (PARTITION BY url ORDER BY _ord DESC) = 1) l USING (url)")
def keep_first_last(t):
    m = t.sql(METHODS)
    a = relational.keep_first(m, ["url"]).select("url", F.col("_ord").alias("first_ord"))
    return a.join(relational.keep_last(m, ["url"]).select("url", F.col("_ord").alias("last_ord")), "url")


@query(
    "attach_both_ends",
    f"""SELECT e.from_url, e.to_url, e._ord, a.price AS from_price, b.price AS to_price FROM (SELECT *, concat('m', substr(from_url, 2)) AS f FROM ({EDGES}) e) e
 JOIN {FIRST_METHOD} a ON a.url = e.f JOIN {FIRST_METHOD} b ON b.url = e.to_url""",
)
def attach_both_ends(t):
    m = relational.keep_first(t.sql(METHODS), ["url"]).select("url", "price")
    e = t.sql(EDGES).select(F.col("from_url").alias("own"), F.concat(F.lit("m"), F.expr("substr(from_url, 2)")).alias("from_url"), "to_url", "_ord")
    return relational.attach_both(e, m).select(F.col("own").alias("from_url"), "to_url", "_ord", "from_price", "to_price")


@query("semi_join_truth", f"SELECT from_url, to_url, _ord FROM ({EDGES}) e WHERE from_url IN (SELECT from_url FROM ({TRUTH}) g)")
def semi_join_truth(t):
    return filters.only_with(t.sql(EDGES), t.sql(TRUTH)).select("from_url", "to_url", "_ord")


@query("lookup_last", f"SELECT DISTINCT g.from_url, g.to_url, coalesce(e.score, -1.0) AS score FROM ({TRUTH}) g LEFT JOIN (SELECT * FROM ({EDGES}) e QUALIFY row_number() OVER (PARTITION BY from_url, to_url ORDER BY _ord DESC) = 1) e USING (from_url, to_url)")
def lookup_last(t):
    return relational.lookup(t.sql(TRUTH).select("from_url", "to_url").distinct(), t.sql(EDGES), ["from_url", "to_url"], "score", -1.0, last=True)


@query(
    "compare_full_outer",
    """SELECT coalesce(a.k, b.k) AS k, a.v AS v_left, b.v AS v_right, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side
 FROM (SELECT doc_id AS k, quality AS v FROM {labels} WHERE toxic = 0) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM {labels} WHERE quality = 0 OR toxic = 1) b ON a.k = b.k""",
)
def compare_full_outer(t):
    a = t.labels.where("toxic = 0").select(F.col("doc_id").alias("k"), F.col("quality").alias("v"))
    b = t.labels.where("quality = 0 OR toxic = 1").select(F.col("doc_id").alias("k"), F.col("toxic").alias("v"))
    return relational.compare_full(a, b, ["k"], "v")


@query("membership_flag", f"SELECT from_url, to_url, _ord, CASE WHEN (from_url, to_url) IN (SELECT from_url, to_url FROM ({TRUTH}) g) THEN 1 ELSE 0 END AS candidate FROM ({EDGES}) e")
def membership_flag(t):
    return relational.is_member(t.sql(EDGES), t.sql(TRUTH), ["from_url", "to_url"], "candidate").select("from_url", "to_url", "_ord", "candidate")


@query("carry_labels", """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS label FROM {documents} d LEFT JOIN {labels} l USING (doc_id)""")
def carry_labels(t):
    base = t.documents.select("doc_id", F.lit("").alias("label"))
    old = t.labels.select("doc_id", F.col("quality").cast("string").alias("label"), F.col("doc_id").alias("_ord"))
    return relational.carry_values(base, old, ["doc_id"], ["label"])


@query("append_missing", """SELECT doc_id FROM {labels} UNION ALL SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})""")
def append_missing(t):
    return relational.append_missing(t.labels.select("doc_id"), t.documents.select("doc_id"), ["doc_id"])


@query("first_source", f"""SELECT to_url, source, count(*) AS n FROM (SELECT *, min(r) OVER (PARTITION BY to_url) AS best FROM (SELECT to_url, 'truth' AS source, 0 AS r FROM ({TRUTH}) g UNION ALL SELECT to_url, 'edges', 1 FROM ({EDGES}) e) u) x WHERE r = best GROUP BY to_url, source""")
def first_source(t):
    rows = relational.first_source([("truth", t.sql(TRUTH)), ("edges", t.sql(EDGES))], ["to_url"])
    return rows.groupBy("to_url", "source").agg(F.count(F.lit(1)).alias("n"))


@query("gaps_and_islands", """SELECT user_id, min(k) AS first, max(k) AS last, count(*) AS size FROM (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS i FROM (SELECT DISTINCT user_id, event_id // 40 AS k FROM {events}) d) x GROUP BY user_id, i""")
def gaps_and_islands(t):
    rows = t.events.select("user_id", F.floor(F.col("event_id") / 40).cast("long").alias("k"))
    return relational.group_ranges(rows, "k", ["user_id"])


@query("join_any_case", """SELECT r_regionkey, n FROM {region} r JOIN (SELECT lower(concat('  ', 'x')) AS z, 1 AS n) o ON true""")
def join_any_case(t):
    names = t.region.select(F.lower("r_name").alias("r_name"), F.lit(1).alias("n"))
    return relational.join_lower(t.region, names, "r_name").select("r_regionkey", "n")


@query("qualifying_pairs", f"""SELECT from_url FROM ({PAIRS}) p WHERE coalesce(TRY_CAST(from_ch_all AS DOUBLE) - TRY_CAST(to_ch_all AS DOUBLE) >= 5, false) OR coalesce(TRY_CAST(from_ch_diff AS DOUBLE) - TRY_CAST(to_ch_diff AS DOUBLE) >= 5, false)""")
def qualifying_pairs(t):
    return filters.qualifying_pairs(t.sql(PAIRS), ["ch_all", "ch_diff"], 5).select("from_url")


@query("large_groups", """SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT c_nationkey FROM {customer} GROUP BY 1 HAVING count(*) >= 60)""")
def large_groups(t):
    return filters.large_groups(t.customer, "c_nationkey", 60).select("c_custkey")


@query("search_methods", f"SELECT url, name, _ord FROM ({METHODS}) m WHERE lower(name) LIKE '%ring%' ORDER BY _ord LIMIT 25")
def search_methods(t):
    return filters.search(t.sql(METHODS), " Ring ", ["name"]).select("url", "name", "_ord")


@query("slice_projects", "SELECT n_nationkey FROM {nation} WHERE n_nationkey % 3 = 1 AND n_nationkey < 20")
def slice_projects(t):
    rows = t.nation.withColumn("_ord", F.col("n_nationkey"))
    return filters.slice_projects(rows, 1, 20, 3).select("n_nationkey")


# ---- graph ----------------------------------------------------------------------------------


@query("degree_counts", f"""SELECT url, coalesce(a.n, 0) AS fan_out, coalesce(b.n, 0) AS fan_in FROM (SELECT concat('t', substr(from_url, 2)) AS url, count(*) AS n FROM ({EDGES}) e GROUP BY 1) a
 FULL JOIN (SELECT concat('t', substr(to_url, 2)) AS url, count(*) AS n FROM ({EDGES}) e GROUP BY 1) b USING (url)""")
def degree_counts(t):
    edges = t.sql(EDGES).withColumn("to_url", F.concat(F.lit("t"), F.expr("substr(to_url, 2)")))
    nodes = edges.select(F.col("from_url").alias("url")).union(edges.select("to_url")).distinct()
    return graph.degrees(edges, nodes)


@query("reverse_edges", f"SELECT to_url AS from_url, from_url AS to_url, to_name AS from_name, from_name AS to_name, CAST(NULL AS VARCHAR) AS to_lcba, _ord FROM ({EDGES}) e")
def reverse_edges(t):
    rows = t.sql(EDGES).select("from_url", "to_url", "from_name", "to_name", "to_lcba", "_ord")
    return graph.reverse_edges(rows, ["url", "name"], ["to_lcba"])


#: Edges from greater to smaller numbers, one for each order; numbers of orders and customers share the nodes.
CHAIN = "SELECT 'p' AS project, concat('n', CAST(greatest(o_orderkey, o_custkey) AS STRING)) AS from_url, concat('n', CAST(least(o_orderkey, o_custkey) AS STRING)) AS to_url, CAST(o_orderkey AS BIGINT) AS _ord FROM {orders} WHERE o_orderkey <> o_custkey"
NODES = "SELECT concat('n', CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_orderkey % 5 = 0 THEN '#main-code' ELSE '#test-code' END AS artifact FROM {orders}"


@query(
    "expand_calls",
    f"""WITH RECURSIVE e AS (SELECT e.*, coalesce(b.artifact, '') AS art, coalesce(a.artifact, '') AS from_art FROM ({CHAIN}) e LEFT JOIN ({NODES}) b ON b.url = e.to_url LEFT JOIN ({NODES}) a ON a.url = e.from_url),
 walk AS (SELECT _ord AS start, from_url AS origin, to_url AS node, art, 1 AS d, '' AS caller FROM e WHERE from_art = '#test-code' AND art = '#test-code'
 UNION ALL SELECT w.start, w.origin, e.to_url, e.art, w.d + 1, e.from_url FROM walk w JOIN e ON e.from_url = w.node WHERE w.d < 5 AND w.art <> '#main-code'),
 shortest AS (SELECT start, origin, node, min(d) AS d FROM walk GROUP BY 1, 2, 3)
 SELECT DISTINCT from_url, to_url, 1 AS to_call_depth FROM e UNION SELECT DISTINCT origin, node, d FROM shortest WHERE d > 1""",
)
def expand_calls(t):
    found = graph.expand_calls(t.sql(CHAIN), t.sql(NODES))
    return found.select("from_url", "to_url", "to_call_depth").distinct()


@query(
    "hierarchy_closure",
    f"""WITH RECURSIVE c AS (SELECT DISTINCT from_url AS child, to_url AS ancestor, 1 AS level FROM ({CHAIN}) e UNION SELECT c.child, e.to_url, c.level + 1 FROM c JOIN ({CHAIN}) e ON e.from_url = c.ancestor WHERE c.level < 40)
 SELECT child, ancestor, CAST(min(level) AS INTEGER) AS level FROM c GROUP BY 1, 2""",
)
def hierarchy_closure(t):
    return graph.closure(t.sql(CHAIN), "from_url", "to_url")


@query(
    "calls_before_assertions",
    """WITH c AS (SELECT 't' || (event_id // 20) AS from_url, CASE event_type WHEN 'error' THEN 'assertEquals' ELSE event_type END AS name, CAST(event_id % 20 AS INTEGER) AS line,
 CAST(event_id % 20 AS INTEGER) AS end_line, event_type = 'signup' AS in_assertion, event_id AS _ord FROM {events}),
 n AS (SELECT *, min(CASE WHEN name = 'assertEquals' THEN line END) OVER (PARTITION BY from_url ORDER BY line RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM c),
 m AS (SELECT *, name <> 'assertEquals' AND NOT in_assertion AND ahead IS NOT NULL AS plain FROM n)
 SELECT from_url, name, line, end_line, in_assertion, _ord, CAST(in_assertion OR (plain AND line = max(CASE WHEN plain THEN line END) OVER (PARTITION BY from_url, ahead)) AS INTEGER) AS lcba FROM m""",
)
def calls_before_assertions(t):
    calls = t.events.select(
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 20).cast("string")).alias("from_url"),
        F.when(F.col("event_type") == "error", "assertEquals").otherwise(F.col("event_type")).alias("name"),
        (F.col("event_id") % 20).cast("int").alias("line"), (F.col("event_id") % 20).cast("int").alias("end_line"),
        (F.col("event_type") == "signup").alias("in_assertion"), F.col("event_id").alias("_ord"),
    )
    return graph.last_call_before_assertion(calls)


@query("last_assertion_lines", """SELECT concat('t', CAST(event_id // 20 AS VARCHAR)) AS from_url, CAST(max(CASE WHEN event_type = 'error' THEN event_id % 20 END) AS INTEGER) AS last_assertion FROM {events} GROUP BY 1""")
def last_assertion_lines(t):
    calls = t.events.select(
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 20).cast("string")).alias("from_url"),
        F.when(F.col("event_type") == "error", "assertEquals").otherwise(F.col("event_type")).alias("name"),
        (F.col("event_id") % 20).cast("int").alias("end_line"),
    )
    return graph.last_assertion_line(calls)


# ---- distributions --------------------------------------------------------------------------


@query("ecdf", "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS share FROM {lineitem}")
def ecdf(t):
    return relational.ecdf(t.lineitem, "l_quantity", ["l_returnflag"]).withColumn("share", F.round("share", 9))


DELTAS = f"SELECT project, CAST(TRY_CAST(from_ch_all AS DOUBLE) - TRY_CAST(to_ch_all AS DOUBLE) AS BIGINT) AS delta FROM ({PAIRS}) p WHERE TRY_CAST(from_ch_all AS DOUBLE) IS NOT NULL"


@query("delta_cdf", f"WITH d AS ({DELTAS}), g AS (SELECT unnest(range(min(delta), max(delta) + 1)) AS delta FROM d) SELECT g.delta, round(sum(count(d.delta)) OVER (ORDER BY g.delta) / (SELECT count(*) FROM d), 9) AS cdf FROM g LEFT JOIN d ON d.delta = g.delta GROUP BY g.delta")
def delta_cdf(t):
    return revisions.dense_cdf(revisions.deltas(t.sql(PAIRS), "ch_all"), "delta").withColumn("cdf", F.round("cdf", 9))


@query("clipped_delta_counts", f"SELECT CAST(least(greatest(delta, -10), 10) AS BIGINT) AS delta, count(*) AS n FROM ({DELTAS}) d GROUP BY 1")
def clipped_delta_counts(t):
    d = revisions.deltas(t.sql(PAIRS), "ch_all")
    return d.groupBy(revisions.clipped(F.col("delta")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


@query("coverage_threshold", f"WITH c AS (SELECT delta, sum(count(*)) OVER (ORDER BY delta) / sum(count(*)) OVER () AS cdf FROM ({DELTAS}) d GROUP BY delta), h AS (SELECT min(delta) AS delta FROM c WHERE cdf >= 0.8) SELECT c.delta AS threshold, round_even(c.cdf * 100, 2) AS covered, round_even((1 - c.cdf) * 100, 2) AS tail FROM c JOIN h USING (delta)")
def coverage_threshold(t):
    d = revisions.deltas(t.sql(PAIRS), "ch_all")
    return revisions.coverage_threshold(revisions.dense_cdf(d, "delta"), "delta")


@query("delta_groups", f"SELECT CASE WHEN delta <= 0 THEN 'NTR' WHEN delta < 5 THEN 'MTR' ELSE 'HTR' END AS grp, count(*) AS n, count(DISTINCT project) AS projects, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent FROM ({DELTAS}) d GROUP BY 1")
def delta_groups(t):
    return revisions.delta_group_counts(revisions.deltas(t.sql(PAIRS), "ch_all"))


@query("display_positions", "SELECT p_partkey AS id, CASE WHEN p_size <= 0 THEN 0.0 WHEN p_size <= 1 THEN p_size WHEN p_size <= 2 THEN 1 + (p_size - 1) / 1.0 WHEN p_size <= 5 THEN 2 + (p_size - 2) / 3.0::DOUBLE WHEN p_size <= 10 THEN 3 + (p_size - 5) / 5.0::DOUBLE WHEN p_size <= 20 THEN 4 + (p_size - 10) / 10.0::DOUBLE ELSE 5 + (p_size - 20) / 30.0::DOUBLE END::DOUBLE AS x FROM {part}")
def display_positions(t):
    return t.part.select(F.col("p_partkey").alias("id"), revisions.display_position(F.col("p_size"), revisions.tick_values(50)).alias("x"))


@query("value_at_markers", "WITH s AS (SELECT CAST(event_id AS DOUBLE) * 10 + 5 AS x, value AS y FROM {events}), m AS (SELECT DISTINCT CAST(l_partkey * 31 AS DOUBLE) AS marker FROM {lineitem}) SELECT m.marker, coalesce(s.y, (SELECT arg_min(y, x) FROM s)) AS y FROM m ASOF LEFT JOIN s ON m.marker >= s.x")
def value_at_markers(t):
    steps = t.events.select((F.col("event_id").cast("double") * 10 + 5).alias("x"), F.col("value").alias("y"))
    markers = t.lineitem.select((F.col("l_partkey") * 31).cast("double").alias("marker")).distinct()
    return revisions.value_at_marker(steps, markers, "x", "y")


@query("runtime_statistics", "SELECT tool, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(max(s), 6) AS max FROM (SELECT 'a' AS tool, o_totalprice / 1000 AS s FROM {orders} UNION ALL SELECT 'b', o_custkey / 1000.0::DOUBLE FROM {orders}) x WHERE s > 0 GROUP BY tool")
def runtime_statistics(t):
    rows = t.orders.select(F.col("o_totalprice").alias("a_runtime"), F.col("o_custkey").cast("double").alias("b_runtime"))
    out = revisions.runtime_statistics(rows)
    return out.select("tool", *[F.round(c, 6).alias(c) for c in ("mean", "median", "max")])


@query("sample_sizes", "SELECT c_nationkey, CAST(least(ceil(384.16 / (1 + 383.16 / count(*))), count(*)) AS BIGINT) AS n FROM {customer} GROUP BY 1")
def sample_sizes(t):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("__n"))
    return sizes.select("c_nationkey", sampling.sample_size_column(F.col("__n")).alias("n"))


@query("classified_files", """SELECT 'p' AS project, concat(CASE WHEN p_partkey % 2 = 0 THEN 'core-test/' ELSE 'core/' END, CASE WHEN p_partkey % 3 = 0 THEN 'src/test/java/' ELSE 'src/main/java/' END, p_partkey, '.java') AS file,
 CASE WHEN p_partkey % 2 = 0 THEN 'core-test' ELSE 'core' END AS module, CASE WHEN p_partkey % 3 = 0 THEN 'test-code' ELSE 'main-code' END AS kind,
 concat(CASE WHEN p_partkey % 2 = 0 THEN '#test-module ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN '#test-code' ELSE '#main-code' END) AS artifact FROM {part}""")
def classified_files(t):
    files = t.part.select(F.lit("p").alias("project"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "core-test/").otherwise("core/"), F.when(F.col("p_partkey") % 3 == 0, "src/test/java/").otherwise("src/main/java/"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file"))
    modules = t.spark.createDataFrame([("p", ""), ("p", "core"), ("p", "core-test")], "project string, module string")
    return classification.classify_files(files, modules)


@query("open_files", "SELECT concat('f', CAST(event_id // 2 AS VARCHAR)) AS file FROM {events} GROUP BY 1 HAVING bool_and(event_type = 'error')")
def open_files(t):
    file = F.concat(F.lit("f"), F.floor(F.col("event_id") / 2).cast("string")).alias("file")
    cache = t.events.select(file, F.when(F.col("event_type") == "error", ingest.FAILED).alias("_flag"))
    return ingest.open_files(t.events.select(file), cache)


@query("smell_cells", f"SELECT _ord, len(list_filter(regexp_split_to_array(smell, '\\s+'), lambda s: s <> '')) AS n, smell = 'error' AS is_error FROM ({SMELLS}) s")
def smell_cells(t):
    return t.sql(SMELLS).select("_ord", F.size(text.split_smells(F.col("smell"))).cast("long").alias("n"), text.smell_flag(F.col("smell"), "error").alias("is_error"))


@query("nearest_commits", f"""WITH c AS ({COMMITS}), a AS (SELECT * FROM c WHERE event_type = 'error'), b AS (SELECT * FROM c WHERE event_type = 'purchase')
 SELECT a.event_id, round(min(abs(epoch_us(a.ts) - epoch_us(b.ts))) / 86400e6, 9) AS gap_days FROM a LEFT JOIN b ON a.user_id = b.user_id GROUP BY a.event_id""")
def nearest_commits(t):
    from weftline.operators import review

    c = t.sql(COMMITS)
    a = c.where("event_type = 'error'").select("event_id", "user_id", "ts")
    found = review.nearest_gap(a, c.where("event_type = 'purchase'"), "ts", ["user_id"])
    return found.select("event_id", F.round("gap_days", 9).alias("gap_days"))
