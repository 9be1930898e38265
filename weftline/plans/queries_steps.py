"""Registered queries: text and answer parsing, mapping scores, stores, samples, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import strings, tags, text
from weftline.operators import classification, filters, graph, relational, sampling, signatures, smell_bridge, smells
from weftline.plans.queries_core import CHAIN, CODE
from weftline.plans.queries_more import LINKS
from weftline.plans.registry import query
from weftline.plans.relations import EDGES, METHODS, SMELLS
from weftline.sources import history, store


def label(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- text -----------------------------------------------------------------------------------


@query("line_counts", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size % 4 + 1 WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size % 4 + 1 END AS BIGINT) AS lines FROM {part}")
def line_counts(t):
    third, size = F.col("p_partkey") % 3, F.col("p_size") % 4
    start = F.when(third == 0, "1.0").when(third == 1, "900").otherwise("x")
    end = F.when(third == 0, (size + 1).cast("string")).otherwise("7")
    code = F.concat(F.repeat(F.lit("a;\r\n"), size), F.lit("}"))
    return t.part.select("p_partkey", text.line_count(start, end, code).alias("lines"))


@query("package_roots", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('m', p_size, '/src') WHEN p_partkey % 3 = 1 THEN concat('m', p_size, '/src/com/acme') ELSE '' END AS root, concat('https://h/r/blob/', p_brand, '/A.java#L', p_size) AS url FROM {part}")
def package_roots(t):
    third = F.col("p_partkey") % 3
    file = F.when(third == 2, F.lit("com/acme/A.java")).otherwise(F.concat(label("m", "p_size"), F.lit("/src/com/acme/A.java")))
    package = F.when(third == 1, "com.other").otherwise("com.acme")
    url = text.method_url(F.lit("https://h/r"), F.col("p_brand"), F.lit("A.java"), F.col("p_size"))
    return t.part.select("p_partkey", text.source_root(file, package).alias("root"), url.alias("url"))


@query("review_tag_lists", "SELECT p_partkey, concat('#', replace(p_brand, '#', ''), CASE WHEN p_partkey % 2 = 0 THEN ' #two' ELSE '' END) AS tags FROM {part}")
def review_tag_lists(t):
    cell = F.concat(F.lit(" ##"), F.replace("p_brand", F.lit("#"), F.lit("")), F.when(F.col("p_partkey") % 2 == 0, ", two #two").otherwise(F.lit(" ")))
    return t.part.select("p_partkey", F.array_join(tags.review_tags(cell), " ").alias("tags"))


@query("chosen_signatures", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '(int)' WHEN p_partkey % 3 = 1 THEN p_type || '()' ELSE '' END AS chosen FROM {part}")
def chosen_signatures(t):
    third = F.col("p_partkey") % 3
    a = F.when(third == 0, F.concat("p_name", F.lit("(int)"))).otherwise(F.col("p_name"))
    b = F.when(third == 1, F.concat("p_type", F.lit("()")))
    return t.part.select("p_partkey", text.first_with_parenthesis(a, b).alias("chosen"))


@query("answers_in_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'f' || o_custkey WHEN 1 THEN 'f' || o_custkey END AS method, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 7 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) END AS confidence FROM {orders}")
def answers_in_text(t):
    third = F.col("o_orderkey") % 3
    inside = F.concat(F.lit('thought {"a": 1} then {"methods": [{"method": "'), label("f", "o_custkey"), F.lit('", "confidence": '), (F.col("o_orderkey") % 7).cast("string"), F.lit("}]} end"))
    blocks = F.concat(F.lit("- METHOD: "), label("f", "o_custkey"), F.lit("\nconfidence = about 0.5\nRATIONALE: so\nit is"))
    rows = t.orders.select("o_orderkey", F.when(third == 0, inside).when(third == 1, blocks).otherwise("none { at all").alias("answer"))
    parsed = F.from_json(strings.lenient_json(F.col("answer")), signatures.llm_schema())["methods"]
    found = rows.withColumns({"a": parsed, "b": strings.method_blocks(F.col("answer"))})
    first = lambda f: F.coalesce(F.get("a", F.lit(0))[f], F.get("b", F.lit(0))[f]).alias(f)
    return found.select("o_orderkey", first("method"), first("confidence"))


@query("diff_rows", """WITH r AS (SELECT o_orderkey AS k, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS i, CAST(o_custkey % 90 + 1 AS INTEGER) AS a FROM {orders})
 SELECT k, CASE i WHEN 1 THEN 'same' WHEN 2 THEN 'change' WHEN 3 THEN 'add' ELSE 'same' END AS kind, CASE i WHEN 1 THEN a WHEN 2 THEN a + 1 WHEN 4 THEN a + 2 END AS old_line, a + 9 + i AS new_line FROM r""")
def diff_rows(t):
    start = (F.col("o_custkey") % 90 + 1).cast("string")
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -"), start, F.lit(",3 +"), (F.col("o_custkey") % 90 + 11).cast("string"), F.lit(",4 @@ f\n x\n-old\n+new\n+more\n y"))
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.explode(strings.parsed_diff(diff)).alias("d"))
    return rows.select("k", "d.kind", "d.old_line", "d.new_line")


@query("old_end_lines", "SELECT p_partkey, CAST(p_size + 1 + p_partkey % 4 AS BIGINT) AS last FROM {part}")
def old_end_lines(t):
    diff = F.concat(F.lit("@@ -1 +1 @@\n x\n-gone\n+come"), F.repeat(F.lit("\n+more"), (F.col("p_partkey") % 4).cast("int")))
    return t.part.select("p_partkey", (F.col("p_size") + text.new_side_lines(diff) - 1).cast("long").alias("last"))


# ---- smells ---------------------------------------------------------------------------------



def _raw(t):
    return t.part.select(
        F.col("p_partkey").cast("long").alias("_ord"), F.concat(label("/w/src/F", "p_partkey"), F.lit(".java")).alias("path"),
        F.when(F.col("p_size") % 2 == 0, "Eager Test").otherwise("Other").alias("testSmellName"), F.lit("run, lost").alias("testSmellMethod"),
        F.lit("5,8").alias("testSmellLineBegin"), F.lit("6,9").alias("testSmellLineEnd"),
    )


def _declared(t):
    """Two methods of each name in a file; one contains the smelly lines."""
    ends = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(4).alias("s"), F.lit(7).alias("e")))).alias("x")
    rows = t.part.select("p_partkey", ends)
    return rows.select(
        F.concat(label("src/F", "p_partkey"), F.lit(".java")).alias("file"), F.lit("run").alias("name"),
        F.concat(label("u", "p_partkey"), F.lit("-"), F.col("x.s").cast("string")).alias("url"), F.col("x.s").alias("start"), F.col("x.e").alias("end"),
    )


@query("smells_of_methods", "SELECT concat('u', p_partkey, '-4') AS url, 'run' AS name, CASE WHEN p_size % 2 = 0 THEN 'ET' ELSE 'Other' END AS smell, CAST(5 AS BIGINT) AS smell_begin, CAST(6 AS BIGINT) AS smell_end, CAST(4 AS INTEGER) AS loc, p_partkey AS _ord FROM {part}")
def smells_of_methods(t):
    found = smell_bridge.smells_to_methods(_raw(t), _declared(t), {"Eager Test": "ET"})[0]
    return found.withColumns({c: F.col(c).cast("long") for c in ("smell_begin", "smell_end")})


@query("smells_without_method", "SELECT p_partkey AS _ord, 'lost' AS method, 'method not found' AS reason FROM {part}")
def smells_without_method(t):
    return smell_bridge.smells_to_methods(_raw(t), _declared(t), {"Eager Test": "ET"})[1].select("_ord", "method", "reason")


@query("smell_elements", "SELECT p_partkey AS _ord, unnest(['run', 'lost']) AS method, CAST(unnest([5, 8]) AS BIGINT) AS first, CAST(unnest([6, 9]) AS BIGINT) AS last FROM {part}")
def smell_elements(t):
    return smell_bridge.smell_items(_raw(t)).select("_ord", "method", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("linked_smells", f"SELECT l.from_url, l.to_url, l._ord, coalesce(s.smells, '') AS smells FROM ({EDGES}) l LEFT JOIN (SELECT url, array_to_string(list_sort(list_distinct(list(smell))), ' ') AS smells FROM ({SMELLS}) s WHERE trim(smell) <> '' GROUP BY 1) s ON s.url = l.from_url")
def linked_smells(t):
    return smells.attach_smells(t.sql(EDGES).select("from_url", "to_url", "_ord"), t.sql(SMELLS))


# ---- signatures and models ------------------------------------------------------------------


@query("parameter_scores", "SELECT s_suppkey, CAST(CASE s_suppkey % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM {supplier}")
def parameter_scores(t):
    fifth = F.col("s_suppkey") % 5
    declared = F.when(fifth == 0, "java.util.List<A>").when(fifth == 1, "Base").when(fifth == 2, "T").when(fifth == 3, "abcd").otherwise("xyz")
    given = F.when(fifth == 0, "List").when(fifth == 1, "Child").when(fifth == 2, "Any").when(fifth == 3, "bc").otherwise("pq")
    closure = t.spark.createDataFrame([("Child", "Base")], "child string, ancestor string")
    return signatures.parameter_scores(t.supplier.select("s_suppkey", declared.alias("declared"), given.alias("given")), closure).select("s_suppkey", "score")


@query("signature_scores", "SELECT CAST(s_suppkey AS VARCHAR) AS call_id, sig AS signature, score FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['f(int,A)', 'f(T,B)'] ELSE ['f()'] END) AS sig, CAST(unnest(CASE WHEN s_suppkey % 2 = 0 THEN [1.2, 0.5] ELSE [0.6] END) AS DOUBLE) AS score FROM {supplier}) x")
def signature_scores(t):
    none = F.expr("CAST(array() AS array<string>)")
    given = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("int"), F.lit("A"))).otherwise(none)
    calls = t.supplier.select(F.col("s_suppkey").cast("string").alias("call_id"), F.lit("f").alias("name"), given.alias("params"))
    declared = t.spark.createDataFrame([("f", "f(int,A)", ["int", "A"]), ("f", "f(T,B)", ["T", "B"]), ("f", "f()", []), ("g", "g()", [])], "name string, signature string, params array<string>")
    closure = t.spark.createDataFrame([("X", "Y")], "child string, ancestor string")
    return signatures.signature_scores(calls, declared, closure)


ANSWERS = """SELECT concat('t', CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_orderkey % 4 = 3 THEN 'late' ELSE '' END AS error,
  CASE WHEN o_orderkey % 4 = 2 THEN 'no json' ELSE concat('{{"methods":[{{"method":"a","confidence":0.25}},{{"method":"b","confidence":', CASE WHEN o_custkey % 2 = 0 THEN '0.75' ELSE '0.5' END, '}}]}}') END AS output_json FROM {orders}"""


@query("projected_links", "SELECT 't' || o_orderkey AS from_url, n AS to_name, CASE WHEN o_orderkey % 4 < 2 THEN CASE n WHEN 'a' THEN CAST(0.25 AS DOUBLE) WHEN 'b' THEN CASE WHEN o_custkey % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END END END AS confidence, CAST(o_orderkey % 4 < 2 AND n <> 'c' AS INTEGER) AS label FROM {orders}, (SELECT unnest(['a', 'b', 'c']) AS n)")
def projected_links(t):
    candidates = t.orders.select(label("t", "o_orderkey").alias("from_url"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("to_name"))
    return signatures.project_links(candidates, t.sql(ANSWERS))


@query("stored_predictions", "SELECT 't' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS max_confidence, 'a|b' AS names FROM {orders} WHERE o_orderkey % 4 < 2")
def stored_predictions(t):
    return signatures.stored_predictions(t.sql(ANSWERS))


@query("matched_predictions", f"SELECT from_url, to_url, _ord, CAST(CAST(l_partkey % 3 AS VARCHAR) IN ('0', '1') AS INTEGER) AS match FROM ({LINKS}) l")
def matched_predictions(t):
    rows = t.sql(LINKS).withColumns({"to_name": (F.col("l_partkey") % 3).cast("string"), "to_fqs": F.lit("f()"), "case_id": F.col("from_url")})
    predictions = rows.select("case_id").distinct().withColumn("predicted", F.lit("0|1|zz"))
    return signatures.mark_matches(rows, predictions).select("from_url", "to_url", "_ord", "match")


@query("prompt_cases", "SELECT 't' || l_orderkey AS from_url, count(DISTINCT l_partkey) AS candidates, 'c1' AS first FROM {lineitem} GROUP BY 1")
def prompt_cases(t):
    edges = t.lineitem.select(label("t", "l_orderkey").alias("from_url"), label("m", "l_partkey").alias("to_url"), label("f", "l_partkey").alias("to_fqs"), F.col("l_linenumber").cast("long").alias("_ord"))
    code = t.orders.select(label("t", "o_orderkey").alias("url"), F.lit("x").alias("code"))
    out = signatures.prompt_cases(edges, code)
    return out.select("from_url", F.size("candidates").cast("long").alias("candidates"), F.col("candidates")[0]["id"].alias("first"))


@query("linker_rows", "SELECT DISTINCT 't' || l_orderkey AS from_url, 'm' || l_partkey AS to_url, '{{ go(); }}' AS body, 'run(List,int[])' AS to_testlinker_fqs FROM {lineitem}")
def linker_rows(t):
    rows = t.lineitem.select(label("t", "l_orderkey").alias("from_url"), label("m", "l_partkey").alias("to_url"), F.lit("run(java.util.List<A>, int...)").alias("to_fqs"), F.col("l_linenumber").cast("long").alias("_ord"))
    code = t.orders.select(label("t", "o_orderkey").alias("url"), F.lit("void t() { go(); }").alias("code"))
    return signatures.linker_input(rows, code).select("from_url", "to_url", "body", "to_testlinker_fqs")


@query("model_probabilities", "SELECT c_custkey, round(1 / (1 + exp(c_acctbal / 1000 - 2)), 9) AS p FROM {customer}")
def model_probabilities(t):
    return t.customer.select("c_custkey", F.round(signatures.softmax_positive(F.col("c_acctbal") / 1000, F.lit(2.0)), 9).alias("p"))


# ---- stores, samples, sources ---------------------------------------------------------------

STORE = "url string, prompt string, output_raw string, output_json string, error string, created_at string, updated_at string"


@query("stored_results", "SELECT 't' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN 'raw' END AS output_raw, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'unknown' END AS error, CASE WHEN o_orderstatus = 'F' THEN 't2' ELSE 't1' END AS updated_at FROM {orders}")
def stored_results(t):
    empty = t.spark.createDataFrame([], STORE)
    asked = store.upsert_requests(empty, t.orders.select(label("t", "o_orderkey").alias("url"), F.lit("q").alias("prompt")), "t1")
    results = t.orders.where("o_orderstatus = 'F'").select(label("t", "o_orderkey").alias("url"), F.lit("raw").alias("output_raw"), F.lit("{}").alias("output_json"), F.lit("").alias("error"))
    return store.upsert_results(asked, results, "t2").select("url", "output_raw", "error", "updated_at")


@query("migrated_rows", "SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM {lineitem} UNION SELECT s_suppkey, NULL FROM {supplier}")
def migrated_rows(t):
    return store.migrate_cache(t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v")), t.supplier.select(F.col("s_suppkey").alias("k")))


@query("source_ranges", "SELECT p_partkey, CASE WHEN p_size % 5 BETWEEN 1 AND 3 THEN array_to_string(list_slice(['a', 'b', 'c'], p_size % 5, p_size % 5 + 1), chr(10)) ELSE '' END AS code FROM {part}")
def source_ranges(t):
    sources = t.part.select(F.col("p_partkey").cast("string").alias("file"), F.lit("a\r\nb\nc").alias("content"))
    methods = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("file"), (F.col("p_size") % 5).cast("int").alias("start_line"), (F.col("p_size") % 5 + 1).cast("int").alias("end_line"))
    return history.code_of_ranges(sources, methods).select("p_partkey", "code")


@query("oracle_counts", "SELECT 'https://h/' || n_regionkey AS repository, count(*) AS n FROM {nation} GROUP BY 1")
def oracle_counts(t):
    url = F.concat(F.lit(" https://h/"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".git").otherwise("//"))
    return history.oracle_counts(t.nation.select(F.col("n_name").alias("repositoryName"), url.alias("repositoryUrl")))[1]


@query("repaired_members", "SELECT DISTINCT l_returnflag AS archive, CAST(l_suppkey AS VARCHAR) AS member FROM {lineitem} WHERE l_linestatus = 'F'")
def repaired_members(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("archive"), F.col("l_suppkey").cast("string").alias("member"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("blank").alias("status"))
    return history.repaired_members(rows).select("archive", "member")


@query("method_selection", f"SELECT project, url, _ord FROM ({METHODS}) m WHERE url IN (SELECT concat('m', CAST(l_partkey % 400 AS VARCHAR)) FROM {{lineitem}} WHERE l_returnflag = 'R')")
def method_selection(t):
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.concat(F.lit("m"), (F.col("l_partkey") % 400).cast("string")).alias("url"))
    return filters.only_with(t.sql(METHODS), wanted, "url").select("project", "url", "_ord")


@query("retagged_rows", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#main-code' WHEN p_partkey % 3 = 0 THEN '#test-code #test-case-method' ELSE '#test-code #test-helper-method' END AS artifact, p_partkey % 2 = 1 AS changed FROM {part}")
def retagged_rows(t):
    keys = [F.col("p_partkey").cast("string").alias("file"), F.lit("f").alias("name"), F.lit(1).alias("start_line")]
    rows = t.part.select("p_partkey", *keys, F.when(F.col("p_partkey") % 2 == 0, "#main-code").otherwise("#test-code #test-fixture-method").alias("artifact"))
    roles = t.part.where("p_partkey % 2 = 1 AND p_partkey % 3 = 0").select(*keys, F.lit("#test-code #test-case-method").alias("artifact"))
    return classification.retag(rows, roles).select("p_partkey", "artifact", "changed")


@query("types_around", f"WITH RECURSIVE c AS (SELECT DISTINCT from_url AS child, to_url AS ancestor, 1 AS level FROM ({CHAIN}) e UNION SELECT c.child, e.to_url, c.level + 1 FROM c JOIN ({CHAIN}) e ON e.from_url = c.ancestor), p AS (SELECT child, ancestor, min(level) AS level FROM c GROUP BY 1, 2) SELECT child AS name, 1 AS direction, CAST(level AS INTEGER) AS level FROM p WHERE ancestor = 'n5' UNION ALL SELECT ancestor, 2, CAST(level AS INTEGER) FROM p WHERE child = 'n5' UNION ALL SELECT 'n5', 0, 0")
def types_around(t):
    return graph.search_levels(graph.closure(t.sql(CHAIN), "from_url", "to_url"), "n5")


@query("trivial_production", f"SELECT id, kind AS method_kind FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'test-case-method' ELSE 'main-code' END AS kind, regexp_matches(code, '[{{}}]') AS braced FROM ({CODE}) c) x WHERE kind <> 'main-code' OR NOT (NOT braced OR (CAST(end_line AS INT) < 5 AND ((name LIKE 'get%' AND regexp_matches(code, ' int getSize\\(\\)')) OR (name LIKE 'set%' AND regexp_matches(code, 'void setSize\\([^,)]+\\)')))))")
def trivial_production(t):
    rows = t.sql(CODE).withColumn("method_kind", F.when(F.col("id") % 3 == 0, "test-case-method").otherwise("main-code"))
    return filters.without_trivial_production(rows).select("id", "method_kind")


@query("called_candidates", f"SELECT from_url, to_url, to_name, _ord FROM ({EDGES}) e WHERE to_url = 'm7'")
def called_candidates(t):
    return relational.first_source([("edges", t.sql(EDGES).where("to_url = 'm7'")), ("none", t.sql(EDGES).where("false"))], ["to_url"]).select("from_url", "to_url", "to_name", "_ord")
