"""Small hand-made frames with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import dates, statistics, strings, tags, text
from weftline.operators import (
    agreement, classification, evaluation, filters, graph, ingest, linking, relational, review, revisions, sampling, scoring,
    signatures, smell_bridge, smells,
)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def frame(spark, schema, *values):
    return spark.createDataFrame([(*v, i) for i, v in enumerate(values)], schema + ", _ord long")


# ---- linking and scoring --------------------------------------------------------------------


def test_one_target_links(spark):
    df = frame(spark, "from_url string, to_url string", ("A", "pA"), ("B", "pB"), ("B", "pB"), ("C", "pC"), ("C", "pD"))
    assert sorted(rows(linking.select_links(df, "omc"), "_ord")) == [(0,), (1,)]
    counted = linking.with_targets(df).where("__targets = 1")
    assert sorted(rows(counted, "_ord")) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("key,low,high", [("lcs-u", 0.74, 0.90), ("lcs-b", 0.54, 0.60), ("leven", 0.94, 0.98), ("tarantula", 0.94, 0.99), ("tfidf", 0.89, 0.95), ("combined", 0.84, 0.90)])
def test_thresholds(spark, key, low, high):
    column = linking.THRESHOLDS[key][0]
    df = frame(spark, f"from_url string, to_url string, {column} string", ("a", "x", str(low)), ("a", "y", str(high)), ("b", "z", ""))
    assert rows(linking.select_links(df, key), "_ord") == [(1,)]


def test_strategies_parse():
    assert linking.parse_strategy("nc--omc") == ["omc", "nc"]
    assert linking.strategy_key(["nc", "omc"]) == "omc--nc"
    assert linking.strategy_columns(["combined"]) == list(scoring.TECHNIQUES)
    with pytest.raises(ValueError):
        linking.parse_strategy("nope")


CANDIDATES = [("tA", "add", "testAdd", "add", "1", "1"), ("tA", "format", "testAdd", "format", "2", "0"), ("tF", "format", "testFormat", "format", "1", "1")]


def test_scores_order(spark):
    df = frame(spark, "from_url string, to_url string, from_name string, to_name string, to_call_depth string, to_lcba string", *CANDIDATES)
    out = {(r["from_url"], r["to_url"]): r for r in scoring.score_candidates(df).collect()}
    a, b, c = out["tA", "add"], out["tA", "format"], out["tF", "format"]
    assert [x["tech_nc"] for x in (a, b, c)] == [1, 0, 1]
    assert (a["tech_lcba"], b["tech_lcba"]) == (1, 0)
    for column in ("tech_tarantula", "tech_tfidf", "tech_combined"):
        assert a[column] > b[column]
    assert [x["tech_lc"] for x in (a, b, c)] == [0, 1, 1]
    single = scoring.pair_scores(df.where("from_url = 'tF'")).first()
    assert single["tech_tarantula"] == 0
    blank = scoring.pair_scores(df.withColumn("to_name", F.lit(""))).first()
    assert blank["tech_nc"] == blank["tech_lcs_u"] == 0


def test_prediction_columns(spark):
    df = frame(spark, "from_url string, to_url string", ("a", "x"), ("a", "y"), ("b", "z"))
    known = frame(spark, "from_url string, to_url string, tech_llm long", ("a", "x", 0), ("a", "x", 1), ("a", "y", 0))
    found = dict(zip("xyz", [r["tech_llm"] for r in relational.prediction_columns(df, known, "tech_llm").orderBy("_ord").collect()]))
    assert found == {"x": 1, "y": 0, "z": None}
    assert relational.prediction_columns(df, None, "tech_llm").where("tech_llm IS NULL").count() == 3
    with pytest.raises(ValueError):
        relational.prediction_columns(df, known.drop("tech_llm"), "tech_llm")


# ---- graph ----------------------------------------------------------------------------------

HELPERS = [("testCopy", "verify"), ("verify", "actual"), ("actual", "process")]
ARTIFACTS = [("testCopy", "#test-code"), ("verify", "#test-code"), ("actual", "#test-code"), ("process", "#main-code")]


@pytest.mark.parametrize("depth_first", [False, True])
def test_helper_chain(spark, depth_first):
    edges = frame(spark, "project string, from_url string, to_url string", *[("p", *e) for e in HELPERS])
    methods = spark.createDataFrame(ARTIFACTS, "url string, artifact string")
    expand = graph.expand_calls_depth_first if depth_first else graph.expand_calls
    found = expand(edges, methods).where("from_url = 'testCopy'").orderBy("to_call_depth")
    assert rows(found, "to_url", "to_call_depth", "to_caller_url") == [("verify", 1, ""), ("actual", 2, "verify"), ("process", 3, "actual")]


@pytest.mark.parametrize("depth_first", [False, True])
def test_self_call_and_repeated_rows(spark, depth_first):
    edges = frame(spark, "project string, from_url string, to_url string", ("p", "tests", "find"), ("p", "tests", "find"), ("p", "find", "short"), ("p", "find", "find"))
    methods = spark.createDataFrame([("tests", "#test-code"), ("find", "#test-code"), ("short", "#main-code")], "url string, artifact string")
    expand = graph.expand_calls_depth_first if depth_first else graph.expand_calls
    found = rows(expand(edges, methods).where("from_url = 'tests'"), "to_url", "to_call_depth")
    assert sorted(found) == [("find", 1), ("short", 2)]


def test_assertion_marks(spark):
    calls = frame(
        spark, "from_url string, name string, line int, end_line int, in_assertion boolean",
        ("t", "setup", 1, 1, False), ("t", "run", 2, 2, False), ("t", "assertTrue", 3, 3, False), ("t", "get", 3, 3, True),
        ("t", "more", 5, 5, False), ("t", "fail", 6, 6, False), ("t", "tail", 7, 7, False),
    )
    found = {r["name"]: r["lcba"] for r in graph.last_call_before_assertion(calls).collect()}
    assert found == {"setup": 0, "run": 1, "assertTrue": 0, "get": 1, "more": 1, "fail": 0, "tail": 0}
    assert rows(graph.last_assertion_line(calls), "last_assertion") == [(6,)]


def test_closure_ends_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert sorted(rows(graph.closure(pairs), "child", "ancestor", "level"))[:2] == [("a", "b", 1), ("a", "c", 2)]
    levels = graph.search_levels(graph.closure(spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")), "b")
    assert sorted(rows(levels, "direction", "level", "name")) == [(0, 0, "b"), (1, 1, "a"), (2, 1, "c")]


# ---- evaluation -----------------------------------------------------------------------------


def test_mean_average_precision(spark):
    truth = spark.createDataFrame([("t", "a"), ("t", "c"), ("u", "d")], "from_url string, to_url string")
    predicted = frame(spark, "from_url string, to_url string, score double", ("t", "a", 0.9), ("t", "b", 0.8), ("t", "c", 0.7), ("u", "x", 0.9), ("u", "d", 0.8))
    assert evaluation.mean_average_precision(predicted, truth, "score").first()["map"] == pytest.approx((5 / 6 + 1 / 2) / 2)


def test_pr_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert evaluation.pr_auc(df).first()["auc"] == pytest.approx(0.7916666666666666)
    assert evaluation.pr_auc(df.where("label = 1")).first()["auc"] is None


def test_groups():
    groups = {"x": ["a", "b"], "y": ["b", "c"]}
    assert evaluation.resolve_groups(groups, "all") == ("all", ["a", "b", "c"])
    assert evaluation.resolve_groups(groups, "y") == ("y", ["b", "c"])
    assert evaluation.resolve_groups(groups, "y,x") == ("multi-group", ["b", "c", "a"])


# ---- statistics -----------------------------------------------------------------------------


def plain_ranks(values):
    ordered = sorted(values)
    return [(ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2 for v in values]


def test_rank_sums_match_plain_code(spark):
    draw = random.Random(1)
    for n1, n2, top in ((5, 7, 3), (20, 30, 6), (3, 4, 1000)):
        x, y = [draw.randrange(top) for _ in range(n1)], [draw.randrange(top) for _ in range(n2)]
        df = spark.createDataFrame([(v, True) for v in x] + [(v, False) for v in y], "v long, first boolean")
        r = revisions.mann_whitney(revisions.rank_sums(df, "v", F.col("first"))).first()
        u1 = sum(plain_ranks(x + y)[:n1]) - n1 * (n1 + 1) / 2
        delta = sum((a > b) - (a < b) for a in x for b in y) / (n1 * n2)
        assert (r["u1"], r["n1"], r["n2"]) == (u1, n1, n2)
        assert r["delta"] == pytest.approx(delta)


def test_distributions():
    assert statistics.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1)
    assert statistics.wilcoxon_p(0, 5, 0) == pytest.approx(0.0625)
    assert statistics.wilcoxon_p(0, 0, 0) == 1.0
    assert statistics.chi_square_tail(3.841458820694124) == pytest.approx(0.05)
    assert statistics.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert sum(statistics._u_counts(4, 3)) == math.comb(7, 3)
    odds, low, high, p = statistics.fisher(3, 1, 1, 3)
    assert (odds, p) == (pytest.approx(6.4083, rel=1e-4), pytest.approx(0.4857142857))
    assert (low, high) == (pytest.approx(0.2117356, rel=1e-6), pytest.approx(626.24353, rel=1e-6))
    assert statistics.fisher(0, 0, 1, 2)[3] == 1.0


def test_kendall_matches_plain_code():
    draw = random.Random(2)
    for _ in range(20):
        n = draw.randrange(3, 40)
        x, y = ([draw.randrange(6) for _ in range(n)] for _ in range(2))
        sign = lambda a: (a > 0) - (a < 0)
        pairs = [(i, j) for i in range(n) for j in range(i)]
        s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)
        a, b = (sum(v[i] != v[j] for i, j in pairs) for v in (x, y))
        if a and b:
            assert statistics.kendall(x, y)[0] == pytest.approx(s / math.sqrt(a * b))
    assert statistics.kendall([1, 2, 3, 4, 5], [3, 4, 1, 2, 5])[1] == pytest.approx(0.8166666667)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.03)], "smell string, p double")
    assert [r["q"] for r in smells.adjust(df, "p", "q").orderBy("smell").collect()] == pytest.approx([0.04, 0.003, 0.04])


def test_sampling_sizes():
    assert sampling.sample_size(450) == 208
    assert sampling.sample_size(0) == 0
    assert sampling.slot_numbers([1001, 1003, 1004], 3) == [1002, 1005, 1006]


# ---- smells ---------------------------------------------------------------------------------


def smell_frame(spark, *values):
    return frame(spark, "project string, from_url string, rg_all string, smells string", *values)


def test_unique_methods(spark):
    df = smell_frame(spark, ("p", "A", "NTR", "AR"), ("p", "A", "NTR", "AR ET"), ("p", "B", "NTR", "VT"), ("p", "B", "HTR", "VT"), ("p", "C", "HTR", ""))
    assert sorted(rows(smells.unique_methods(df, "rg_all", ["NTR", "HTR"]), "from_url", "smells")) == [("A", "AR ET"), ("C", "")]


def test_prevalence(spark):
    df = smell_frame(spark, ("p", "A", "ATR", "AR"), ("p", "A", "ATR", "AR"), ("p", "A", "HTR", "AR"), ("p", "B", "ATR", ""))
    found = {(r["rg_group"], r["smell"]): (r["smell_n"], r["percent"], r["methods"]) for r in smells.prevalence(df, "rg_all").collect()}
    assert found["ATR", "any"] == (0, 0.0, 1)
    assert found["ATR", "none"] == (1, 100.0, 1)
    assert found["HTR", "any"] == (0, 0.0, 0)


def test_loc_groups(spark):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(1, 11)], "from_url string, loc long")
    table = {r["loc_group"]: (r["loc_min"], r["loc_max"], r["methods"], r["percent"]) for r in smells.loc_group_table(df).collect()}
    assert table == {"S": (1, 7, 7, 70.0), "M": (8, 8, 1, 10.0), "L": (9, 9, 1, 10.0), "XL": (10, 10, 1, 10.0)}


def test_first_valid_loc(spark):
    df = frame(spark, "url string, loc string", ("A", "bad"), ("A", "10"), ("A", "99"), ("B", "0"), ("C", "3"), ("", "4"))
    assert sorted(rows(smells.first_valid_loc(df), "from_url", "loc")) == [("A", 10), ("C", 3)]


def test_association(spark):
    values = []
    for project in ("one", "two"):
        for k in range(3):
            smell = "AR" if k < 2 else "VT"
            values += [(project, f"{project}h{k}", "HTR", smell), (project, f"{project}n{k}", "NTR", "VT" if k < 2 else "AR")]
    unique = smells.comparison_methods(smell_frame(spark, *values), "rg_all", "HTR", "NTR")
    table = {r["smell"]: r for r in smells.association(unique, "rg_all", "HTR", "NTR").collect()}
    assert (table["AR"]["focal_n"], table["AR"]["baseline_n"]) == (6, 6)
    assert table["AR"]["odds_ratio"] > 1 and table["AR"]["mh_odds_ratio"] > 1
    assert math.isnan(table["any"]["fisher_p_adjusted"])
    assert table["any"]["focal_smell_n"] == 6


def test_paired_prevalence(spark):
    table = spark.createDataFrame([("HTR", "AR", 75.0), ("HTR", "ET", 25.0), ("HTR", "VT", 25.0), ("NTR", "AR", 25.0), ("NTR", "ET", 0.0), ("NTR", "any", 1.0), ("HTR", "any", 1.0)], "rg_group string, smell string, percent double")
    pairs = smells.paired_smells(table, "HTR", "NTR")
    assert sorted(rows(pairs, "smell")) == [("AR",), ("ET",)]
    assert smells.signed_rank(pairs).first()["w_stat"] == 0
    same = smells.signed_rank(pairs.withColumn("g2", F.col("g1"))).first()
    assert (same["w_stat"], same["w_p"]) == (0, 1.0)


def test_group_pairs():
    assert smells.group_pairs(None) == [("HTR", "NTR")]
    assert smells.group_pairs("AHTR,NTR;ATR,NTR") == [("MTR", "NTR"), ("ATR", "NTR")]
    with pytest.raises(ValueError):
        smells.group_pairs("HTR")


# ---- methods and text -----------------------------------------------------------------------


def test_trivial_production(spark):
    code = [
        ("getName", "main-code", "String getName() {\n return name;\n}"), ("setName", "main-code", "void setName(String n) {\n name = n;\n}"),
        ("isReady", "main-code", "boolean isReady();"), ("calculate", "main-code", "int calculate() {\n return 1;\n}"),
        ("testGetName", "test-case-method", "void testGetName() {}"), ("get", "main-code", "void get() {\n}"),
    ]
    df = spark.createDataFrame([(n, k, c, "1", "3") for n, k, c in code], "name string, method_kind string, code string, start_line string, end_line string")
    assert rows(filters.without_trivial_production(df), "name") == [("calculate",), ("testGetName",), ("get",)]


def test_text_functions(spark):
    df = spark.createDataFrame([("dir/File--run--12.json", "10, 12", "7")], "f string, b string, x string")
    r = df.select(
        text.history_file_url(F.lit("https://h/a"), F.lit("abc"), F.col("f")).alias("url"), text.list_item(F.col("b"), F.lit(1)).alias("i"),
        text.list_item(F.col("b"), F.lit(5)).alias("j"), text.stable_shard(F.col("f"), 8).alias("s"),
        text.source_root(F.lit("m/src/a/b/C.java"), F.lit("a.b")).alias("root"), text.source_root(F.lit("m/src/C.java"), F.lit("x.y")).alias("own"),
    ).first()
    import hashlib

    assert r["url"] == "https://h/a/blob/abc/dir/File.java#L12"
    assert (r["i"], r["j"]) == ("12", "10")
    assert r["s"] == int(hashlib.sha1(b"dir/File--run--12.json").hexdigest(), 16) % 8 + 1
    assert (r["root"], r["own"]) == ("m/src", "m/src")


def test_dates(spark):
    values = ["31/12/20, 1:05 PM", "12/31/20 13:05", "2020-12-31T13:05:00+00:00", "00:05 AM", "3/4/2021 00:05 AM", "x", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    found = [r[0] for r in df.select(F.date_format(dates.parse_commit_date(F.col("d")), "yyyy-MM-dd HH:mm")).collect()]
    assert found == ["2020-12-31 13:05"] * 3 + [None, "2021-04-03 00:05", None, None]


def test_string_measures():
    assert strings.lcs_length("abcbdab", "bdcaba") == 4
    assert strings.common_substring_length("abXYz", "qxyzz") == 3
    kinds = [r["kind"] for r in strings.diff_rows("@@ -1,3 +1,3 @@\n a\n-b\n+c\n+d\n e")]
    assert kinds == ["same", "change", "add", "same"]
    assert strings.last_object('noise {"methods": [1]} more') == '{"methods": [1]}'
    assert strings.text_blocks("METHOD: a.b\nCONFIDENCE: 0.8\nRATIONALE: x\n y")[0] == {"method": "a.b", "confidence": 0.8, "rationale": "x y"}


def test_tags(spark):
    df = spark.createDataFrame([("#main-code#doc-module",), (None,)], "a string")
    a = F.col("a")
    found = rows(df.select(tags.encode_tags(tags.split_tags(a)).alias("e"), tags.is_production(a).alias("p"), tags.artifact_role(a).alias("r")), "e", "p", "r")
    assert found == [("#doc-module #main-code", False, "main-code"), ("", False, "unknown")]


def test_selections():
    items = ["a", "b", "c", "d"]
    assert filters.select_projects(items, ["d", "a"], "0:3") == ["a"]
    assert filters.parse_index("::2,-1", 4) == [0, 2, 3]
    assert filters.parse_index("9", 4) == []
    with pytest.raises(IndexError):
        filters.parse_index("9", 4, strict=True)
    with pytest.raises(ValueError):
        filters.select_named(items, ["z"])
    assert filters.parse_names("a, b,a") == ["a", "b"]
    assert filters.parse_names(":") is None
    assert filters.resolve_filters({"tools": "x"}, {"tools": "y", "projects": "p"}, {})["projects"] == ["p"]
    assert filters.change_columns(["ch_body", "ch_all", "ch_x", "u"]) == ["ch_all", "ch_body"]


# ---- bridge, review, ingest -----------------------------------------------------------------


def test_smells_to_methods(spark):
    raw = frame(spark, "path string, testSmellName string, testSmellMethod string, testSmellLineBegin string, testSmellLineEnd string", ("/home/r/src/FooTest.java", "Lazy Test", "testFoo, missing", "10, 12", "11, 13"))
    methods = spark.createDataFrame([("src/FooTest.java", "testFoo", "u1", 9, 14), ("src/FooTest.java", "testFoo", "u2", 20, 30)], "file string, name string, url string, start int, end int")
    found, lost = smell_bridge.smells_to_methods(raw, methods, {"Lazy Test": "LT"})
    assert rows(found, "url", "smell", "loc") == [("u1", "LT", 6)]
    assert rows(lost, "method", "reason") == [("missing", "method not found")]


def test_introduction_bridge(spark):
    links = spark.createDataFrame([("t", "p")] * 2, "from_url string, to_url string")
    commits = "url string, commit string, name string, old_url string, start int, diff string, type string, place int"
    tests = spark.createDataFrame([("t", "later456", "testFoo", "o1", 50, "", "Ybodychange", 0), ("t", "intro123", "testFooOld", "o0", 10, "@@ -0,0 +1,3 @@\n+a\n+b\n+c", "Yintroduced", 1)], commits)
    production = spark.createDataFrame([("p", "intro123", "fooOld", "q0", 1, "", "Ybodychange", 0)], commits)
    found = smell_bridge.introduction_bridge(links, tests, production)
    assert rows(found, "from_old_name", "from_old_start", "from_old_end", "to_old_name") == [("testFooOld", 10, 12, "fooOld")]


def test_labels_and_updates(spark):
    truth = frame(spark, "project string, from_url string, to_url string, label string, candidate string, tags string, notes string", ("alpha", "t", "a", "1", "0", "#x", ""), ("alpha", "t", "b", "", "0", "#x #y", "n"), ("alpha", "u", "c", "0", "", "", ""))
    done = {r["from_url"]: r for r in review.test_progress(truth).collect()}
    assert (done["t"]["total"], done["t"]["labelled"], done["t"]["true_links"], done["t"]["non_candidates"]) == (2, 1, 1, 2)
    changed = review.update_labels(truth, spark.createDataFrame([("t", "b", "0")], "from_url string, to_url string, label string"))
    assert dict(rows(changed, "to_url", "label")) == {"a": "1", "b": "0", "c": "0"}
    with pytest.raises(ValueError):
        review.update_labels(truth, spark.createDataFrame([("t", "zz", "0")], "from_url string, to_url string, label string"))
    assert rows(review.rename_tag(truth, "#x", "#z"), "tags") == [("#z",), ("#z #y",), ("",)]
    assert review.delete_test(truth, "t").count() == 1
    assert rows(review.tag_dictionary(truth), "tag") == [("#x",), ("#y",)]
    noted = review.update_note(truth, "t", "a", {"notes": "seen"})
    assert rows(noted, "notes") == [("seen",), ("n",), ("",)]


def test_agreement(spark):
    schema = "project string, from_url string, to_url string, label string"
    left = frame(spark, schema, ("p", "a", "x", "1"), ("p", "a", "y", "0"), ("p", "b", "z", "1"))
    right = frame(spark, schema, ("p", "a", "x", "1"), ("p", "a", "y", "1"), ("p", "c", "w", "1"))
    total = {r["project"]: r for r in agreement.agreement_summary(agreement.compare_labels(left, right)).collect()}
    assert (total["total"]["both"], total["total"]["agreed"], total["total"]["only_left"]) == (2, 1, 1)
    conflict = frame(spark, schema, ("p", "a", "x", "1"), ("p", "a", "x", "0"))
    with pytest.raises(Exception, match="different labels"):
        agreement.checked_labels(conflict).collect()


def test_ingest(spark):
    cache = spark.createDataFrame([("a", None), ("a", ingest.SCANNED), ("b", ingest.FAILED)], "file string, _flag string")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert sorted(rows(ingest.open_files(expected, cache), "file")) == [("b",), ("c",)]
    assert rows(ingest.failed_files(cache), "file") == [("b",)]
    assert not ingest.may_publish(expected, cache)
    again = ingest.appended(cache, spark.createDataFrame([("a", None), ("c", None)], "file string, _flag string"))
    assert again.count() == 4


def test_signature_mapping(spark):
    calls = spark.createDataFrame([("1", "run", ["String", "List<A>"], "run(String,List)")], "call_id string, name string, params array<string>, signature string")
    declared = spark.createDataFrame([("run", "a.run(String,Collection)", ["String", "Collection"]), ("run", "b.run(int,int)", ["int", "int"]), ("run", "c.run()", [])], "name string, signature string, params array<string>")
    closure = spark.createDataFrame([("List", "Collection")], "child string, ancestor string")
    best = signatures.best_signatures(signatures.signature_scores(calls, declared, closure))
    assert rows(signatures.mapped_signatures(calls, best), "signature") == [("a.run(String,Collection)",)]


def test_classification(spark):
    files = spark.createDataFrame([("p", "core/src/test/java/A.java"), ("p", "core/src/main/java/B.java"), ("p", "core/src/main/resources/c.txt"), ("p", "core/target/generated-sources/D.java"), ("p", "docs/src/main/java/E.java")], "project string, file string")
    modules = spark.createDataFrame([("p", ""), ("p", "core"), ("p", "docs")], "project string, module string")
    found = dict(rows(classification.classify_files(files, modules), "file", "artifact"))
    wanted = ["#test-code", "#main-code", "#main-resource", "#main-code #main-code-generated", "#doc-module #main-code"]
    assert [found[f] for f, in rows(files.select("file"), "file")] == wanted
    merged = classification.merge_config({"a": ["x"], "f": False}, {"a": ["y", "x"], "f": True})
    assert merged == {"a": ["x", "y"], "f": True}
