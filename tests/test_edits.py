"""Edits of review data, model runs, classification rules, numbering by ranges, caps that are none."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators import classification, ingest, model_runs, relational, reporting, review, sampling, scoring, signatures
from weftline.sources import config, schemas


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_insert_candidate(spark):
    truth = spark.createDataFrame(
        [("p", "t1", "a", "m1", "x", "1", "2", 0), ("p", "t1", "a", "m2", "y", "0", "1", 1), ("p", "t2", "b", "m1", "x", "", "1", 2)],
        "project string, from_url string, from_name string, to_url string, to_name string, candidate string, to_call_depth string, _ord long",
    )
    methods = spark.createDataFrame([("m9", "z", 5), ("m9", "later", 9)], "url string, name string, _ord long")
    out = review.insert_candidate(truth, methods, "t1", "m9").orderBy("_ord").collect()
    assert [(r["from_url"], r["to_url"], r["to_name"], r["candidate"], r["to_call_depth"], r["_ord"]) for r in out] == [
        ("t1", "m1", "x", "1", "2", 0), ("t1", "m2", "y", "0", "1", 1), ("t1", "m9", "z", "0", "1", 2), ("t2", "m1", "x", "", "1", 3),
    ]
    with pytest.raises(ValueError):
        review.insert_candidate(truth, methods, "t1", "m2")
    with pytest.raises(ValueError):
        review.insert_candidate(truth, methods, "t1", "m0")


def test_numbers_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    out = relational.renumbered(df, [F.col("k").asc()], "place")
    assert out.where("place <> k").count() == 0 and out.count() == 5000


def test_scores_of_projects_stay_apart(spark):
    schema = "project string, from_url string, to_url string, from_name string, to_name string, _ord long"
    one = [(p, f"t{i}", f"m{j}", f"testRun{i}", f"run{j}", i * 10 + j) for p in ("a", None) for i in range(3) for j in range(i + 1)]
    alone = [r for r in one if r[0] == "a"]
    columns = ["from_url", "to_url", *scoring.TECHNIQUES, "tech_lc"]
    both = scoring.score_candidates(spark.createDataFrame(one, schema))
    own = rows(scoring.score_candidates(spark.createDataFrame(alone, schema)), *columns)
    assert rows(both.where("project = 'a'"), *columns) == own
    assert rows(both.where("project IS NULL"), *columns) == own


def test_runs_of_a_model(spark):
    each = [("t1", [("c1", "a(int)"), ("c2", "b()")], "ok"), ("t2", [("c1", "a(int)")], "fail"), ("t3", [("c1", "a(int)")], "done")]
    cases = spark.createDataFrame(each, "from_url string, candidates array<struct<id:string,signature:string>>, prompt_text string")
    old = spark.createDataFrame([("t3", "done", "{}", None), ("t2", "error", None, "late")], model_runs.RUNS)
    assert rows(model_runs.open_cases(cases, old), "from_url") == [("t1",)]
    assert rows(model_runs.open_cases(cases, old, "error"), "from_url") == [("t1",), ("t2",)]
    assert model_runs.open_cases(cases, old, "none").count() == 3

    def provider(asked):
        if "fail" in asked:
            raise RuntimeError("no answer")
        return ['Sure. {"methods": [{"name": "B()", "confidence": 0.9}]}' for _ in asked]

    new = model_runs.run_cases(model_runs.open_cases(cases, old, "error"), provider, batch=1)
    merged = model_runs.merged_runs(old, new)
    assert rows(merged, "from_url", "status") == [("t1", "done"), ("t2", "error"), ("t3", "done")]
    urls = spark.createDataFrame([("t1", "c1", "ua"), ("t1", "c2", "ub"), ("t3", "c1", "uc")], "from_url string, candidate_id string, to_url string")
    found = rows(model_runs.predicted_links(cases, merged, urls), "from_url", "to_url", "prediction")
    assert found == [("t1", "ua", 0), ("t1", "ub", 1), ("t3", "uc", 0)]


def test_rules_from_configuration(spark):
    text = "defaults:\n  unitTestSourceRoots:\n    - checks\n  fixtureMethodAnnotations:\n    - a.b.Prepare\nproject:\n  testModulePatterns:\n    - '*-spec'\n"
    sections = config.parse_sections(text)
    rules = classification.merge_config(classification.DEFAULT_RULES, sections["defaults"], sections["project"], {"allSourceRootsInTestModuleAreTest": True})
    assert rules["unitTestSourceRoots"][0] == "src/test/java" and rules["unitTestSourceRoots"][-1] == "checks"
    files = spark.createDataFrame(
        [("p", "checks/A.java", "", [], None), ("p", "x-spec/src/main/java/B.java", "", [], None), ("p", "odd/com/acme/C.java", "com.acme", [], None),
         ("p", "app/src/test/java/com/acme/D.java", "com.acme", [], None), ("p", "lib/com/acme/E.java", "com.acme", ["RunWith"], None),
         ("p", "src/main/resources/f.txt", "", [], None)],
        "project string, file string, pkg string, class_annotations array<string>, superclass string",
    )
    modules = spark.createDataFrame([("p", ""), ("p", "x-spec")], "project string, module string")
    found = dict(rows(classification.classify_files(files, modules, rules), "file", "artifact"))
    assert found == {
        "checks/A.java": "#test-code", "x-spec/src/main/java/B.java": "#test-module #test-code", "odd/com/acme/C.java": "#main-code",
        "app/src/test/java/com/acme/D.java": "#test-code", "lib/com/acme/E.java": "#test-code", "src/main/resources/f.txt": "#main-resource",
    }
    methods = spark.createDataFrame(
        [("#test-code", ["a.b.Prepare"], "go", None, "X", 0, "int"), ("#test-code", [], "testIt", None, "AppTest", 0, "void"), ("#test-code", [], "testIt", "a.Base", "AppTest", 0, "void")],
        "file_artifact string, annotations array<string>, name string, superclass string, class_name string, parameters int, return_type string",
    )
    roles = [r["artifact"] for r in classification.method_roles(methods, rules).collect()]
    assert roles == ["#test-code #test-fixture-method", "#test-code #test-case-method", "#test-code #test-helper-method"]


def test_no_cap_on_copies_and_an_error_on_tools(spark):
    projects = spark.createDataFrame([("p",)], "project string")
    artifacts = spark.range(1500).select(F.col("id").cast("string").alias("artifact"))
    assert config.plan_copies(projects, artifacts, "a", "b").count() == 1500
    many = spark.range(config.MOST_TOOLS + 1).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("tool"))
    with pytest.raises(ValueError):
        config.project_index(projects, {}, many)


def test_rank_correlation_of_counted_pairs():
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randrange(4, 50)
        x, y = [draw.randrange(5) for _ in range(n)], [draw.randrange(4) for _ in range(n)]
        if len(set(x)) < 2 or len(set(y)) < 2:
            continue
        signs = [(x[i] - x[j]) * (y[i] - y[j]) for i in range(n) for j in range(i)]
        same = [sum(v[i] == v[j] for i in range(n) for j in range(i)) for v in (x, y)]
        wanted = (sum(s > 0 for s in signs) - sum(s < 0 for s in signs)) / math.sqrt((len(signs) - same[0]) * (len(signs) - same[1]))
        counted = Counter(zip(x, y))
        found = statistics.kendall_of_counts(*zip(*counted), list(counted.values()))
        assert found[0] == pytest.approx(wanted) and found == statistics.kendall(x, y)


def test_call_header_stands_in_its_order():
    assert len(schemas.CALL) == 36 == len(set(schemas.CALL))
    assert schemas.CALL[11:19] == (
        "from_fqs", "from_tctracer_fqs", "from_testlinker_fqs", "from_testlinker_fqp",
        "to_fqs", "to_tctracer_fqs", "to_testlinker_fqs", "to_testlinker_fqp",
    )
    assert {c for c in schemas.CALL if c.endswith(("start", "end", "lcba", "invocation", "depth"))} <= schemas.INTEGERS


def test_samples_and_small_steps(spark, tmp_path):
    population = spark.range(900).select(F.when(F.col("id") < 800, "a").otherwise("b").alias("project"), F.col("id").alias("url"))
    top = sampling.seeded_sample(population, ["url"], 10, 5)
    every = population.orderBy(F.md5(F.concat(F.lit("5|"), F.col("url").cast("string"))), "url").limit(10)
    assert rows(top, "url") == rows(every, "url")
    assert ingest.flush_due(10_000, 1) and ingest.flush_due(1, 901) and not ingest.flush_due(0, 9e9) and not ingest.flush_due(9, 9)
    names = spark.createDataFrame([("b",), ("A",), ("a",), ("C",)], "n string")
    assert [r["n"] for r in reporting.sort_any_case(names, ["n"]).collect()] == ["A", "a", "b", "C"]
    (tmp_path / "r.jsonl").write_text('{"test_id":"t","invocations":["x()","y()"],"recommended":["y()"],"truth":["x()"]}\n')
    assert rows(signatures.read_author_results(spark, str(tmp_path / "r.jsonl")), "signature", "label_pred", "label") == [("x()", 0, 1), ("y()", 1, 0)]
    code = spark.createDataFrame([("t1", "{}"), ("t2", " ")], "from_url string, code string")
    with pytest.raises(ValueError, match="1 tests"):
        signatures.with_bodies(code)
