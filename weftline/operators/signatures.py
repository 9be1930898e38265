"""Mapping of model output onto signatures, URLs and labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text
from weftline.functions.strings import common_substring
from weftline.operators.relational import ORD, join_few, keep_first
from weftline.session import cut_lineage

# Parameter types that match anything.
WILDCARDS = ("Object", "T", "E", "K", "V", "?", "null")
BEST_SCORE = 0.5


def parameter_scores(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Score of each (declared, given) parameter type: equal 1.2, related by inheritance 1.1, wildcard 1.0,
    else the longest common substring over the longer name. closure: child, ancestor."""
    a, b = text.simple_type(F.col("declared")), text.simple_type(F.col("given"))
    rows = pairs.withColumns({"__a": a, "__b": b})
    related = closure.select(F.col("child").alias("__a"), F.col("ancestor").alias("__b"))
    related = related.unionByName(closure.select(F.col("ancestor").alias("__a"), F.col("child").alias("__b"))).distinct()
    rows = rows.join(related.withColumn("__rel", F.lit(1)), ["__a", "__b"], "left")
    longest = F.greatest(F.length("__a"), F.length("__b"))
    part = F.when(longest > 0, common_substring(F.col("__a"), F.col("__b")) / longest).otherwise(F.lit(0.0))
    wild = F.col("__a").isin(*WILDCARDS) | F.col("__b").isin(*WILDCARDS)
    score = F.when(F.col("__a") == F.col("__b"), 1.2).when(wild, 1.0).when(F.col("__rel") == 1, 1.1).otherwise(part)
    return rows.withColumn("score", score).drop("__a", "__b", "__rel")


def signature_scores(calls: DataFrame, declared: DataFrame, closure: DataFrame) -> DataFrame:
    """(call_id, signature, score) for declarations of the call's name and arity; 0.6 without parameters.

    calls: call_id, name, params; declared: name, signature, params.
    """
    same = calls.select("call_id", "name", "params").join(declared.withColumnRenamed("params", "__declared"), "name")
    same = same.where(F.size("params") == F.size("__declared"))
    none = same.where(F.size("params") == 0).select("call_id", "signature", F.lit(0.6).alias("score"))
    zipped = F.posexplode(F.arrays_zip(F.col("__declared").alias("declared"), F.col("params").alias("given")))
    each = same.select("call_id", "signature", zipped.alias("__i", "__p")).select("call_id", "signature", "__p.declared", "__p.given")
    scored = parameter_scores(each, closure).groupBy("call_id", "signature").agg(F.avg("score").alias("score"))
    return none.unionByName(scored)


def best_signatures(scores: DataFrame, least: float = BEST_SCORE) -> DataFrame:
    """All signatures of the top score beyond ``least``; ties stay."""
    order = Window.partitionBy("call_id").orderBy(F.desc("score"))
    return scores.withColumn("__rank", F.rank().over(order)).where((F.col("__rank") == 1) & (F.col("score") > least)).drop("__rank")


def mapped_signatures(calls: DataFrame, best: DataFrame) -> DataFrame:
    """Best signatures of every call, itself where there is none. calls: call_id, signature."""
    own = calls.select("call_id", F.col("signature").alias("__own"))
    return own.join(best.select("call_id", "signature"), "call_id", "left").select(
        "call_id", F.coalesce("signature", "__own").alias("signature")
    )


#: Methods up to which tasks hold the URL lists of all signatures; URLs written by one task, URLs merged at once,
#: and calls that share a row of merged URLs.
LISTED_METHODS, URLS_OF_TASK, URLS_OF_BATCH, CALLS_OF_ROW = 4_000_000, 50_000_000, 2_000_000, 5_000


def signatures_to_urls(mapped: DataFrame, methods: DataFrame, joined: str | None = None) -> DataFrame:
    """(call_id, urls): distinct URLs of the mapped signatures, in file order. methods: signature, url, _ord.

    The URLs of a signature are listed once, and lists are merged once for all calls of the same
    signatures; what is shuffled are signatures and calls, not URLs.  Beyond LISTED_METHODS the lists
    of each set of signatures are shuffled.  ``joined`` is put between the URLs, which are then one text.
    """
    once = cut_lineage(methods.groupBy("signature", "url").agg(F.min(ORD).alias("o")))
    sizes = once.groupBy("signature").agg(F.count(F.lit(1)).alias("__size"))
    known = join_few(mapped.select("call_id", "signature"), sizes.select("signature"), ["signature"], "left_semi")
    sets = known.groupBy("call_id").agg(F.sort_array(F.collect_set("signature")).alias("__set"))
    calls = cut_lineage(sets.groupBy("__set").agg(F.count(F.lit(1)).alias("__calls")))
    total = calls.select("__calls", F.explode("__set").alias("signature")).join(sizes, "signature")
    tasks = 1 + (total.agg(F.sum(F.col("__calls") * F.col("__size"))).first()[0] or 0) // URLS_OF_TASK
    crowds = calls.where(F.col("__calls") > CALLS_OF_ROW).select("__set", F.ceil(F.col("__calls") / CALLS_OF_ROW).alias("__parts"))
    part = F.pmod(F.xxhash64("call_id"), F.coalesce("__parts", F.lit(1)))
    dealt = join_few(sets, crowds, ["__set"], "left").select("__set", part.alias("__part"), F.struct("call_id").alias("__call"))
    rows = dealt.repartition(tasks, "__set", "__part").groupBy("__set", "__part").agg(F.collect_list("__call").alias("__calls"))
    if once.limit(LISTED_METHODS + 1).count() <= LISTED_METHODS:
        lists = mapped.sparkSession.sparkContext.broadcast(_lists(once.orderBy("o", "url").select("signature", "url").toArrow()))
        kind = T.ArrayType(T.StringType()) if joined is None else T.StringType()
        rows = rows.mapInArrow(_merging(lists, joined), rows.select("__calls").schema.add("urls", kind))
    else:
        lists = once.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("o", "url"))).alias("__l"))
        every = calls.select("__set", F.explode("__set").alias("signature")).join(lists, "signature").groupBy("__set")
        urls = F.array_distinct(F.sort_array(F.flatten(F.collect_list("__l")))["url"])
        rows = rows.join(every.agg((urls if joined is None else F.array_join(urls, joined)).alias("urls")), "__set")
    return rows.select(F.explode("__calls").alias("__call"), "urls").select("__call.call_id", "urls")


def _lists(rows: pa.Table) -> tuple:
    """URLs in order, their numbers if some occur twice, and for each signature the places of its URLs."""
    names = rows["url"].combine_chunks()
    signatures = rows["signature"].combine_chunks().dictionary_encode()
    codes = names.dictionary_encode(null_encoding="encode")
    owner = signatures.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(signatures.dictionary) + 1))
    places = {s: order[ends[i] : ends[i + 1]].astype(np.int32) for i, s in enumerate(signatures.dictionary.to_pylist())}
    return names, codes.indices.to_numpy(zero_copy_only=False) if len(codes.dictionary) < len(names) else None, places


def _merging(lists, joined: str | None):
    """Of batches of sets of signatures and their calls: the calls and the merged URLs."""

    def merged(names: pa.Array, codes, found: list) -> pa.Array:
        kept = []
        for places in found:
            places = np.sort(np.concatenate(places))
            if codes is not None:
                places = places[np.sort(np.unique(codes[places], return_index=True)[1])]
            if joined is not None and names.null_count:
                places = places[names.take(pa.array(places)).is_valid().to_numpy(zero_copy_only=False)]
            kept.append(places)
        ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
        urls = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(kept))))
        return urls if joined is None else pc.binary_join(urls, joined)

    def run(batches):
        names, codes, places = lists.value
        for batch in batches:
            sets, calls = batch.column("__set").to_pylist(), batch.column("__calls")
            begin, held, found = 0, 0, []
            for i, signatures in enumerate(sets, 1):
                found.append([places[s] for s in signatures])
                held += sum(map(len, found[-1]))
                if held >= URLS_OF_BATCH or i == len(sets):
                    yield pa.RecordBatch.from_arrays([calls.slice(begin, i - begin), merged(names, codes, found)], ["__calls", "urls"])
                    begin, held, found = i, 0, []

    return run


def invocations_of(tests: DataFrame) -> DataFrame:
    """Author results: one row a test's invocation with order, rank and label flags.

    tests: test_id, invocations, recommended, truth (arrays of signatures).
    """
    rows = tests.select("test_id", "recommended", "truth", F.posexplode("invocations").alias("place", "signature"))
    rank = F.array_position("recommended", F.col("signature"))
    return rows.select(
        "test_id", "place", "signature", F.when(rank > 0, rank).alias("rank"),
        (rank > 0).cast("int").alias("label_pred"), F.array_contains("truth", F.col("signature")).cast("int").alias("label"),
    )


# Fields of a line of author results.
AUTHOR_RESULT = "test_id string, invocations array<string>, recommended array<string>, truth array<string>"


def read_author_results(spark, path: str) -> DataFrame:
    """Author results from JSON lines, one row a test's invocation."""
    return invocations_of(spark.read.schema(AUTHOR_RESULT).json(path))


def with_bodies(rows: DataFrame, code: str = "code", test: str = "from_url") -> DataFrame:
    """``rows`` as they are; an error, with how many, if tests have a blank body."""
    blank = rows.where(F.trim(text.blank(F.col(code))) == "").select(test).distinct().count()
    if blank:
        raise ValueError(f"{blank} tests have no body")
    return rows


def label_lookup(truth: DataFrame) -> DataFrame:
    """Per test the positive URLs and the distinct signatures in order."""
    positive = F.when(text.number(F.col("label").cast("string")) == 1, F.col("to_url"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ORD, F.col("to_fqs").alias("s")))), lambda x: x["s"])
    return truth.groupBy("from_url").agg(
        F.array_sort(F.collect_set(positive)).alias("urls"), F.array_distinct(ordered).alias("signatures")
    )


def class_maps(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name -> distinct parents in order, name -> qualified names)."""
    split = F.filter(F.split(text.blank(F.col("parent_names")), r"\|"), lambda p: p != "")
    rows = classes.select("name", ORD, F.posexplode_outer(split).alias("__i", "parent"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ORD, "__i", "parent"))), lambda x: x["parent"])
    parents = rows.groupBy("name").agg(F.array_distinct(F.filter(ordered, lambda p: p.isNotNull())).alias("parents"))
    return parents, classes.groupBy("name").agg(F.array_sort(F.collect_set("fqn")).alias("fqns"))


def function_map(methods: DataFrame) -> DataFrame:
    """name -> class -> distinct parameter lists, in file order."""
    lists = methods.groupBy("name", "fqn", "testlinker_fqp").agg(F.min(ORD).alias("__o"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__o", "testlinker_fqp"))), lambda x: x["testlinker_fqp"])
    a_class = lists.groupBy("name", "fqn").agg(ordered.alias("lists"))
    entries = F.array_sort(F.collect_list(F.struct("fqn", "lists")))
    return a_class.groupBy("name").agg(F.map_from_entries(entries).alias("classes"))


def prefixes(calls: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Prefixes under which a call's class may be declared: itself, as a constructor, or by its simple name.

    calls: call_id, prefix, name; known: prefix; classes: name, fqn.
    """
    exact = calls.join(known, "prefix", "left_semi").select("call_id", "prefix")
    built = calls.select("call_id", F.concat_ws(".", "prefix", "name").alias("prefix")).join(known, "prefix", "left_semi")
    simple = calls.select("call_id", F.substring_index("prefix", ".", -1).alias("__n")).join(
        classes.select(F.col("name").alias("__n"), F.col("fqn").alias("prefix")), "__n"
    )
    return exact.unionByName(built.select("call_id", "prefix")).unionByName(simple.select("call_id", "prefix")).distinct()


def candidate_ids(named: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate that a model's name means: equal once normalised, else the only one it begins.

    named: case_id, name; candidates: case_id, candidate_id, signature.
    """
    norm = lambda c: F.lower(F.regexp_replace(text.blank(F.col(c)), r"\s+", ""))
    pairs = named.withColumn("__n", norm("name")).join(candidates.withColumn("__s", norm("signature")), "case_id")
    equal = F.col("__n") == F.col("__s")
    begins = F.startswith(F.col("__s"), F.col("__n")) & (F.col("__n") != "")
    each = Window.partitionBy("case_id", "name")
    marked = pairs.withColumns({"__eq": equal.cast("int"), "__pre": begins.cast("int")}).withColumns(
        {"__any": F.max("__eq").over(each), "__pres": F.sum("__pre").over(each)}
    )
    return marked.where("(__any = 1 AND __eq = 1) OR (__any = 0 AND __pre = 1 AND __pres = 1)").select("case_id", "name", "candidate_id")


def best_confidence(methods: DataFrame, keys: Sequence[str] = ("case_id", "method")) -> DataFrame:
    """The most confident entry of each name; a later one wins ties."""
    return keep_first(methods, keys, [F.desc_nulls_last("confidence"), F.desc(ORD)])


def llm_schema() -> str:
    return "methods array<struct<method:string,confidence:double,rationale:string>>"


def project_links(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates with the confidence and label that a stored run gives to their name.

    runs: url, output_json, error; rows with an error or unreadable JSON count as missing.
    """
    fine = runs.where(text.blank(F.col("error")) == "").select(
        F.col("url").alias("from_url"), F.from_json("output_json", llm_schema()).alias("__j")
    )
    named = fine.select("from_url", F.posexplode("__j.methods").alias(ORD, "__m")).select(
        "from_url", ORD, F.col("__m.method").alias("to_name"), F.col("__m.confidence").alias("confidence")
    )
    best = best_confidence(named, ["from_url", "to_name"]).drop(ORD)
    out = candidates.join(best, ["from_url", "to_name"], "left")
    return out.withColumn("label", F.col("confidence").isNotNull().cast("int"))


def stored_predictions(runs: DataFrame) -> DataFrame:
    """url, max_confidence, names of readable runs without an error."""
    rows = runs.where(text.blank(F.col("error")) == "").withColumn("__j", F.from_json("output_json", llm_schema()))
    rows = rows.where("__j.methods IS NOT NULL")
    return rows.select(
        "url", F.array_max(F.transform("__j.methods", lambda m: m["confidence"])).alias("max_confidence"),
        F.array_join(F.transform("__j.methods", lambda m: m["method"]), "|").alias("names"),
    )


def mark_matches(rows: DataFrame, predictions: DataFrame, case: str = "case_id") -> DataFrame:
    """match: 1 if a row's name, signature or URL is among its case's predictions (``a|b``)."""
    found = rows.join(predictions.select(case, "predicted"), case, "left")
    names = F.split(text.blank(F.col("predicted")), r"\|")
    hit = F.array_contains(names, F.col("to_name")) | F.array_contains(names, F.col("to_fqs")) | F.array_contains(names, F.col("to_url"))
    return found.withColumn("match", F.coalesce(hit, F.lit(False)).cast("int")).drop("predicted")


def prompt_cases(edges: DataFrame, code: DataFrame) -> DataFrame:
    """Per source: its code and the distinct candidates c1..cn in file order, as one JSON prompt."""
    first = edges.groupBy("from_url", "to_url").agg(F.min(ORD).alias("__o"), F.min_by("to_fqs", ORD).alias("signature"))
    place = F.row_number().over(Window.partitionBy("from_url").orderBy("__o"))
    numbered = first.withColumn("candidate_id", F.concat(F.lit("c"), place.cast("string")))
    items = F.array_sort(F.collect_list(F.struct("__o", "candidate_id", "to_url", "signature")))
    cases = numbered.groupBy("from_url").agg(F.transform(items, lambda x: F.struct(x["candidate_id"].alias("id"), x["signature"].alias("signature"))).alias("candidates"))
    full = cases.join(code.select(F.col("url").alias("from_url"), "code"), "from_url", "left")
    return full.withColumn("prompt_text", F.to_json(F.struct(F.coalesce("code", F.lit("")).alias("test"), "candidates")))


def linker_input(candidates: DataFrame, code: DataFrame) -> DataFrame:
    """Per test its distinct (signature, URL) rows with body and parameters; a test without body is an error."""
    rows = keep_first(candidates, ["from_url", "to_url"])
    body = code.select(F.col("url").alias("from_url"), text.code_body(F.col("code")).alias("body"))
    full = rows.join(body, "from_url", "left")
    fine = F.when(F.trim(text.blank(F.col("body"))) != "", F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("no body for "), F.col("from_url")))
    )
    signature = text.linker_signature(F.col("to_fqs"))
    return full.withColumns({"body": fine, "to_testlinker_fqs": signature, "to_testlinker_p": F.to_json(text.parameter_list(F.col("to_fqs")))})


def softmax_positive(a: Column, b: Column) -> Column:
    """Probability of the second of two logits."""
    return 1 / (1 + F.exp(a - b))
