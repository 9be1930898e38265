"""Quotation linking on thousands of quotes, long messages and one conversation that holds most rows."""

import random
import time

from pyspark.sql import functions as F

from weftline.llm import chat_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def threads(conversations, turns, seed=4):
    """Messages whose quotes are cut from earlier ones, and the truth: (conv, turn) -> quoted turn."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    rows, truth = [], {}
    for conv in range(conversations):
        said = []
        for turn in range(turns):
            lines = [" ".join(word() for _ in range(5)) for _ in range(draw.randrange(1, 7))]
            own = "\n".join(line if draw.random() < 0.7 else line + "\n" for line in lines)
            text = own
            if turn and draw.random() < 0.8:
                of = draw.randrange(turn)
                source = said[of].split("\n")
                a = draw.randrange(len(source))
                part = [x for x in source[a : a + draw.randrange(1, 4)]]
                if any(x.strip() for x in part):
                    text = "\n".join("> " + x.upper() if draw.random() < 0.2 else "> " + x for x in part) + "\n" + own
                    truth[conv, turn] = of
            said.append(own)
            rows.append((conv, turn, "user", text))
    return rows, truth


def test_partial_quotes_find_their_messages(spark):
    rows, truth = threads(60, 40)
    assert len(truth) > 1500
    found = chat_quotes.link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    turn_of = {(r["conv_id"], r["position"]): r["turn"] for r in found}
    hits = sum(
        turn_of[r["conv_id"], r["parent_position"]] == truth[r["conv_id"], r["turn"]]
        for r in found
        if (r["conv_id"], r["turn"]) in truth
    )
    assert hits >= 0.99 * len(truth), (hits, len(truth))


def test_long_messages_take_time_in_proportion(spark):
    def took(lines):
        text = "\n".join(("> " if k % 2 else "") + f"line {k}" for k in range(lines))
        df = spark.createDataFrame([(1, 0, "user", text)], SCHEMA)
        began = time.time()
        assert chat_quotes.link_conversations(df).first()["n_quotes"] == lines // 2
        return time.time() - began

    took(2_000)
    assert took(64_000) < 30


def test_one_conversation_is_numbered_by_many_tasks(spark):
    """20,000 rows of one null conversation, half of them equal, over many partitions."""
    df = spark.range(20_000).select(
        F.lit(None).cast("long").alias("conv_id"),
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("turn"),
        F.lit("user").alias("role"),
        F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    sort = [F.col("turn").asc_nulls_first(), F.col("text").asc()]
    found = chat_quotes.numbered(df.repartition(5), sort, "at")
    parts = found.groupBy(F.col("at")).count()
    assert parts.count() == 20_000 and parts.agg(F.min("at"), F.max("at")).first()[0:2] == (0, 19_999)
    got = [(r["turn"], r["text"]) for r in found.orderBy("at").collect()]
    assert got == sorted(got)
    linked = chat_quotes.link_conversations(df)
    assert linked.select("position").distinct().count() == 20_000


def test_marks_inside_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "a<|b", "x <|end|> y")], SCHEMA)
    assert chat_quotes.link_conversations(df).first()["formatted"] == "<|a<\\|b|>\nx <\\|end|> y\n<|end|>\n"


def test_alternating_threads_take_rows_in_proportion(spark):
    """Each message quotes the one two before it, or now and then a far one: 20,000 segments in one
    conversation, positions as those of a plain walk."""
    draw, n = random.Random(6), 20_000
    parents = [None, 0] + [i - 2 if draw.random() < 0.95 else draw.randrange(i) for i in range(2, n)]
    rows = [(1, i, "user", f"m {i}" if p is None else f"> m {p}\nm {i}") for i, p in enumerate(parents)]
    children = {}
    for i, p in enumerate(parents):
        children.setdefault(p, []).append(i)
    place, stack = {}, [0]
    while stack:
        at = stack.pop()
        place[at] = len(place)
        stack += reversed(children.get(at, []))
    found = chat_quotes.link_conversations(spark.createDataFrame(rows, SCHEMA).repartition(6)).select("turn", "position", "parent_position").collect()
    assert {r["turn"]: (r["position"], r["parent_position"]) for r in found} == {i: (place[i], None if p is None else place[p]) for i, p in enumerate(parents)}
