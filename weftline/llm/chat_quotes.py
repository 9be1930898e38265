"""Chat formatting by quotation linking, with DataFrame operations only.

Every message is parsed into passages: runs of lines of one quote level (the number of ``>`` in
front).  Level 0 is the message's own text.  Own texts, their runs between quotes, their paragraphs
and their lines are normalised (white space collapsed, lower case) and hashed; quoted passages of
one conversation are joined to the earliest earlier message that holds the same passage.  Where a
whole passage has no match, its paragraphs are joined in the same way, and where none of them has
one, its lines; the latest message among the matches is the passage's.  A message replies to the
latest message among its outermost linked quotes, else among its deeper ones, else to the message
before it.

Messages come back without quotes, in reply order: a depth-first walk of the reply tree, replies
in order of their turns.  The walk needs no per-conversation list.  Messages that reply to the one
before them form segments; a walk passes a whole segment before the branches that leave it, and
takes later branching points first.  So a message's place is that of its segment and its own within
it.  The walk over segments is a linked list of entries and exits (two rows a segment), whose places
are found by list ranking: each round every element takes over the sum and the successor of its
successor, so rounds grow with the logarithm of the segments and rows with their number, whatever
the shape of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, saved, scratch_path

PREFIX = r"^(?:[ \t]*>)+[ \t]?"
PARAGRAPH = r"\n\s*\n"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def leveled_lines(text: Column) -> Column:
    """The lines of a text as an array of (level, content)."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.transform(
        lines, lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, PREFIX, "").alias("content"))
    )


def passages_of(lines: Column) -> Column:
    """Runs of lines of one level as an array of (level, content), each line read once or twice.

    ``lines`` must be a column of a table, not an expression, which every line would work out anew.
    """
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(starts, 2, F.size(lines)), F.array(F.size(lines)))
    return F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda run: F.struct(
            F.get(lines, run["start"])["level"].alias("level"),
            F.array_join(
                F.transform(F.slice(lines, run["start"] + 1, run["end"] - run["start"]), lambda x: x["content"]), "\n"
            ).alias("content"),
        ),
    )


#: Rows that one task numbers: conversations beyond it are numbered by several.
BLOCK = 4096


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: gapless places from 0 within each conv_id by ``order``.

    Rows are sorted by ranges of (conv_id, order), so a long conversation lies in several
    partitions; what each partition holds of a conversation is counted, and the counts before it
    are added.  Rows equal in all of this are dealt by a number of their own.
    """
    # The number stays the same when a task runs again, as the table behind ``rows`` is a file.
    own = F.monotonically_increasing_id()
    sort = [F.col("conv_id").asc_nulls_first(), *order, F.col("__own").asc()]
    spread = rows.withColumn("__own", own).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = saved(
        spread.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33))
        .drop("__own"),
        "sorted",
    )
    # One row for each conversation and partition.
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("conv_id", "__part")
        .agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__base", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .select(F.col("conv_id").alias("__conv"), F.col("__part").alias("__p"), "__first", "__base", "__rows")
    )
    # A conversation has as many rows here as it has partitions, so its rows stay spread.
    same = placed["conv_id"].eqNullSafe(parts["__conv"]) & (placed["__part"] == parts["__p"])
    joined = placed.join(parts, same)
    return joined.withColumn(name, F.col("__base") + F.col("__row") - F.col("__first")).drop(
        "__row", "__part", "__conv", "__p", "__first", "__base", "__rows"
    )


def last_so_far(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (conv_id, at) with ``name``: the greatest non-null ``value`` at or before each place.

    Blocks of BLOCK places are worked out by themselves and take over the greatest of those before.
    """
    blocks = rows.withColumn("__block", F.floor(F.col("at") / BLOCK)).withColumn("__value", value)
    so_far = Window.partitionBy("conv_id", "__block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        blocks.groupBy("conv_id", "__block")
        .agg(F.max("__value").alias("__top"))
        .select(F.col("conv_id").alias("__conv"), F.col("__block").alias("__b"), F.max("__top").over(before).alias("__before"))
        .where("__before IS NOT NULL")
    )
    within = blocks.withColumn("__within", F.max("__value").over(so_far))
    same = within["conv_id"].eqNullSafe(tops["__conv"]) & (within["__block"] == tops["__b"])
    return within.join(tops, same, "left").withColumn(name, F.greatest("__within", "__before")).drop(
        "__block", "__value", "__within", "__conv", "__b", "__before"
    )


def escaped(text: Column) -> Column:
    """A text whose own "<|" cannot be read as a mark of a block."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def own_text(passages: Column) -> Column:
    """A message without its quotes; blank lines at the ends go."""
    own = F.transform(F.filter(passages, lambda p: p["level"] == 0), lambda p: p["content"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, at, parent_at) for every message with a linked quote, from
    conv_id, at (place by turn), passages."""
    named = messages.select(
        "conv_id",
        "at",
        F.filter(F.col("passages"), lambda p: p["level"] > 0).alias("quotes"),
        own_text(F.col("passages")).alias("own"),
        F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["content"]).alias("runs"),
    )
    # Each quoted passage whole (0), by paragraph (1) and by line (2).
    cuts = F.array(
        F.struct(F.lit(0).alias("cut"), F.array(F.col("q.content")).alias("parts")),
        F.struct(F.lit(1).alias("cut"), F.split("q.content", PARAGRAPH).alias("parts")),
        F.struct(F.lit(2).alias("cut"), F.split("q.content", r"\n").alias("parts")),
    )
    quoted = (
        named.select("conv_id", "at", F.posexplode("quotes").alias("quote", "q"))
        .select("conv_id", "at", "quote", F.col("q.level").alias("level"), F.explode(cuts).alias("c"))
        .select("conv_id", "at", "quote", "level", F.col("c.cut").alias("cut"), F.explode("c.parts").alias("part"))
        .select("conv_id", "at", "quote", "level", "cut", normalised(F.col("part")).alias("passage"))
        .where("passage <> ''")
        .select("conv_id", "at", "quote", "level", "cut", F.sha2("passage", 256).alias("digest"))
    )
    units = F.array_union(
        F.array_union(F.array(F.col("own")), F.col("runs")),
        F.array_union(
            F.array_union(F.split("own", PARAGRAPH), F.flatten(F.transform("runs", lambda r: F.split(r, PARAGRAPH)))),
            F.split("own", r"\n"),
        ),
    )
    # One row for each passage of a conversation, summed up before it moves.
    originals = (
        named.select("conv_id", "at", F.explode(units).alias("passage"))
        .select("conv_id", "at", normalised(F.col("passage")).alias("passage"))
        .where("passage <> ''")
        .groupBy("conv_id", F.sha2("passage", 256).alias("digest"))
        .agg(F.min("at").alias("first_at"))
    )
    same = quoted["conv_id"].eqNullSafe(originals["conv_id"]) & (quoted["digest"] == originals["digest"])
    parts = quoted.join(originals, same & (originals["first_at"] < quoted["at"])).select(
        quoted["conv_id"], "at", "quote", "level", "cut", "first_at"
    )
    # The coarsest cut that matches speaks for the passage.
    linked = parts.groupBy("conv_id", "at", "quote", "level").agg(
        F.max_by("first_at", F.struct(-F.col("cut"), F.col("first_at"))).alias("first_at")
    )
    # Outermost quotes first, then the latest message.
    return linked.groupBy("conv_id", "at").agg(
        F.max_by("first_at", F.struct(-F.col("level"), F.col("first_at"))).alias("parent_at"),
        F.count(F.lit(1)).alias("n_linked"),
    )


def segment_places(segments: DataFrame) -> DataFrame:
    """(conv_id, segment, base): how many messages a walk passes before each segment.

    ``segments``: conv_id, segment (0 is the root of a conversation), parent_at, parent_segment (null
    for the root) and size (messages).
    """
    children = segments.where("parent_segment IS NOT NULL")
    order = [F.col("parent_segment").asc(), F.col("parent_at").desc(), F.col("segment").asc()]
    siblings = saved(numbered(children, order, "nth").select("conv_id", "segment", "parent_segment", "nth"), "siblings")
    firsts = siblings.groupBy(F.col("conv_id").alias("c"), F.col("parent_segment").alias("p")).agg(F.min_by("segment", "nth").alias("child"))
    after = siblings.select(
        F.col("conv_id").alias("c"), F.col("parent_segment").alias("p"), (F.col("nth") - 1).alias("n"), F.col("segment").alias("sibling")
    )
    # Element 2s enters segment s, 2s + 1 leaves it.
    enters = segments.join(firsts, segments["conv_id"].eqNullSafe(firsts["c"]) & (segments["segment"] == firsts["p"]), "left").select(
        "conv_id", (2 * F.col("segment")).alias("element"),
        F.coalesce(2 * F.col("child"), 2 * F.col("segment") + 1).alias("next"), F.col("size").alias("sum"),
    )
    same = siblings["conv_id"].eqNullSafe(after["c"]) & (siblings["parent_segment"] == after["p"]) & (siblings["nth"] == after["n"])
    leaves = siblings.join(after, same, "left").select(
        "conv_id", (2 * F.col("segment") + 1).alias("element"),
        F.coalesce(2 * F.col("sibling"), 2 * F.col("parent_segment") + 1).alias("next"), F.lit(0).cast("long").alias("sum"),
    )
    ends = segments.where("parent_segment IS NULL").select(
        "conv_id", (2 * F.col("segment") + 1).alias("element"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("sum")
    )
    spark = segments.sparkSession
    path = scratch_path(spark, "tour")
    tour = saved(enters.unionByName(leaves).unionByName(ends), "tour", path)
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select(
            F.col("conv_id").alias("c"), F.col("element").alias("e"), F.col("next").alias("further"), F.col("sum").alias("more")
        )
        joined = tour.join(ahead, tour["conv_id"].eqNullSafe(ahead["c"]) & (tour["next"] == ahead["e"]), "left")
        before, path = path, scratch_path(spark, "tour")
        tour = saved(
            joined.select("conv_id", "element", F.col("further").alias("next"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")),
            "tour", path,
        )
        discard(spark, before)
    # What follows an entry, itself included, is known; the rest of the conversation comes before it.
    totals = tour.where("element = 0").select(F.col("conv_id").alias("c"), F.col("sum").alias("total"))
    entered = tour.where("element % 2 = 0")
    return entered.join(totals, entered["conv_id"].eqNullSafe(totals["c"])).select(
        "conv_id", F.expr("element div 2").alias("segment"), (F.col("total") - F.col("sum")).alias("base")
    )


def link_conversations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a message: conv_id, turn, role, position, parent_position, max_level, n_quotes,
    n_linked, content, formatted.

    position runs from 0 in reply order within the conversation, parent_position is the position of
    the message replied to (null for the first); content is the text without quotes, formatted the
    content in a role-marked block, where "<|" of role or content is written "<\\|".  Messages are ordered by turn, then role and text (nulls first);
    repeated rows are messages of their own.  A null conv_id is a conversation like any other, a
    null text is empty, a null role is written "user".  An empty table gives an empty result; other
    columns play no part.
    """
    named = messages.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"),
    )
    turns = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("hash").asc()]
    parsed = saved(named.withColumn("lines", leveled_lines(F.col("text"))).withColumn("hash", F.xxhash64("text")).drop("text"), "lines")
    placed = numbered(parsed, turns, "at").withColumn("passages", passages_of(F.col("lines")))
    rows = saved(
        placed.select(
            "conv_id", "turn", "role", "at", "passages",
            F.array_max(F.transform("passages", lambda p: p["level"])).alias("max_level"),
            F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"),
        ),
        "messages",
    )
    links = saved(link_quotes(rows.select("conv_id", "at", "passages")), "reply-links")
    left, right = rows.drop("passages"), links.withColumnsRenamed({"conv_id": "c", "at": "a"})
    joined = left.join(right, left["conv_id"].eqNullSafe(right["c"]) & (left["at"] == right["a"]), "left").drop("c", "a")
    # A link to the message just before is the default, too.
    branch = F.col("parent_at").isNotNull() & (F.col("parent_at") < F.col("at") - 1)
    whole = last_so_far(joined, F.when(branch, F.col("at")), "segment")
    tree = saved(
        whole.withColumn("segment", F.coalesce("segment", F.lit(0).cast("long")))
        .withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
        .withColumn("parent_at", F.when(F.col("at") > 0, F.coalesce("parent_at", F.col("at") - 1))),
        "tree",
    )
    starts = tree.where("segment = at AND at > 0").select("conv_id", "segment", "parent_at")
    of = tree.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("segment").alias("parent_segment"))
    branches = starts.join(of, starts["conv_id"].eqNullSafe(of["c"]) & (starts["parent_at"] == of["a"])).drop("c", "a")
    branches = saved(branches, "branches")
    # Conversations with a branch; the others are walked in the order of their turns.
    branched = branches.select(F.col("conv_id").alias("c")).distinct()
    sizes = tree.join(branched, tree["conv_id"].eqNullSafe(branched["c"]), "left_semi").groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("size"))
    own = branches.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "parent_at", "parent_segment")
    segments = sizes.join(own, sizes["conv_id"].eqNullSafe(own["c"]) & (sizes["segment"] == own["s"]), "left").drop("c", "s")
    places = segment_places(saved(segments, "segments")).withColumnsRenamed({"conv_id": "c", "segment": "s"})
    based = tree.join(places, tree["conv_id"].eqNullSafe(places["c"]) & (tree["segment"] == places["s"]), "left").drop("c", "s")
    position = F.coalesce("base", F.lit(0).cast("long")) + F.col("at") - F.col("segment")
    walked = saved(based.withColumn("position", F.when(F.col("base").isNull(), F.col("at")).otherwise(position)).drop("base", "segment"), "walk")
    parents = walked.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("position").alias("parent_position"))
    found = walked.join(parents, walked["conv_id"].eqNullSafe(parents["c"]) & (walked["parent_at"] == parents["a"]), "left")
    found = found.drop("c", "a")
    texts = rows.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), own_text(F.col("passages")).alias("content"))
    full = found.join(texts, found["conv_id"].eqNullSafe(texts["c"]) & (found["at"] == texts["a"])).drop("c", "a")
    block = F.concat(
        F.lit("<|"), escaped(F.coalesce("role", F.lit("user"))), F.lit("|>\n"), escaped(F.col("content")), F.lit("\n<|end|>\n")
    )
    return full.select(
        "conv_id", "turn", "role", "position", "parent_position", "max_level", "n_quotes", "n_linked", "content",
        block.alias("formatted"),
    )


def formatted_conversations(linked: DataFrame) -> DataFrame:
    """(conv_id, messages, chat): the blocks of each conversation joined in reply order.

    Meant for conversations that fit one row; the message table has no such bound.
    """
    blocks = F.array_sort(F.collect_list(F.struct("position", "formatted")))
    return linked.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.array_join(F.transform(blocks, lambda b: b["formatted"]), "").alias("chat"),
    )


def query(conversations: DataFrame) -> DataFrame:
    return link_conversations(conversations)
