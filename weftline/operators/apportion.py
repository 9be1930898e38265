"""Apportionment: largest remainders with floors and caps, top-ups, and samples for review.

Shares go by windows and one-row totals, whatever the number of groups; nothing is held by the
driver.  Units beyond the floors go round in an order, one a round to each row that still has room.
Full rounds need no loop: after R rounds a row has min(room, R), so R follows from the histogram of
rooms (the water level), and only the last, partial round needs the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.evaluation import PAIR
from weftline.operators.relational import ORD, carry_values, keep_first, renumbered
from weftline.operators.sampling import draw, sample_size_column
from weftline.session import cut_lineage


def dealt_round(rows: DataFrame, room: str, amount: str, order: Sequence[Column], name: str = "units") -> DataFrame:
    """``rows`` with ``name``: how many of ``amount`` units (one value for all rows) each gets when they
    go round in ``order``, to a row at most its ``room``.

    The histogram of rooms has at most as many rows as the root of twice their sum.
    """
    levels = rows.groupBy(F.col(room).alias("__c")).agg(F.count(F.lit(1)).alias("__n"), F.max(amount).alias("__amount"))
    below = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("__c").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lower = F.coalesce(F.sum(F.col("__c") * F.col("__n")).over(below), F.lit(0))
    levels = levels.select("__c", "__n", "__amount", lower.alias("__lower"), F.sum("__n").over(from_here).alias("__upper"))
    # What R = c full rounds take; the level lies above the last c whose rounds can be paid.
    paid = F.col("__lower") + F.col("__c") * F.col("__upper")
    open_ = F.col("__upper") - F.col("__n")
    rest = F.col("__amount") - paid
    level = F.col("__c") + F.when(open_ > 0, F.floor(rest / open_)).otherwise(0)
    left = F.when(open_ > 0, rest % open_).otherwise(0)
    # Below the least room every row is open.
    first = F.struct(F.lit(-1).cast("long").alias("__c"), F.floor(F.min("__amount") / F.sum("__n")).alias("__level"), (F.min("__amount") % F.sum("__n")).alias("__left"))
    reached = levels.where(paid <= F.col("__amount")).agg(
        F.max(F.struct("__c", level.cast("long").alias("__level"), left.cast("long").alias("__left"))).alias("__at")
    )
    base = levels.agg(first.alias("__from_zero"))
    level_row = base.crossJoin(reached).select(F.coalesce("__at", "__from_zero").alias("__at")).select("__at.__level", "__at.__left")  # one row each
    marked = rows.crossJoin(F.broadcast(level_row))
    open_rows = renumbered(marked.where(F.col(room) > F.col("__level")), order, "__place")
    full = marked.where(F.col(room) <= F.col("__level")).withColumn(name, F.col(room))
    extra = open_rows.withColumn(name, F.col("__level") + F.when(F.col("__place") < F.col("__left"), 1).otherwise(0)).drop("__place")
    return full.unionByName(extra).drop("__level", "__left")


def allocate(groups: DataFrame, target: Column, name: str = "group", size: str = "size") -> DataFrame:
    """``groups`` with share: ``target`` (a column with one value, such as a literal) in proportion.

    A share is the floor of the exact quota, at least 1 where the target covers all groups that
    have anything, and never above the size.  What is missing goes round by the largest remainder
    (ties: larger size, then later name); what the floors of 1 took too much comes back by the
    smallest remainder (ties: smaller size, then earlier name).  A group without size gets 0.
    """
    # One row a group from here on; each step needs it twice or more.
    groups = cut_lineage(groups.withColumn("__asked", target.cast("long")))
    rows = groups
    rows = rows.withColumn("__size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    totals = rows.agg(F.sum("__size").alias("__total"), F.count_if(F.col("__size") > 0).alias("__groups"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    goal = F.least(F.greatest("__asked", F.lit(0)), F.coalesce("__total", F.lit(0)))
    quota = F.try_divide((F.col("__goal") * F.col("__size")).cast("double"), F.col("__total").cast("double"))
    floor = F.when((F.col("__size") == 0) | (F.col("__goal") == 0), 0).otherwise(
        F.least("__size", F.greatest("__least", F.floor("__quota")))
    )
    rows = (
        rows.withColumn("__goal", goal)
        .withColumn("__least", F.when(F.col("__goal") >= F.col("__groups"), 1).otherwise(0))
        .withColumn("__quota", F.coalesce(quota, F.lit(0.0)))
        .withColumn("__floor", floor.cast("long"))
    )
    rows = cut_lineage(rows)
    given = rows.agg(F.sum("__floor").alias("__given"))
    rows = rows.crossJoin(F.broadcast(given)).withColumn("__gap", F.col("__goal") - F.col("__given"))  # one row
    up = F.col("__gap") > 0
    room = F.when(F.col("__floor") + F.col("__size") == 0, 0).when(up, F.col("__size") - F.col("__floor")).otherwise(
        F.greatest(F.col("__floor") - F.col("__least"), F.lit(0))
    )
    rows = rows.withColumn("__room", room.cast("long")).withColumn("__amount", F.abs("__gap"))
    sign = F.when(up, -1).otherwise(1)
    remainder = F.col("__quota") - F.floor("__quota")
    order = [
        (sign * remainder).asc(), (sign * F.col("__size")).asc(), F.when(up, F.col(name)).desc_nulls_last(),
        F.when(~up, F.col(name)).asc_nulls_last(),
    ]
    dealt = dealt_round(cut_lineage(rows), "__room", "__amount", order, "__units")
    share = F.col("__floor") + F.when(F.col("__gap") > 0, F.col("__units")).otherwise(-F.col("__units"))
    return dealt.withColumn("share", share.cast("long")).select(*[c for c in groups.columns if c != "__asked"], "share")


def top_up(groups: DataFrame, total: Column, name: str = "group") -> DataFrame:
    """``groups`` (share, existing, capacity) with more: what each still needs.

    A group lacks its share less what exists, within its capacity.  If all that fits into what is
    missing from ``total`` it is given, else that is shared out in proportion to what they lack.
    """
    groups = cut_lineage(groups)
    lack = F.least(F.col("capacity"), F.greatest(F.col("share") - F.col("existing"), F.lit(0))).cast("long")
    rows = groups.withColumn("__lack", lack).withColumn("__whole", total.cast("long"))
    totals = rows.agg(F.sum("__lack").alias("__lacks"), F.greatest(F.max("__whole") - F.sum("existing"), F.lit(0)).alias("__open"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    # With enough for all, the goal is capped by the sum of what they lack: every group gets it.
    shared = allocate(rows.drop("share"), F.col("__open"), name, "__lack")
    more = F.when(F.col("__lacks") <= F.col("__open"), F.col("__lack")).otherwise(F.col("__given_more"))
    return (
        groups.join(shared.select(F.col(name).alias("__name"), "__lack", "__lacks", "__open", F.col("share").alias("__given_more")), groups[name].eqNullSafe(F.col("__name")))
        .withColumn("more", more).drop("__name", "__lack", "__lacks", "__open", "__given_more")
    )


REVIEW = ("label", "tags", "notes")


def review_sample(
    population: DataFrame, seed: int, existing: DataFrame | None = None, confidence: float = 0.95, margin: float = 0.05,
    keys: Sequence[str] = PAIR, by: str = "project",
) -> DataFrame:
    """The rows of ``population``, each key once (its first row), with label, tags, notes and sampled.

    The sample's size follows from all rows (Cochran), the groups' shares from theirs.  Rows that
    an ``existing`` review has keep its label, tags and notes, and stay sampled; the groups are topped
    up by a seeded draw among their other rows.
    """
    rows = keep_first(population, list(keys)).drop(*[c for c in (*REVIEW, "sampled") if c in population.columns])
    rows = rows.withColumns({c: F.lit("") for c in REVIEW})
    rows = rows.withColumn("__was", F.lit(False))
    if existing is not None:
        old = keep_first(existing, list(keys))
        rows = carry_values(rows, old, list(keys), REVIEW)
        was = old.where(F.trim(F.col("sampled").cast("string")).isin("1", "true", "True")).select(*keys).withColumn("__is", F.lit(True))
        rows = rows.drop("__was").join(was, list(keys), "left").withColumn("__was", F.coalesce("__is", F.lit(False))).drop("__is")
    groups = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.count_if("__was").alias("existing"))
    whole = groups.agg(F.sum("size").alias("__n")).select(sample_size_column(F.col("__n"), confidence, margin).alias("__goal_of_all"))
    groups = groups.crossJoin(F.broadcast(whole))  # one row
    groups = allocate(groups, F.col("__goal_of_all"), by).withColumn("capacity", F.col("size") - F.col("existing"))
    more = top_up(groups, F.col("__goal_of_all"), by).select(F.col(by).alias("__by"), "more")
    place = Window.partitionBy(by, "__was").orderBy(draw(seed, *keys), *keys)
    drawn = rows.withColumn("__nth", F.row_number().over(place)).join(more, rows[by].eqNullSafe(F.col("__by")))
    sampled = F.when(F.col("__was") | (F.col("__nth") <= F.col("more")), "1").otherwise("0")
    return drawn.withColumn("sampled", sampled).drop("__was", "__nth", "__by", "more")
