"""Facts with validity: half-open intervals [valid_from, valid_to), a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31 00:00:00"


def _end(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(FAR).cast("timestamp_ntz"))


def at(facts: DataFrame, t: str) -> DataFrame:
    when = F.lit(t).cast("timestamp_ntz")
    return facts.filter((F.col("valid_from") <= when) & (when < _end("valid_to")))


def window(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Facts whose interval overlaps [start, end)."""
    return facts.filter((F.col("valid_from") < F.lit(end).cast("timestamp_ntz")) & (_end("valid_to") > F.lit(start).cast("timestamp_ntz")))


def diff(facts: DataFrame, t1: str, t2: str, key: list[str]) -> DataFrame:
    """Facts that hold at one of two times only, with ``change``."""
    a, b = at(facts, t1).select(key).distinct(), at(facts, t2).select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def allen(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The seven relations between the intervals of two sides, whose columns are prefixed ``a_`` and ``b_``."""
    s1, e1, s2, e2 = F.col(f"{a}_from"), _end(f"{a}_to"), F.col(f"{b}_from"), _end(f"{b}_to")
    return {
        "before": e1 < s2, "meets": e1 == s2, "overlaps": (s1 < s2) & (s2 < e1) & (e1 < e2), "during": (s2 < s1) & (e1 < e2),
        "starts": (s1 == s2) & (e1 < e2), "finishes": (e1 == e2) & (s1 > s2), "equals": (s1 == s2) & (e1 == e2),
    }


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width: str = "1 day") -> DataFrame:
    """Pairs of intervals that overlap, with equal ``on``: joined by the time buckets that both touch, each pair once.

    Columns a_from, a_to, b_from, b_to; an equi-join on (on, bucket) in place of a range join."""
    seconds = {"1 hour": 3600, "1 day": 86400, "7 days": 604800}[width]
    slot = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / seconds)
    spread = lambda d, x: d.withColumn("_slot", F.explode(F.sequence(slot(F.col(f"{x}_from")), slot(F.col(f"{x}_to")))))
    both = spread(a, "a").join(spread(b, "b"), [*on, "_slot"])
    overlap = (F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to"))
    return both.filter(overlap & (F.col("_slot") == slot(F.greatest("a_from", "b_from")))).drop("_slot")


def overlap_counts(intervals: DataFrame, on: list[str], width: str = "1 day") -> DataFrame:
    """(on, n): how many unordered pairs of half-open intervals (valid_from, valid_to) with equal ``on`` overlap, without making the pairs.

    A pair overlaps if one starts before the other ends and has not ended when it starts. So the number follows from the starts before each end
    and the ends up to each start: sums by time, running within a time slot, moved on by the sums of the slots before."""
    seconds = {"1 hour": 3600, "1 day": 86400, "7 days": 604800}[width]
    point = lambda c, s, e: F.struct(F.col(c).alias("t"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    empty = F.struct(F.col("valid_from").alias("t"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    full = F.col("valid_from") < F.col("valid_to")
    rows = intervals.select(*on, F.explode(F.array(point("valid_from", 1, 0), point("valid_to", 0, 1), empty)).alias("x"), full.alias("full"))
    mark = (F.col("x.s") == 0) & (F.col("x.e") == 0)
    at = rows.groupBy(*on, F.col("x.t").alias("t")).agg(F.sum("x.s").alias("s"), F.sum("x.e").alias("e"), F.count_if(mark & F.col("full")).alias("full"), F.count_if(mark & ~F.col("full")).alias("z"))
    at = at.withColumn("slot", F.floor(F.unix_timestamp(F.col("t").cast("timestamp")) / seconds))
    slots = at.groupBy(*on, "slot").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    before = Window.partitionBy(*on).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*on, "slot", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "se"])
    inner = Window.partitionBy(*on, "slot").orderBy("t")
    run = at.join(slots, [*on, "slot"]).select(
        *on, "s", "e", "full", "z", (F.col("s0") + F.sum("s").over(inner) - F.col("s")).alias("starts_before"), (F.col("e0") + F.sum("e").over(inner)).alias("ended"),
    )
    ordered = F.sum(F.col("e") * F.col("starts_before") - F.col("s") * F.col("ended") + F.col("z") * F.col("z")) - F.sum("full")
    return run.groupBy(*on).agg((ordered / 2).cast("long").alias("n"))


def versions(events: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """(key, value, valid_from, valid_to): each value holds until the next one of its key."""
    w = Window.partitionBy(*key).orderBy(time, value)
    return events.select(*key, value, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def consecutive(events: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Runs of an equal value in a row: (key, value, start, end, n)."""
    w = Window.partitionBy(*key).orderBy(time)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    runs = events.select(*key, time, value, new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run", value).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def followed(events: DataFrame, key: list[str], time: str, kind: str, first: str, then: str, within: str) -> DataFrame:
    """First ``first`` events that the key's next event follows as ``then`` within the interval."""
    w = Window.partitionBy(*key).orderBy(time)
    rows = events.select(*key, time, kind, F.lead(kind).over(w).alias("next_kind"), F.lead(time).over(w).alias("next_time"))
    return rows.filter((F.col(kind) == first) & (F.col("next_kind") == then) & (F.col("next_time") <= F.col(time) + F.expr(f"INTERVAL {within}"))).select(*key, time, "next_time")


def as_of(left: DataFrame, right: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """Each left row with the key's latest right row at or before its time: one union and one window instead of a range join."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*key, time, *columns).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col(time).alias("at"), *columns)), True).over(w).alias("_last")
    both = a.unionByName(b, allowMissingColumns=True).select("*", last).filter("_side = 1")
    return both.select(*[c for c in left.columns], F.col("_last.at").alias("matched_time"), *[F.col(f"_last.{c}").alias(c) for c in columns])
