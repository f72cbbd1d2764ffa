"""Facts with validity in queries: a user's last event type holds until the next event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from .registry import query, read

_V = "v AS (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS valid_to FROM events)"


def _versions(spark, d):
    return T.versions(read(spark, d, "events"), ["user_id"], "ts", "event_type")


@query(f"WITH {_V} SELECT user_id, event_type FROM v WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')")
def temporal_at(spark, d):
    return T.at(_versions(spark, d), "2024-01-15 12:00:00").select("user_id", "event_type")


@query(f"WITH {_V} SELECT event_type, count(*) AS n FROM v WHERE valid_from < TIMESTAMP '2024-01-11' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10') GROUP BY 1")
def temporal_window(spark, d):
    return T.window(_versions(spark, d), "2024-01-10 00:00:00", "2024-01-11 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_AT = "SELECT DISTINCT user_id, event_type FROM v WHERE valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}')"


@query(f"WITH {_V}, a AS ({_AT.format('2024-01-10')}), b AS ({_AT.format('2024-01-20')}) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def temporal_diff(spark, d):
    return T.diff(_versions(spark, d), "2024-01-10 00:00:00", "2024-01-20 00:00:00", ["user_id", "event_type"])


@query(f"""WITH {_V}, i AS (SELECT user_id, event_type, valid_from AS f, valid_to AS t FROM v WHERE valid_to IS NOT NULL), j AS (SELECT a.f AS f1, a.t AS t1, b.f AS f2, b.t AS t2 FROM i a JOIN i b ON a.user_id = b.user_id - 1 AND a.event_type = b.event_type)
SELECT count(*) FILTER (t1 < f2) AS before, count(*) FILTER (t1 = f2) AS meets, count(*) FILTER (f1 < f2 AND f2 < t1 AND t1 < t2) AS overlaps, count(*) FILTER (f2 < f1 AND t1 < t2) AS during, count(*) FILTER (f1 = f2 AND t1 < t2) AS starts, count(*) FILTER (t1 = t2 AND f1 > f2) AS finishes, count(*) FILTER (f1 = f2 AND t1 = t2) AS equals FROM j""")
def allen_relations(spark, d):
    i = _versions(spark, d).filter("valid_to IS NOT NULL")
    a = i.select(F.col("user_id").alias("u"), "event_type", F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to"))
    b = i.select((F.col("user_id") - 1).alias("u"), "event_type", F.col("valid_from").alias("b_from"), F.col("valid_to").alias("b_to"))
    return a.join(b, ["u", "event_type"]).agg(*[F.count_if(c).alias(name) for name, c in T.allen().items()])


@query(f"""WITH {_V}, i AS (SELECT user_id, event_type, valid_from AS f, valid_to AS t FROM v WHERE valid_to IS NOT NULL) SELECT a.event_type, count(*) AS n FROM i a JOIN i b ON a.event_type = b.event_type AND a.user_id < b.user_id AND a.f < b.t AND b.f < a.t GROUP BY 1""")
def interval_overlap_join(spark, d):
    i = _versions(spark, d).filter("valid_to IS NOT NULL")
    return T.overlap_counts(i, ["event_type"])  # a user's own intervals never overlap


@query(f"""WITH {_V}, i AS (SELECT user_id, event_type, valid_from AS f, valid_to AS t FROM v WHERE valid_to IS NOT NULL) SELECT a.user_id AS ua, b.user_id AS ub, a.f AS a_from, b.f AS b_from FROM i a JOIN i b ON a.event_type = b.event_type AND a.user_id = b.user_id - 1 AND a.f < b.t AND b.f < a.t""")
def interval_pairs(spark, d):
    """The overlapping intervals of neighbouring users themselves."""
    i = _versions(spark, d).filter("valid_to IS NOT NULL")
    a = i.select("event_type", F.col("user_id").alias("u"), F.col("user_id").alias("ua"), F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to"))
    b = i.select("event_type", (F.col("user_id") - 1).alias("u"), F.col("user_id").alias("ub"), F.col("valid_from").alias("b_from"), F.col("valid_to").alias("b_to"))
    return T.overlapping(a, b, ["event_type", "u"], "1 day").select("ua", "ub", "a_from", "b_from")


@query("""SELECT user_id, event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events) GROUP BY user_id, event_type, k""")
def temporal_consecutive(spark, d):
    return T.consecutive(read(spark, d, "events"), ["user_id"], "ts", "event_type")


_KINDS = "(SELECT min(event_type) FROM events)", "(SELECT max(event_type) FROM events)"


@query(f"""SELECT user_id, ts, next_time FROM (SELECT user_id, ts, event_type, lead(event_type) OVER w AS k, lead(ts) OVER w AS next_time FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE event_type = {_KINDS[0]} AND k = {_KINDS[1]} AND next_time <= ts + INTERVAL 6 HOUR""")
def temporal_sequence(spark, d):
    e = read(spark, d, "events")
    a, b = e.agg(F.min("event_type"), F.max("event_type")).first()
    return T.followed(e, ["user_id"], "ts", "event_type", a, b, "6 HOUR")


@query(f"""WITH p AS (SELECT * FROM events WHERE event_type = {_KINDS[0]}), q AS (SELECT * FROM events WHERE event_type = {_KINDS[1]}) SELECT p.event_id, q.ts AS matched_time, q.value AS last_value FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.ts >= q.ts""")
def as_of_join(spark, d):
    e = read(spark, d, "events")
    a, b = e.agg(F.min("event_type"), F.max("event_type")).first()
    left = e.filter(F.col("event_type") == a).select("event_id", "user_id", "ts")
    right = e.filter(F.col("event_type") == b).select("user_id", "ts", F.col("value").alias("last_value"))
    return T.as_of(left, right, ["user_id"], "ts", ["last_value"]).select("event_id", "matched_time", "last_value")
