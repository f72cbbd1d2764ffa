r"""Line dedup: repeated runs of lines, found by distributed prefix doubling, and their later copies deleted.

A text's lines that are not blank (not only spaces) form its sequence; blank lines are always kept. Suffixes of
the sequences are ranked by prefix doubling: at depth d two suffixes have the same rank if their first d lines
are equal, and the rank is named by the first place (doc_id, text hash, line) that has it. Depth 1 ranks the
lines by 128 bits of hash; depth d + s comes from the pairs (rank at i, rank at i + s), s <= d. Suffixes alone in their class
are settled and drop out of all further rounds; doubling goes on until all are settled. The classes at depth d are the
intervals of the suffix array with common prefixes of d lines or more: each is a run of lines with all its copies, and the
overlapping runs of a text join to its maximal repeated runs.

A run counts from ``MIN_LINES`` lines on, or from ``MIN_CHARS`` characters on where it is shorter. All lines of a run that has an equal
one at an earlier place are deleted, and nothing else.

Only DataFrame functions. Lines are grouped with partial aggregates; classes are written to the shared folder
and joined back, so that a very frequent line is a skewed join that Spark can split. Line text never moves;
whole texts move once, to meet the numbers of their deleted lines.

Cases: null texts are kept as null; rows equal in doc_id and text are one place, so none is a later copy of the
other; rows that share a doc_id but not the text are apart; a null doc_id stands before all others; the empty
table gives no rows; other columns pass through (names starting with ``_ld_`` are the operator's own).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

MIN_LINES, MIN_CHARS = 3, 250
KEY = ["_ld_doc", "_ld_text"]
PLACE = [*KEY, "seq"]


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_ld_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_ld_text": F.xxhash64("text")})


def _sequence(text: Column) -> Column:
    """Array of (line number, line) of the lines that are not blank."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("p"), line.alias("line")))
    return F.filter(numbered, lambda x: F.length(F.trim(x["line"])) > 0)


def _classes(rows: DataFrame, by: list[str], folder: str) -> DataFrame:
    """The classes of two or more places, named by the first."""
    return stored(rows.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")).filter("first <> last").drop("last"), folder)


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ld_doc, _ld_text, gone): the places in its sequence of each text's deleted lines, in order."""
    folder = shared_dir(docs.sparkSession)
    lines = _keys(docs).filter(F.col("text").isNotNull()).select(*KEY, F.posexplode(_sequence(F.col("text"))).alias("seq", "x"))
    lines = lines.select(*PLACE, F.length("x.line").alias("chars"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit("line"), "x.line").alias("h2"))
    found = lines.join(_classes(lines, ["h1", "h2"], f"{folder}/classes-1"), ["h1", "h2"])
    at = Window.partitionBy(*KEY).orderBy("seq")
    depth, gone = 1, []
    found = found.select(*PLACE, "chars", F.col("chars").alias("size"), F.col("first").alias("rank")).dropDuplicates(PLACE)
    while True:
        found = stored(found, f"{folder}/ranks-{depth}")
        if found.isEmpty():
            break
        counts = F.lit(True) if depth >= min_lines else F.col("size") >= min_chars
        gone.append(found.filter(counts & (F.col("rank") != F.struct(*PLACE))).select(*KEY, F.explode(F.sequence("seq", F.col("seq") + (depth - 1))).alias("seq")))
        step = min(2 * depth, min_lines) - depth if depth < min_lines else depth
        pairs = found.select(
            *PLACE, "chars", "rank", F.sum("chars").over(at.rowsBetween(0, depth + step - 1)).alias("size"),
            F.lead("rank", step).over(at).alias("rank2"), F.lead("seq", step).over(at).alias("seq2"),
        ).filter(F.col("seq2") == F.col("seq") + step)
        depth += step
        pairs = stored(pairs, f"{folder}/pairs-{depth}")
        classes = _classes(pairs, ["rank", "rank2"], f"{folder}/classes-{depth}")
        found = pairs.join(classes, ["rank", "rank2"]).select(*PLACE, "chars", "size", F.col("first").alias("rank"))
    rows = reduce(DataFrame.unionByName, gone) if gone else lines.select(*KEY, "seq").limit(0)
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_set("seq")).alias("gone"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with ``_ld_gone``, the deleted places, and ``_ld_kept``, the text without them."""
    rows = _keys(docs).join(gone.withColumnRenamed("gone", "_ld_gone"), KEY, "left").withColumn("_ld_gone", F.coalesce("_ld_gone", F.array().cast("array<int>")))
    lines, places = F.split("text", "\n"), _sequence(F.col("text"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("_ld_gone", lambda s: F.get(places, s)["p"]))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    return rows.withColumn("_ld_kept", F.when(F.size("_ld_gone") == 0, F.col("text")).otherwise(kept))


def line_deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the kept lines as text; with ``drop_emptied``, texts that lost lines and have none left but blank ones go."""
    rows = _without(docs, deleted_lines(docs, min_lines, min_chars))
    if drop_emptied:
        rows = rows.filter((F.size("_ld_gone") == 0) | F.col("_ld_kept").rlike(r"[^ \n]"))
    new = {"text": F.col("_ld_kept")} | ({"n_chars": F.when(F.size("_ld_gone") == 0, F.col("n_chars")).otherwise(F.length("_ld_kept").cast("long"))} if "n_chars" in docs.columns else {})
    return rows.select([new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, kept_md5) of each document: its lines, those deleted, the maximal runs of these, the
    lines of the longest, and what is kept; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _without(docs, deleted_lines(docs))
    gone = F.col("_ld_gone")
    starts = F.filter(gone, lambda s, i: (i == 0) | (s != F.get(gone, i - 1) + 1))
    ends = F.filter(gone, lambda s, i: (i == F.size(gone) - 1) | (s != F.get(gone, i + 1) - 1))
    longest = F.coalesce(F.array_max(F.zip_with(starts, ends, lambda a, b: b - a + 1)), F.lit(0))
    counts = {"n_lines": F.size(F.split("text", "\n")), "n_removed": F.size(gone), "n_runs": F.size(starts), "longest_run": longest}
    return rows.select("doc_id", *[v.cast("long").alias(k) for k, v in counts.items()], F.md5(F.col("_ld_kept").cast("binary")).alias("kept_md5"))


OP1_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM split),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS seq FROM l WHERE length(trim(line)) > 0),
w AS (SELECT *, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
k AS (SELECT doc_id, seq, 1 AS depth, line AS run FROM w WHERE length(line) >= {MIN_CHARS} UNION ALL SELECT doc_id, seq, 2, line || chr(10) || l2 FROM w WHERE length(line) + length(l2) >= {MIN_CHARS}
      UNION ALL SELECT doc_id, seq, 3, line || chr(10) || l2 || chr(10) || l3 FROM w WHERE l3 IS NOT NULL),
f AS (SELECT depth, run, min(struct_pack(doc_id := doc_id, seq := seq)) AS first FROM k GROUP BY depth, run),
g AS (SELECT DISTINCT k.doc_id, unnest(range(k.seq, k.seq + k.depth)) AS seq FROM k JOIN f ON k.run = f.run AND k.depth = f.depth WHERE struct_pack(doc_id := k.doc_id, seq := k.seq) <> f.first),
r AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM (SELECT doc_id, count(*) AS n FROM (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM g) GROUP BY doc_id, run) GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) FILTER (g.seq IS NULL) AS kept
      FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.p = l.p LEFT JOIN g ON g.doc_id = s.doc_id AND g.seq = s.seq GROUP BY l.doc_id)
SELECT split.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, md5(coalesce(kept, '')) AS kept_md5
FROM split LEFT JOIN r ON r.doc_id = split.doc_id LEFT JOIN t ON t.doc_id = split.doc_id
"""
