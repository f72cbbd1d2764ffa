r"""Repetition coverage: how much of a text stands inside repeated n-grams and repeated lines.

Everything is measured within one text, so the operator is a single map over Arrow batches: no shuffle, and
memory bounded by a chunk of about a megabyte of texts (one text alone if it is longer).

Words are maximal runs of characters outside ``[\x20\x09-\x0D]``. For n = 2..10 the window hashes of all words
are rolled in numpy; a window counts as repeated when it is found twice or more in its text, the first
occurrence included. Longer windows are searched only where the window one word shorter is repeated.
The verdict compares the characters (code points of words) inside repeated n-grams, n = 5..10, those inside
the most frequent n-gram, n = 2..4, and the share of repeated lines, with the limits of ``LIMITS``.

Cases: null and empty texts have no words and fail the base rule; ties are symmetric; repeated rows are
judged one by one; extra columns are ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, keyed, table
from .textnum import U, WORD_BASE, Chunk, buffers, chunks, mix

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Published limits of this family of rules: share of characters in the top n-gram (2-4), in repeated n-grams (5-10), in repeated lines, and of repeated lines.
LIMITS = {"top": {2: 0.20, 3: 0.18, 4: 0.16}, "dup": {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}, "line_chars": 0.20, "lines": 0.30}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " dup_line_share double, dup_line_char_share double, top_ngram_share double, dup_ngram_share double"
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def measure(c: Chunk, limits: dict = LIMITS) -> dict[str, np.ndarray]:
    """The columns after doc_id for each text of a chunk."""
    docs = len(c.off) - 1
    start, end, first = c.words
    n_words = np.diff(first)
    chars = c.chars[end] - c.chars[start]
    char_sum = np.zeros(len(start) + 1, np.int64)
    np.cumsum(chars, out=char_sum[1:])
    word_chars = char_sum[first[1:]] - char_sum[first[:-1]]
    symbols = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(SYMBOL[c.data], out=symbols[1:])
    n_symbols = symbols[c.off[1:]] - symbols[c.off[:-1]]

    a, b, line_doc = c.lines
    words_before = np.searchsorted(start, np.stack([a, b]))
    full = np.flatnonzero(words_before[1] > words_before[0])
    key = mix(c.spans(a[full], b[full]) + line_doc[full].astype(U) * WORD_BASE)
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(full), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup = full[later]
    n_dup_lines = np.bincount(line_doc[dup], minlength=docs)
    n_full_lines = np.bincount(line_doc[full], minlength=docs)
    dup_line_chars = np.bincount(line_doc[dup], char_sum[words_before[1][dup]] - char_sum[words_before[0][dup]], docs)

    top_share, dup_share, n_repeat_words = np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64)
    failed = (_share(n_dup_lines, n_full_lines) > limits["lines"]) | (_share(dup_line_chars, word_chars) > limits["line_chars"])
    rolled, doc = c.word_hash, c.word_doc
    last = np.repeat(first[1:], n_words)
    at = np.arange(len(start))
    h = rolled + doc.astype(U) * U(0xE7037ED1A0B428DB)  # a window counts within its text only
    for n in range(2, 11):
        fits = at + n <= last[at]
        at = at[fits]
        h = h[fits] * WORD_BASE + rolled[at + n - 1]
        if not len(at):
            break
        order = np.argsort(mix(h))
        hs = h[order]
        edge = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        count = np.diff(np.concatenate([edge, [len(hs)]]))
        if n <= 4 and (twice := count > 1).any():
            some = at[order[edge[twice]]]
            covered = (char_sum[some + n] - char_sum[some]) * count[twice]  # overlaps of a phrase with itself count each time
            most = np.zeros(docs)
            np.maximum.at(most, doc[some], covered)
            share = _share(most, word_chars)
            top_share = np.maximum(top_share, share)
            failed |= share > limits["top"][n]
        again = np.zeros(len(at), bool)
        again[order] = np.repeat(count > 1, count)
        at, h = at[again], h[again]
        if n >= 5 and len(at):
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            share = _share(np.bincount(doc[inside], chars[inside], docs), word_chars)
            dup_share = np.maximum(dup_share, share)
            failed |= share > limits["dup"][n]
            if n == 8:
                n_repeat_words = np.bincount(doc[inside], minlength=docs)
    base_failed = (n_words < 20) | (100 * n_repeat_words > 30 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "base_failed": base_failed, "kept": ~base_failed & ~failed, "dup_line_share": _share(n_dup_lines, n_full_lines),
        "dup_line_char_share": _share(dup_line_chars, word_chars), "top_ngram_share": top_share, "dup_ngram_share": dup_share,
    }


def repetition_rules(docs: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Counts, shares and verdict for each row of ``docs`` (doc_id, text)."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(c, limits) for _, _, c in chunks(*buffers(b.column("text")))]
        cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols.values())], names=["doc_id", *cols])

    return arrow_map(keyed(docs), kernel, SCHEMA)


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def sql(limits: dict = LIMITS) -> str:
    """The same rows in DuckDB."""
    grams = ", ".join(
        f"""g{n} AS (SELECT doc_id, i, c, CASE WHEN m = {n} THEN x END AS x, CASE WHEN m = {n} THEN s END AS s FROM (SELECT doc_id, i, c, count(*) OVER o AS m, string_agg(word, ' ') OVER o AS x, sum(c) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))),
n{n} AS (SELECT doc_id, i, c, s, CASE WHEN x IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, x) END AS k FROM g{n}),
f{n} AS (SELECT doc_id, max(CASE WHEN k > 1 THEN s * k ELSE 0 END) AS top, sum(CASE WHEN hit > 1 THEN c ELSE 0 END) AS inside, count(*) FILTER (hit > 1) AS words FROM (SELECT *, max(k) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM n{n}) GROUP BY doc_id)"""
        for n in range(2, 11)
    )
    share = lambda x: f"coalesce(CAST({x} AS DOUBLE) / word_chars, 0.0)"
    return rf"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, length(unnest(ws)) AS c FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, line, p, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
d AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (nth > 1) AS dup, coalesce(sum(list_sum([length(x) FOR x IN ws])) FILTER (nth > 1), 0) AS dup_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS nth FROM l WHERE len(ws) > 0) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_words, sum(c) AS word_chars FROM w GROUP BY doc_id), {grams},
a AS (SELECT o.doc_id, coalesce(t.n_words, 0) AS n_words, CAST(coalesce(t.word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(o.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.dup, 0) AS n_dup_lines, coalesce(f8.words, 0) AS n_repeat_words,
coalesce(CAST(d.dup AS DOUBLE) / d.lines, 0.0) AS dup_line_share, {share('d.dup_chars')} AS dup_line_char_share, greatest({', '.join(share(f'f{n}.top') for n in limits['top'])}) AS top_ngram_share, greatest({', '.join(share(f'f{n}.inside') for n in limits['dup'])}) AS dup_ngram_share,
{' OR '.join([f"{share(f'f{n}.top')} > {x}" for n, x in limits['top'].items()] + [f"{share(f'f{n}.inside')} > {x}" for n, x in limits['dup'].items()])} AS bad
FROM documents o LEFT JOIN t ON t.doc_id = o.doc_id LEFT JOIN d ON d.doc_id = o.doc_id {' '.join(f'LEFT JOIN f{n} ON f{n}.doc_id = o.doc_id' for n in range(2, 11))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR bad OR dup_line_share > {limits['lines']} OR dup_line_char_share > {limits['line_chars']}) AS kept, dup_line_share, dup_line_char_share, top_ngram_share, dup_ngram_share FROM a
"""


OP6_SQL = sql()
