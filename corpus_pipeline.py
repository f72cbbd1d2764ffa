"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid_cnn, line_dedup, near_dedup, tiling
from tessera.llm.common import held_out, shared_dir, stored, table

LEAST_MARGIN = 0.1  # of the way from chance, one of as many as there are languages, to certainty


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose most likely language is hardly likelier than by chance, go.

    Null texts have no letter. Repeated rows get equal verdicts; extra columns, ``lang_pred`` and ``score`` too, pass through;
    null ids are like others. Without any labelled row nothing can be told, and no document stays."""
    model = langid_cnn.fit_languages(docs, ~held_out("doc_id", 3, 1))
    told = langid_cnn.identify(docs, model, rows=True)
    n = len(model.langs) if model else 1
    least = (1 + LEAST_MARGIN * (n - 1)) / n if n > 1 else 0.0
    return told.filter((told["lang_pred"] != "und") & (told["score"] >= least)).select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents of which nothing is left.

    Null and blank texts stay as they are; rows equal in doc_id and text are one place and stay both; a null doc_id stands before
    all others; extra columns pass through, and n_chars follows the text."""
    return line_dedup.line_deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: that of least doc_id, null last, and of rows equal in doc_id and text one.

    Null, empty and wordless texts are alone in their class and stay; extra columns pass through."""
    return near_dedup.deduplicated(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of equal doc_id and text alike.

    Null and empty texts, and items of fewer than five words, match nothing; extra columns pass through."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; a null text is empty, a null doc_id stays null, other columns go."""
    return bpe.byte_bpe(docs, *bpe.public_ranks(), tokens=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", contaminated),
    ("byte_bpe", token_ids),
]
ORACLE_SQL = None  # models, sampling and merges are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{k}-{name}")
    return docs
