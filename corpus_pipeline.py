"""The corpus pipeline: documents in, training mix out.

Each stage is one operator of strider.llm and works on all that its predecessor kept, written as Parquet in between:
language ID (documents without a language, or of doubtful one, go), MinHash near-dedup (one document of each group
stays), suffix-array dedup (bytes that repeat an earlier document go), benchmark decontamination (documents that hold a
test item go) and mixing (words to take from each document).

Defined cases are those of the operators; a stage returns the columns of its input, extra ones included, and rows that
share a doc_id stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm import decontam, langid, mixing, neardup, substrings
from strider.llm.common import fresh, quoted, table
from strider.storage import remove, scratch, shared_dir, written

#: The least posterior of a document's language.
MIN_SCORE = 0.5


def _columns(df: DataFrame) -> list[str]:
    return [quoted(c) for c in df.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known with at least MIN_SCORE; the label column is not looked at for that."""
    lang, score, n_words = fresh(docs, *langid.ADDED)
    scored = langid.predict(docs, langid.train(docs), (lang, score, n_words))
    return scored.where((F.col(lang) != langid.UND) & (F.col(score) >= MIN_SCORE)).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes bytes out that repeat a document with a smaller id; documents of which nothing is left go."""
    return substrings.without_repeats(docs).where("text IS NOT NULL AND text <> ''").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    hit = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Capped water-filling over what is left: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(mixing.sized(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language scoring, sketches and block-max retrieval are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # a stage's own tables go with it, and so does its input
            docs = written(stage(spark, docs, sf_dir), f"{out}/{i}")
        remove(spark, f"{out}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
