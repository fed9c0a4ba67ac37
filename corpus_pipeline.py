"""From raw documents to packed training bins, a Parquet table between any two stages.

`run(spark, sf_dir)` applies the stages to the table `documents`; each takes all rows that the one
before it kept. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import crf, near, packing, suffix
from riskloom.llm.common import stored
from riskloom.session import table

LEAST_SCORE = 0.5  # a text whose best language is less likely than that has no clear one
PASSAGE = 51  # words; op4's 400 bytes alone would leave passages of short words


def aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its own columns of the names that a stage makes under other names, and the way back."""
    longest = max(docs.columns, key=len)  # with it in front, no name that is taken
    moved = {c: f"{longest}_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language; fitted on a bounded sample of labelled ones."""
    model = crf.fit_on(docs, "text", "lang")
    if not model.labels:
        return docs.where(F.lit(False))
    rows, back = aside(docs, ["lang_pred", "score"])
    named = crf.predict(rows, model, keep_text=True)
    clear = named.where((F.col("lang_pred") != crf.UNDEFINED) & (F.col("score") >= LEAST_SCORE))
    return clear.drop("lang_pred", "score").withColumnsRenamed(back).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each component of texts alike by 0.8 in their 5-word shingles."""
    return near.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of over 50 words, or of 400 bytes, that occur again; characters cut in half at an edge go as well."""
    rows, back = aside(docs, suffix.RESULT)
    kept = suffix.remove_repeats(rows, as_text=True, passage=PASSAGE)
    kept = kept.withColumn("text", F.col("kept")).drop(*suffix.RESULT).withColumnsRenamed(back)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words that hold no source and no duplicate cluster twice."""
    return packing.pack(stored(packing.sizes(docs), "sizes"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("pack", pack)]
ORACLE_SQL = None  # a random field and a repeat search aren't SQL; tests hold the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
