"""A corpus pipeline of five stages: language, near copies, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a frame with the columns of
``documents``; the last returns token ids. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import copies, decontaminate, language, queries, repeats
from threadloom.llm.arrow_text import together
from threadloom.plans.scratch import cut, scope


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that language identification rejects: no letter, or no language above the calibrated threshold.

    So null and empty texts go; very long ones are judged whole. Repeated rows stay or go together. The model is learned
    from the labelled rows of ``docs`` itself; where there are none (an empty table too) every row goes, as none can be told.
    Other columns of any name stay.
    """
    found = language.identify(docs, queries.language_model(docs))
    return found.where(~F.col("rejected")).select(together(docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id.

    Texts link by SimHash, as ``op9_simhash`` links them (fingerprints within 2 bits, compared by tiles), and, where that sees too little,
    by a five-word Jaccard of 0.8 or more. A group is what links of both kinds reach.
    Of rows that share that id the text's hash decides, and of rows equal in id and text one stays. A null id comes after
    all others. Null and empty texts are copies of each other; a text shorter than a shingle is one shingle; very long ones
    are compared whole. An empty table stays empty; other columns of any name stay.
    """
    return copies.drop_near_copies(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a text that loses nothing stays as it is, and no row goes.

    ``n_chars`` follows the text (null or not) where it loses something. A text of nothing but repeated passages is empty
    afterwards. Null texts stay null, empty and short ones as they are; repeated rows are copies like any two texts; very long
    texts are done whole. An empty table stays empty; other columns of any name stay, and a table without ``n_chars`` gets none.
    """
    found = repeats.without_repeats(docs, as_is=True)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
        found = found.withColumn("row", F.col("row").withField("n_chars", chars))
    return found.select(together(docs.columns, text=F.col("kept")))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a window of a benchmark item occurs.

    Null and empty texts have no window and stay; very long ones are searched whole; repeated rows stay or go together. An empty
    benchmark drops nothing, an empty table stays empty, and other columns of any name stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests.

    Null and empty texts have no tokens and the digests of nothing; very long texts are encoded whole; repeated rows give
    equal rows, a null id a row with a null id. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    return queries.token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", one_of_each),
    ("repeats", no_repeats),
    ("leaks", no_leaks),
    ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is freed once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope() as kept:
            docs = cut(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier of the first stage has no SQL form; tests hold the rows against brute force instead.
ORACLE_SQL = None
