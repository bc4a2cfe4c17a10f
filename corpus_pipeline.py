"""The training-data pipeline: five stages over ``documents``, each on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one.  All but the last return the columns of
``documents``; the last returns the mix: a row per document and epoch with the text given.

Null and empty texts go through every stage but the last, which has no tokens to take from
them; of several such rows the second stage keeps one, as they are copies of each other.
Rows that repeat an id are judged each for itself, an empty table gives an empty result, and
further columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from cohortlake.llm.common import remove, stored_at, table
from cohortlake.llm.queries import half_of_all, mix_levels


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    Repeated rows stay or go together; rows without an id or a text are scored like others."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (4-word shingles, 4 bits) the row with the least doc_id.

    Null ids come last; texts without words are one group; of equal rows one stays."""
    return simhash.drop_near_copies(docs, shingle=4, radius=4)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has.

    Rows of one id do not count against each other; null texts stay null."""
    kept = suffix_dedup.without_repeats(docs, least=50)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text; texts without words hold none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), short=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half the tokens left, by domain, language and source, two epochs at most.

    A document without a language or source is in the leaf ``(none)``."""
    return mixing.mixed_texts(docs, mix_levels(), half_of_all(), seed=7, max_epochs=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near copies", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mix", mix_stage),
]

# The field of the first stage is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
