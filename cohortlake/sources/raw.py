"""Raw CSV and lake tables as typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import columns as C
from cohortlake.schemas import TABLES, TableSchema

PANDAS_NULLS = ("", "None", "nan")


def coerce(c: Column, to: T.DataType) -> Column:
    if isinstance(to, T.LongType):
        return C.to_long(c)
    if isinstance(to, T.DoubleType):
        return C.to_double(c)
    if isinstance(to, T.BooleanType):
        return C.to_bool(c)
    return c.cast("string")


def coerce_types(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Declared columns with declared types: missing ones and bad values become null."""
    present = set(df.columns)
    declared = {
        n: (coerce(F.col(n), t) if n in present else F.lit(None).cast(t))
        for n, t in schema.columns
    }
    return df.withColumns(declared)


def read_raw(
    spark: SparkSession,
    path: str,
    schema: TableSchema,
    null_tokens: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """A CSV read as text and coerced.

    By default an empty text field stays an empty string, so it is not a missing
    required value; ``null_tokens`` names texts to read as null instead.
    """
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    if null_tokens:
        cleaned = {
            c: F.when(~F.col(c).isin(*null_tokens), F.col(c)) for c in text.columns
        }
    else:
        cleaned = {c: F.coalesce(F.col(c), F.lit("")) for c in text.columns}
    return coerce_types(text.withColumns(cleaned), schema)


def read_raw_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def with_ingest_metadata(df: DataFrame, source: str | None = None) -> DataFrame:
    """Load time and source file of every row; needs a file scan unless a source is given."""
    file = F.col("_metadata.file_path") if source is None else F.lit(source)
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_file": file})


def with_transform_time(df: DataFrame) -> DataFrame:
    return df.withColumn("_transformed_at", F.current_timestamp())


def _complete(columns: Sequence[str], empty_is_null: bool) -> Column:
    test = F.lit(True)
    for c in columns:
        present = F.col(c).isNotNull()
        if empty_is_null:
            present = present & (F.trim(F.col(c).cast("string")) != "")
        test = test & present
    return test


def require(
    df: DataFrame,
    columns: Sequence[str],
    empty_is_null: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Rows with all required values.

    An ``Observation`` receives ``rows_in`` and ``rows_kept`` of the next action, so
    counting costs no second pass.
    """
    kept = _complete(columns, empty_is_null)
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(kept).alias("rows_kept"),
        )
    return df.where(kept)


def required_report(
    df: DataFrame, columns: Sequence[str], empty_is_null: bool = False
) -> DataFrame:
    """One row: rows read, kept and dropped by ``require``."""
    total, kept = F.count(F.lit(1)), F.count_if(_complete(columns, empty_is_null))
    return df.agg(
        total.alias("rows_in"), kept.alias("rows_kept"), (total - kept).alias("rows_dropped")
    )


def _try_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _try_raw(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return read_raw(spark, path, TABLES[name], PANDAS_NULLS)
    except AnalysisException:
        return None


def read_table(spark: SparkSession, lake: str, name: str, layer: str = "bronze") -> DataFrame:
    """The Parquet of a layer, else the raw CSV, else an empty frame of the schema."""
    found = _try_parquet(spark, f"{lake}/{layer}/{name}.parquet")
    if found is None:
        found = _try_raw(spark, f"{lake}/raw/{name}.csv", name)
    if found is None:
        found = spark.createDataFrame([], TABLES[name].struct)
    return found


def read_fact(spark: SparkSession, lake: str) -> DataFrame:
    """The silver fact, else silver outcomes, else raw outcomes joined to patients."""
    for name in ("patient_outcomes", "outcomes"):
        found = _try_parquet(spark, f"{lake}/silver/{name}.parquet")
        if found is not None:
            return found
    people = read_table(spark, lake, "patients", "raw").select(
        "patient_id", "gender", "age", "conditions"
    )
    return read_table(spark, lake, "outcomes", "raw").join(people, "patient_id", "left")
