"""Electronic health record export: seven CSV files to patient records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.operators.records import distinct_sorted
from cohortlake.operators.skew import sequence_numbers

# Columns used of each file of an export.
FILES = {
    "patients": ("Id", "BIRTHDATE", "DEATHDATE", "GENDER"),
    "conditions": ("PATIENT", "DESCRIPTION"),
    "medications": ("PATIENT", "DESCRIPTION"),
    "allergies": ("PATIENT", "DESCRIPTION"),
    "observations": ("DATE", "PATIENT", "DESCRIPTION", "VALUE", "UNITS"),
    "procedures": ("DATE", "START", "PATIENT", "DESCRIPTION"),
    "encounters": ("START", "PATIENT", "ENCOUNTERCLASS", "DESCRIPTION"),
}


class MissingExportFile(ValueError):
    """The export has no patients file."""


@dataclass(frozen=True)
class EhrExport:
    """Patients with their short lists, and the open-ended lists as long tables.

    A patient's conditions, medications and allergies are bounded by vocabulary.
    Observations, procedures and encounters are not, so they stay rows; ``nested``
    turns them into arrays of bounded length.
    """

    patients: DataFrame
    observations: DataFrame
    procedures: DataFrame
    encounters: DataFrame

    def nested(self, max_items: int = 10_000) -> DataFrame:
        """Patients with nested lists.

        Every item is kept.  A patient with more than ``max_items`` of a kind spans
        several rows, told apart by ``part``; everyone else has the one row, part 0.
        """
        lists = {
            "observations": (self.observations, ("name", "value", "unit")),
            "procedures": (self.procedures, ("name", "date")),
            "encounters": (self.encounters, ("type", "date")),
        }
        base = self.patients.withColumn("part", F.lit(0).cast("long"))
        parts = {n: _parts(df, cols, n, max_items) for n, (df, cols) in lists.items()}
        keys = base.select("external_id", "part")
        for df in parts.values():
            keys = keys.unionByName(df.select("external_id", "part"))
        result = keys.distinct().join(self.patients, "external_id")
        for name, df in parts.items():
            result = result.join(df, ["external_id", "part"], "left")
            empty = F.array().cast(df.schema[name].dataType)
            result = result.withColumn(name, F.coalesce(name, empty))
        return result


def _parts(df: DataFrame, columns: tuple[str, ...], name: str, max_items: int) -> DataFrame:
    digest = F.md5(F.to_json(F.struct(*columns)))
    day = F.coalesce(F.substring("date", 1, 10), F.lit(""))
    numbered = sequence_numbers(
        df,
        "_n",
        order=[day, digest],
        groups=["external_id"],
        start=0,
    )
    return (
        numbered.withColumn("part", F.floor(F.col("_n") / max_items).cast("long"))
        .groupBy("external_id", "part")
        .agg(F.collect_list(F.struct("_n", *columns)).alias("_items"))
        .select(
            "external_id",
            "part",
            F.transform(
                F.array_sort("_items"), lambda i: F.struct(*[i[c].alias(c) for c in columns])
            ).alias(name),
        )
    )


def _described(df: DataFrame) -> DataFrame:
    return df.where(~C.blank("PATIENT") & ~C.blank("DESCRIPTION"))


def normalize_patients(
    rows: DataFrame,
    conditions: DataFrame,
    medications: DataFrame,
    allergies: DataFrame,
    as_of: Column,
) -> DataFrame:
    """One record per patient row with an id and a readable birth date."""
    valid = rows.where(~C.blank("Id") & C.to_date("BIRTHDATE").isNotNull())
    result = valid.select(
        F.col("Id").alias("external_id"),
        C.normalize_gender("GENDER").alias("gender"),
        F.col("BIRTHDATE").cast("string").alias("birth_date"),
        C.age_at("BIRTHDATE", "DEATHDATE", as_of).alias("age"),
        F.lit("ehr").alias("source"),
    )
    lists = {"conditions": conditions, "medications": medications, "allergies": allergies}
    for name, df in lists.items():
        named = distinct_sorted(_described(df), "PATIENT", "DESCRIPTION", name)
        result = result.join(named.withColumnRenamed("PATIENT", "external_id"), "external_id", "left")
        result = result.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return result


def normalize_observations(rows: DataFrame) -> DataFrame:
    """Numeric observations only; text results are dropped."""
    value = C.to_double("VALUE")
    return _described(rows).where(value.isNotNull()).select(
        F.col("PATIENT").alias("external_id"),
        F.trim("DESCRIPTION").alias("name"),
        value.alias("value"),
        F.nullif("UNITS", F.lit("")).alias("unit"),
        F.col("DATE").cast("string").alias("date"),
    )


def normalize_procedures(rows: DataFrame) -> DataFrame:
    return _described(rows).select(
        F.col("PATIENT").alias("external_id"),
        F.trim("DESCRIPTION").alias("name"),
        F.coalesce(F.nullif("DATE", F.lit("")), F.nullif("START", F.lit(""))).alias("date"),
    )


def normalize_encounters(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(
        F.nullif("ENCOUNTERCLASS", F.lit("")), F.nullif("DESCRIPTION", F.lit(""))
    )
    return rows.where(~C.blank("PATIENT") & ~C.blank(kind)).select(
        F.col("PATIENT").alias("external_id"),
        F.trim(kind).alias("type"),
        F.nullif("START", F.lit("")).alias("date"),
    )


def _read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    columns = FILES[name]
    try:
        # A byte-order mark in front of the first column name is dropped.
        found = spark.read.option("header", True).option("escape", '"').csv(
            f"{directory}/{name}.csv"
        )
        found = found.toDF(*[c.lstrip("\ufeff") for c in found.columns])
    except AnalysisException:
        if name == "patients":
            raise MissingExportFile(f"required file not found: {directory}/{name}.csv") from None
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return found.select(
        *[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def load_ehr_export(
    spark: SparkSession, directory: str, as_of: Column | None = None
) -> EhrExport:
    """Normalise an export directory; only patients.csv is required."""
    t = {name: _read(spark, directory, name) for name in FILES}
    patients = normalize_patients(
        t["patients"],
        t["conditions"],
        t["medications"],
        t["allergies"],
        F.current_date() if as_of is None else as_of,
    )
    return EhrExport(
        patients,
        normalize_observations(t["observations"]),
        normalize_procedures(t["procedures"]),
        normalize_encounters(t["encounters"]),
    )
