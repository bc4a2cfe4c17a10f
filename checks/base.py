"""Pairs of a Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.sources.projection import ClinicalViews, view_sql

# Doubles are compared at this many decimals in both engines.  The nudge moves means
# that end in an exact 5 off the tie, which the engines would break differently.
DECIMALS = 6
NUDGE = 3.1e-8


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, views: str = "", sql: str | None = None):
        """Decorator: register ``f(views)`` and the SQL over the named clinical views."""

        def wrap(f: Callable[[ClinicalViews], DataFrame]):
            assert name not in self.queries, name
            self.queries[name] = lambda spark, sf_dir: settle(f(ClinicalViews(spark, sf_dir)))
            if sql is not None:
                self.oracles[name] = with_views(views, sql)
            return f

        return wrap


def with_views(views: str, sql: str) -> str:
    parts = [f"{v} AS (\n{view_sql(v)}\n)" for v in views.split()]
    body = sql.strip()
    if not parts:
        return body
    head = "WITH " + ",\n".join(parts)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body


def settle(df: DataFrame) -> DataFrame:
    """Round doubles, so that the order of a sum does not show."""
    doubles = {n: F.round(F.col(n) + NUDGE, DECIMALS) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def r6(expression: str) -> str:
    return f"round(cast({expression} AS DOUBLE) + cast({NUDGE} AS DOUBLE), {DECIMALS})"


# SQL fragments shared by the oracles.
POSITIVE = "response_status IN ('Strong Response', 'Moderate Response')"


def sql_list(column: str) -> str:
    bare = f"regexp_replace(coalesce({column}, ''), '[\\[\\]''\"]', '', 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({bare}, '[|,]'),"
        " lambda x: trim(x)), lambda x: x <> '')"
    )
