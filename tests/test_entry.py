from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connection

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"[a-z]\d\d_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", n) for n in names)
    assert len(names) > 120


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the shared test tables")
def test_flagship(spark):
    result = entry.entry(spark)
    assert result.count() > 0 and "response_rate" in result.columns


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the shared test tables")
@pytest.mark.parametrize(
    "name",
    [
        "a05_trial_kpis", "a14_trial_performance", "a16_medication_effectiveness",
        "a22_data_quality_report", "d10_non_response_analysis", "m04_match_patients",
        "n03_similar_patients", "t06_extract_criteria", "k03_to_event_messages",
    ],
)
def test_agrees_with_sql(spark, name):
    result = compare(
        spark, connection(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert result.startswith("ok"), result
