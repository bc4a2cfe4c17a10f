from __future__ import annotations

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortlake.schemas import AUDIT_ENTRY, LAB_EVENT, RUN_RECORD, TABLES
from cohortlake.sinks import tables as sinks
from cohortlake.sources import documents, ehr, events, raw


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_read_raw_adds_and_coerces_columns(spark, tmp_path):
    path = write(
        tmp_path / "patients.csv",
        "patient_id,gender,age,extra\nP1,F,34,x\nP2,,old,y\n,M,50,z\nP4,M,7.0,\n",
    )
    rows = raw.read_raw(spark, path, TABLES["patients"]).orderBy("age").collect()
    assert {r.patient_id for r in rows} == {"P1", "P2", "", "P4"}
    assert sorted((r.age for r in rows if r.age is not None)) == [7, 34, 50]
    assert all(r.allergies is None and "extra" in r.asDict() for r in rows)


def test_an_empty_required_text_survives_by_default(spark, tmp_path):
    path = write(tmp_path / "patients.csv", "patient_id,gender,age\nP1,F,34\nP2,,41\nP3,M,\n")
    frame = raw.read_raw(spark, path, TABLES["patients"])
    required = TABLES["patients"].required
    assert {r.patient_id for r in raw.require(frame, required).collect()} == {"P1", "P2"}
    strict = raw.require(frame, required, empty_is_null=True)
    assert {r.patient_id for r in strict.collect()} == {"P1"}
    assert raw.required_report(frame, required).first().asDict() == {
        "rows_in": 3, "rows_kept": 2, "rows_dropped": 1,
    }


def test_require_reports_through_an_observation(spark, tmp_path):
    seen = Observation("require")
    frame = spark.createDataFrame([(1,), (None,)], "a int")
    assert raw.require(frame, ["a"], observation=seen).count() == 1
    assert seen.get == {"rows_in": 2, "rows_kept": 1}


def test_null_tokens(spark, tmp_path):
    path = write(
        tmp_path / "outcomes.csv",
        "outcome_id,patient_id,trial_id,outcome_type,adverse_events,treatment_completed,change\n"
        "O1,P1,T1,HbA1c,None,true,-1.5\nO2,P1,T1,HbA1c,Nausea,0,bad\n",
    )
    kept = raw.read_raw(spark, path, TABLES["outcomes"])
    assert [r.adverse_events for r in kept.orderBy("outcome_id").collect()] == ["None", "Nausea"]
    nulled = raw.read_raw(spark, path, TABLES["outcomes"], raw.PANDAS_NULLS).orderBy("outcome_id")
    got = [(r.adverse_events, r.treatment_completed, r.change) for r in nulled.collect()]
    assert got == [(None, True, -1.5), ("Nausea", False, None)]


def test_inferred_read_and_metadata(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b\n1,x\n")
    frame = raw.with_transform_time(raw.with_ingest_metadata(raw.read_raw_inferred(spark, path)))
    row = frame.first()
    assert row.a == 1 and row._source_file.endswith("t.csv") and row._transformed_at is not None


def test_read_table_falls_back_to_raw_then_empty(spark, tmp_path):
    lake = tmp_path
    (lake / "raw").mkdir()
    write(lake / "raw" / "trials.csv", "trial_id,title\nT1,One\n")
    assert raw.read_table(spark, str(lake), "trials").first().title == "One"
    assert raw.read_table(spark, str(lake), "medications").count() == 0
    sinks.write_table(
        raw.read_table(spark, str(lake), "trials").withColumn("title", F.lit("Two")),
        str(lake), "bronze", "trials",
    )
    assert raw.read_table(spark, str(lake), "trials").first().title == "Two"


EXPORT = {
    "patients": "Id,BIRTHDATE,DEATHDATE,GENDER\np1,1950-06-01,2020-06-01,M\np2,1981-03-10,,F\n"
    ",1990-01-01,,F\np3,someday,,F\np4,1990-01-01,,\n",
    "conditions": "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION\n,,p2,,1,Type 2 Diabetes Mellitus\n"
    ",,p2,,1,Asthma\n,,p2,,1,Asthma\n,,p1,,1, \n",
    "observations": "DATE,PATIENT,ENCOUNTER,CATEGORY,CODE,DESCRIPTION,VALUE,UNITS,TYPE\n"
    "2024-01-02,p2,,,1,HbA1c,8.2,%,numeric\n2024-01-01,p2,,,1,Smoker,Never,,text\n"
    "2024-01-01,p2,,,1,BMI,28.4,kg/m2,numeric\n2024-01-03,p2,,,1,HbA1c,8.0,,numeric\n",
    "encounters": "Id,START,STOP,PATIENT,ENCOUNTERCLASS,CODE,DESCRIPTION\n"
    "e1,2024-01-01,,p2,ambulatory,1,Visit\ne2,2024-01-02,,p2,,1,Check up\n",
}


def export_dir(tmp_path, names=EXPORT):
    for name in names:
        write(tmp_path / f"{name}.csv", EXPORT[name], "utf-8-sig")
    return str(tmp_path)


def test_ehr_export(spark, tmp_path):
    found = ehr.load_ehr_export(spark, export_dir(tmp_path), F.lit("2024-06-15").cast("date"))
    people = {r.external_id: r for r in found.patients.collect()}
    assert set(people) == {"p1", "p2", "p4"}
    assert (people["p1"].age, people["p1"].gender) == (70, "male")
    assert people["p4"].gender == "unknown"
    assert people["p2"].conditions == ["Asthma", "Type 2 Diabetes Mellitus"]
    assert people["p1"].conditions == [] and people["p2"].medications == []
    readings = {(r.name, r.value, r.unit) for r in found.observations.collect()}
    assert readings == {("HbA1c", 8.2, "%"), ("BMI", 28.4, "kg/m2"), ("HbA1c", 8.0, None)}
    assert {(r.type, r.date) for r in found.encounters.collect()} == {
        ("ambulatory", "2024-01-01"), ("Check up", "2024-01-02"),
    }
    assert found.procedures.count() == 0


def test_nested_records_keep_every_item(spark, tmp_path):
    found = ehr.load_ehr_export(spark, export_dir(tmp_path), F.lit("2024-06-15").cast("date"))
    whole = {r.external_id: r for r in found.nested().collect()}
    assert [o.value for o in whole["p2"].observations] == [28.4, 8.2, 8.0]
    assert whole["p1"].observations == [] and whole["p2"].part == 0
    split = [r for r in found.nested(max_items=2).collect() if r.external_id == "p2"]
    assert sorted((r.part, len(r.observations), len(r.encounters)) for r in split) == [
        (0, 2, 2), (1, 1, 0),
    ]


def test_ehr_export_needs_patients(spark, tmp_path):
    with pytest.raises(ehr.MissingExportFile):
        ehr.load_ehr_export(spark, str(tmp_path))
    only = ehr.load_ehr_export(spark, export_dir(tmp_path, ["patients"]))
    assert only.patients.count() == 3 and only.observations.count() == 0


def test_documents_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Aged 18\xff to 75\nnext")
    row = documents.read_documents(spark, str(tmp_path)).first()
    assert (row.doc_id, row.text) == ("a.txt", "Aged 18 to 75\nnext")


def test_json_logs(spark, tmp_path):
    entries = [{"log_id": "AUD-0002", "user": "a"}, {"log_id": "AUD-0001", "details": "d"}]
    path = write(tmp_path / "log.json", json.dumps(entries, indent=2))
    rows = documents.read_json_log(spark, path, AUDIT_ENTRY).collect()
    assert [(r.log_id, r.user, r.details) for r in rows] == [
        ("AUD-0002", "a", None), ("AUD-0001", None, "d"),
    ]
    runs = [{"run_id": "r", "dag_id": "d", "duration_ms": 1.5, "tasks": [{"task_id": "t"}]}]
    path = write(tmp_path / "runs.json", json.dumps(runs))
    assert documents.read_json_log(spark, path, RUN_RECORD).first().tasks[0].task_id == "t"


def test_layer_inventory(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    write(tmp_path / "raw" / "a.csv", "x" * 1024 * 1024)
    write(tmp_path / "raw" / "skip.txt", "y")
    got = {r.layer: r for r in documents.layer_inventory(spark, str(tmp_path)).collect()}
    assert (got["raw"].files, got["raw"].size_mb, got["raw"].health) == (1, 1.0, "HEALTHY")
    assert got["gold"].health == "EMPTY" and len(got) == 4


def test_messages_are_decoded(spark):
    value = json.dumps({"event_id": "E1", "patient_id": "P1", "biomarker": "HbA1c", "value": 7.5})
    sent = spark.createDataFrame(
        [(b"P1", "lab.results", 0, 1001, value.encode())],
        "key binary, topic string, partition int, offset long, value binary",
    )
    row = events.parse_messages(sent, LAB_EVENT).first()
    assert (row.msg_key, row.offset, row.event_id, row.value) == ("P1", 1001, "E1", 7.5)


def test_export_json_and_append(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a")], "id int, t string")
    sinks.export_json(frame, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().t == "a"
    sinks.append_table(frame, str(tmp_path / "log"))
    sinks.append_table(frame, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
