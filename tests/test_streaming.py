from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cohortlake.operators.logs import log_number
from cohortlake.schemas import AUDIT_ENTRY, LAB_EVENT, OUTCOME_EVENT
from cohortlake.session import configure, shared_dir, work_path
from cohortlake.sources.events import read_events
from cohortlake.streaming import batches
from cohortlake.streaming import events as X

START = dt.datetime(2024, 1, 1)


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps(
            {
                "event_id": str(i), "event_type": "lab.results", "patient_id": p,
                "biomarker": "HbA1c", "value": v, "unit": "%",
                "event_time": (START + dt.timedelta(minutes=i)).isoformat(),
            }
        )
        for i, p, v in rows
    ]
    (folder / name).write_text("\n".join(lines))


def stream(spark, folder):
    found = read_events(spark, "json", {"path": str(folder)}, LAB_EVENT)
    return found.withColumns(
        {"topic": F.col("event_type"), "event_id": F.col("event_id").cast("long")}
    )


def run(spark, folder, group, checkpoints, writer):
    query = X.run_group(stream(spark, folder), group, checkpoints, writer)
    query.awaitTermination()
    return query


def test_a_group_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(source, "a.json", [(1, "P1", 7.0), (2, "P2", 9.1)])
    run(spark, source, "g1", state, X.stream_outcomes_sink(out))
    first = spark.read.parquet(out)
    assert {(r.event_id, r.response_class) for r in first.collect()} == {
        (1, "Strong Response"), (2, "No Response"),
    }
    run(spark, source, "g1", state, X.stream_outcomes_sink(out))
    assert spark.read.parquet(out).count() == 2
    drop(source, "b.json", [(3, "P1", 10.0)])
    run(spark, source, "g1", state, X.stream_outcomes_sink(out))
    assert spark.read.parquet(out).count() == 3
    other = str(tmp_path / "other")
    run(spark, source, "g2", state, X.stream_outcomes_sink(other))
    assert spark.read.parquet(other).count() == 3


def test_audit_ids_continue_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    drop(source, "a.json", [(1, "P1", 7.0), (2, "P2", 9.1)])
    run(spark, source, "audit", state, X.audit_sink(out))
    drop(source, "b.json", [(3, "P3", 8.0)])
    run(spark, source, "audit", state, X.audit_sink(out))

    def log():
        rows = spark.read.schema(AUDIT_ENTRY).parquet(out).orderBy(log_number("log_id")).collect()
        return [(r.log_id, r.resource) for r in rows]

    assert log() == [
        ("AUD-0001", "Patient P1 / lab.results"), ("AUD-0002", "Patient P2 / lab.results"),
        ("AUD-0003", "Patient P3 / lab.results"),
    ]
    before = log()
    again = stream_batch(spark, source, "b.json")
    X.audit_sink(out)(again, 1)
    assert log() == before


def stream_batch(spark, folder, name):
    found = read_events(spark, "json", {"path": str(folder / name)}, LAB_EVENT, streaming=False)
    return found.withColumns(
        {"topic": F.col("event_type"), "event_id": F.col("event_id").cast("long")}
    )


def test_latest_values_over_batches(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(source, "a.json", [(1, "P1", 7.0), (5, "P1", 8.0), (2, "P2", 9.0)])
    run(spark, source, "g", state, X.latest_values_sink(out))
    drop(source, "b.json", [(4, "P1", 6.0), (9, "P2", 5.5)])
    run(spark, source, "g", state, X.latest_values_sink(out))
    X.compact_latest(spark, out, str(tmp_path / "compact"))
    got = {r.patient_id: r.value for r in spark.read.parquet(str(tmp_path / "compact")).collect()}
    assert got == {"P1": 8.0, "P2": 5.5}


def test_redelivered_events_are_dropped(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(source, "a.json", [(1, "P1", 7.0), (1, "P1", 7.0), (2, "P2", 9.0)])

    def writer(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    X.run_group(X.without_duplicates(stream(spark, source)), "d", state, writer).awaitTermination()
    drop(source, "b.json", [(2, "P2", 9.0), (3, "P3", 9.0)])
    X.run_group(X.without_duplicates(stream(spark, source)), "d", state, writer).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_streaming_aggregate_of_latest_values(spark, tmp_path):
    source = tmp_path / "in"
    drop(source, "a.json", [(1, "P1", 7.0), (5, "P1", 8.0)])
    query = (
        X.latest_values(stream(spark, source))
        .writeStream.outputMode("complete").format("memory").queryName("latest_mem")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("latest_mem").first().value == 8.0


def test_static_join_and_rematch(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(source, "a.json", [(1, "P1", 7.0), (2, "P1", 8.0)])
    patients = spark.createDataFrame(
        [("P1", 50, "F", "Type 2 Diabetes", ""), ("P2", 50, "F", "Type 2 Diabetes", "")],
        "patient_id string, age int, gender string, conditions string, medications string",
    )
    trials = spark.createDataFrame(
        [("T1", "One", "Phase 3", "Type 2 Diabetes", 18, 75, "ALL")],
        "trial_id string, title string, phase string, condition string, min_age int, max_age int, gender string",
    )
    joined = X.stream_static_join(stream(spark, source), patients)
    assert joined.isStreaming and {"age", "conditions"} <= set(joined.columns)
    X.run_group(X.newest_readings(stream(spark, source)), "m", state, X.rematch_sink(out, patients, trials)).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.patient_id, r.status, r.eligibility_score) for r in rows] == [("P1", "Eligible", 100.0)]


def reading(i, patient, biomarker, value, minute):
    return {
        "event_id": str(i), "event_type": "lab.results", "patient_id": patient, "biomarker": biomarker, "value": value,
        "unit": "", "event_time": (START + dt.timedelta(minutes=minute)).isoformat(),
    }


def world(spark):
    patients = spark.createDataFrame(
        [(p, 50, "F", "Type 2 Diabetes", "") for p in ("P1", "P2", "P3")],
        "patient_id string, age int, gender string, conditions string, medications string",
    )
    trials = spark.createDataFrame(
        [("T1", "One", "Phase 3", "Type 2 Diabetes", 18, 75, "ALL")],
        "trial_id string, title string, phase string, condition string, min_age int, max_age int, gender string",
    )
    return patients, trials


def test_rematch_remembers_readings_and_reads_no_earlier_batch(spark, tmp_path):
    """Batch by batch, with restarts; the folders and records of all but the last are gone."""
    source, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    source.mkdir()
    patients, trials = world(spark)
    batches = [
        [reading(1, "P1", "HbA1c", 8.0, 1)],
        [reading(2, "P2", "HbA1c", 6.0, 2), reading(3, "P1", "BMI", 25.0, 3)],
        [reading(4, "P1", "BMI", 26.0, 4), reading(5, "P2", "HbA1c", 9.0, 0)],
        [reading(6, "P2", "HbA1c", 8.5, 9), reading(7, "P3", "BMI", 30.0, 9), reading(8, "P2", "HbA1c", 8.4, 8)],
    ]
    want = [
        {"P1": "Eligible"}, {"P1": "Eligible", "P2": "Potentially Eligible"},
        # The late reading of P2 is older than the one known.
        {"P1": "Eligible", "P2": "Potentially Eligible"}, {"P2": "Eligible", "P3": "Potentially Eligible"},
    ]
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        events = X.newest_readings(stream(spark, source))
        X.run_group(events, "m", state, X.rematch_sink(str(out), patients, trials)).awaitTermination()
        found = X.read_batches(spark, str(out), None, only=i)
        assert {r.patient_id: r.status for r in found.collect()} == want[i]
        for old in out.glob(f"batch_id={i}/**/*.parquet"):
            old.write_bytes(b"not to be read")
        (out / "_commits" / f"{i}.json").write_text("{}")


def test_newest_readings_of_a_batch(spark, tmp_path):
    """A patient with very many events is a few rows a task; ties go by event id."""
    source = tmp_path / "in"
    source.mkdir()
    rows = [reading(i, "hot", f"B{i % 3}", float(i), i % 50) for i in range(600)] + [reading(900, "P2", "B0", None, 5)]
    rows += [dict(reading(901, "P3", "B0", 1.0, 5), event_time=None), reading(902, None, "B0", 1.0, 5)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    query = X.run_group(
        X.newest_readings(stream(spark, source)), "n", str(tmp_path / "state"), lambda batch, _: got.extend(batch.collect())
    )
    query.awaitTermination()
    want = {}
    for r in rows[:600]:
        key = (r["event_time"], int(r["event_id"]))
        want[r["biomarker"]] = max(want.get(r["biomarker"], (key, 0.0)), (key, r["value"]))
    assert {r.biomarker: r.value for r in got if r.patient_id == "hot"} == {b: v for b, (_, v) in want.items()}
    assert [(r.patient_id, r.event_time, r.event_id) for r in got if r.patient_id != "hot"] == [("P3", None, 901)]


def test_own_labs_stand_in_for_readings(spark, tmp_path):
    patients, trials = world(spark)
    schema = "event_id long, patient_id string, biomarker string, value double, event_time timestamp"
    batch = spark.createDataFrame([(2, "P1", "BMI", 25.0, START)], schema)
    labs = spark.createDataFrame([("P1", "HbA1c", 8.0)], "patient_id string, name string, value double")
    for given, status in ((None, "Potentially Eligible"), (labs, "Eligible")):
        out = str(tmp_path / status)
        X.rematch_sink(out, patients, trials, labs=given)(batch, 0)
        assert X.read_batches(spark, out, None).first().status == status


def test_half_written_batches_are_not_seen(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two, three = (spark.createDataFrame([(i,)], "a int") for i in (1, 2, 3))
    batches.write_batch(one, out, 0, last=5)

    def fails(rows):
        for row in rows:
            if row.a == 2:
                raise RuntimeError("lost")
            yield row

    broken = spark.createDataFrame(one.unionByName(two).rdd.mapPartitions(fails), "a int")
    with pytest.raises(Exception):
        batches.write_batch(broken, out, 1)
    # A whole folder whose record was never written, and a repeat that fails midway.
    two.write.parquet(f"{out}/batch_id=1/run=half")
    with pytest.raises(Exception):
        batches.write_batch(broken, out, 0)
    assert [(r.a, r.batch_id) for r in X.read_batches(spark, out, "a int").collect()] == [(1, 0)]
    assert batches.finished_batches(spark, out) == [0] and batches.batch_record(spark, out, 0)["last"] == 5
    batches.write_batch(three, out, 1)
    batches.write_batch(two, out, 0)
    rows = X.read_batches(spark, out, "a int")
    assert sorted((r.a, r.batch_id) for r in rows.collect()) == [(2, 0), (3, 1)] and rows.columns == ["a", "batch_id"]
    assert [r.a for r in X.read_batches(spark, out, "a int", before=1).collect()] == [2]
    assert X.read_batches(spark, str(tmp_path / "none"), "a int").columns == ["a", "batch_id"]


def test_outcome_event_deltas(spark):
    payload = ("HbA1c", 9.0, None, None, None)
    frame = spark.createDataFrame([("E", "P", "T", "X", payload, "2024-01-01T00:00:00")], OUTCOME_EVENT)
    assert X.outcome_event_deltas(frame).first().delta == -9.0


def test_shared_folder_comes_from_the_session(spark):
    configure(spark)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder and work_path(spark, "x").startswith(folder)
    assert work_path(spark, "x") != work_path(spark, "x")
