"""Unreadable messages and lines are kept apart, counted, and lose no readable one."""

from __future__ import annotations

from pyspark.sql import Observation

from rideflow.operators import rejects
from rideflow.operators.cleaning import parse_clean_rides
from rideflow.schemas import RIDE_COLUMNS
from rideflow.sources import topics
from rideflow.streaming import jobs

FINE = '{"ride_id":"a","started_at":"2024-01-05 09:00:00","start_lat":"1.5","start_station_id":"S"}'
MESSAGES = {
    FINE: None,
    '{"ride_id":"b","started_at":"None"}': None,
    "{}": None,
    '{"ride_id":"c","started_at"': "not json",
    "": "not json",
    "[1, 2]": "not json",
    "plain text": "not json",
    '{"ride_id":"d","ended_at":"tomorrow"}': "ended_at",
    '{"ride_id":"e","start_lng":"12,5"}': "start_lng",
    '{"ride_id":"f","started_at":"?","end_lat":"?"}': "started_at",
}


def test_messages_are_split_in_one_pass(spark, tmp_path):
    sent = spark.createDataFrame([(m,) for m in MESSAGES] + [(None,)], "value string")
    judged = rejects.judged_rides(sent.selectExpr("cast(value as binary) value", "0 as partition"))
    size = Observation()
    fine, bad = rejects.split_to(rejects.counted(judged, size), str(tmp_path / "judged"))
    assert fine.columns == list(RIDE_COLUMNS) and fine.count() == 3
    want = {m: r for m, r in MESSAGES.items() if r} | {None: "not json"}
    assert {r.value: r.reason for r in bad.collect()} == want
    assert "partition" in bad.columns
    assert size.get == {"read": 11, "rejected": 8}


def test_lines_are_split(spark, tmp_path):
    path = tmp_path / "rides.csv"
    good = "r1,classic_bike,2024-01-05 09:00:00,2024-01-05 09:10:00,A,S1,B,S2,38.5,-77.25,38.75,-77.5,member"
    lines = [good, good.replace("r1", "r2") + ",more", "r3,too,few", good.replace("38.5", "north"),
             good.replace("2024-01-05 09:00:00", "late"), good.replace("r1", "r6").replace("S1", "")]
    path.write_text("\n".join([",".join(RIDE_COLUMNS), *lines]) + "\n")
    fine, bad = rejects.split_to(rejects.judged_ride_file(spark, str(path)), str(tmp_path / "out"))
    assert sorted(r.ride_id for r in fine.collect()) == ["r1", "r6"]
    assert sorted(r.value for r in bad.collect()) == sorted(lines[1:5])
    assert {(r.batch, r.reason) for r in bad.collect()} == {("rides.csv", "unreadable line")}


def test_a_stream_keeps_what_it_rejects(spark, tmp_path):
    topic, target, bad = (str(tmp_path / n) for n in ("topic", "clean", "bad"))
    for batch in range(2):
        sent = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
        topics.publish(sent, topic, topics.RAW_PARTITION, batch)
        query = jobs.clean_stream(spark, topic, target, str(tmp_path / "check"), rejects=bad)
        query.awaitTermination()
        found = query.lastProgress["observedMetrics"]["parsed"]
        assert (found["read"], found["rejected"]) == (10, 7)
    clean = parse_clean_rides(topics.read_topic(spark, target, topics.CLEAN_PARTITION))
    assert [r.ride_id for r in clean.collect()] == ["a", "a"]
    kept = spark.read.parquet(bad)
    assert kept.count() == 14 and {r.batch for r in kept.collect()} == {"0", "1"}
