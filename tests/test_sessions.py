"""Streams with state: sessions in disorder, late rows, sums that wait for each other, claims that expire."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from conftest import rows

from reviewatlas.plans.sessions import ROCKS
from reviewatlas.streaming import jobs, sessions


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, frame, tmp_path):
    def put(records, ddl, name="in"):
        frame(records, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def stream(ddl, name="in"):
        return jobs.read_files(spark, str(tmp_path / name), "parquet", ddl, "*.parquet", per_batch=1)

    return put, stream


POSTS = "author string, post_id string, views bigint, created_at timestamp_ntz"


def test_sessions_merge_and_late_rows_are_counted(spark, tmp_path, feed):
    put, stream = feed
    h = 60
    put([("a", "p1", 5, at(0)), ("a", "p3", 9, at(40 * h)), ("b", "q", None, at(0))], POSTS)
    put([("a", "p2", 7, at(20 * h))], POSTS)  # joins the two runs, in disorder
    put([("a", "p4", 1, at(400 * h))], POSTS)
    run = sessions.stream_bursts(stream(POSTS), str(tmp_path / "out"), str(tmp_path / "check"), "2 days")
    run.awaitTermination()
    assert sessions.late_rows(run) == 0
    want = [("a", at(0), at(40 * h), 3, 21, "p3", 9), ("b", at(0), at(0), 1, None, "q", None)]
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want
    put([("a", "late", 99, at(h)), ("a", "later", 99, at(2 * h)), ("a", "p5", 1, at(900 * h))], POSTS)
    run = sessions.stream_bursts(stream(POSTS), str(tmp_path / "out"), str(tmp_path / "check"), "2 days")
    run.awaitTermination()
    assert sessions.late_rows(run) == 2
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [want[0], ("a", at(400 * h), at(400 * h), 1, 1, "p4", 1), want[1]]


def test_days_of_one_side_come_alone(spark, tmp_path, feed):
    put, stream = feed
    day = 24 * 60
    p, r = "created_at timestamp_ntz", "review_date date"
    put([(at(0),), (at(5),), (at(day),), (at(90 * day),)], p, "posts")
    put([(at(0).date(),), (at(2 * day).date(),), (at(90 * day).date(),)], r, "reviews")
    sessions.stream_volumes(stream(p, "posts"), stream(r, "reviews"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(at(0).date(), 2, 1), (at(day).date(), 1, 0), (at(2 * day).date(), 0, 1)]


def test_claims_expire_and_return(spark, tmp_path, feed):
    put, stream = feed
    ddl = "item string, worker string, action string, at timestamp_ntz"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        def run():
            sessions.stream_claims(stream(ddl), str(tmp_path / "out"), str(tmp_path / "check"), 60, "10 minutes").awaitTermination()

        put([("a", "w2", "claim", at(10)), ("a", "w1", "claim", at(0)), ("b", "w1", "claim", at(0)), ("b", "w1", "done", at(30)), ("c", "w3", "claim", at(5)), (None, "w", "claim", at(1))], ddl)
        run()
        put([("a", "w2", "claim", at(61)), ("a", "w1", "done", at(62)), ("a", "w2", "done", at(70)), ("b", "w2", "claim", at(71)), ("z", "w", "claim", at(300))], ddl)
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")), key=str) == sorted([
        ("a", at(0), "w1", "claimed"), ("a", at(10), "w2", "refused"), ("a", at(60), "w1", "expired"), ("a", at(61), "w2", "claimed"), ("a", at(62), "w1", "refused"),
        ("a", at(70), "w2", "completed"), ("b", at(0), "w1", "claimed"), ("b", at(30), "w1", "completed"), ("b", at(71), "w2", "refused"),
        ("c", at(5), "w3", "claimed"), ("c", at(65), "w3", "expired"), ("z", at(300), "w", "claimed"),
    ], key=str)


def test_a_step_of_a_claim_needs_no_call_for_its_state():
    """Rows of several parts are taken in order, nulls last; a claim ends when the watermark reaches its time, not before."""
    class State:
        exists, get, hasTimedOut, mark, held, until = False, None, False, 0, None, None

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.held = value

        def setTimeoutTimestamp(self, ms):
            self.until = ms

    state, steps = State(), sessions.claim_steps(1000)
    parts = [pd.DataFrame({"ms": ms, "action": ["claim"] * len(ms), "worker": who}) for ms, who in (([50, 10], [None, "b"]), ([10, 50], ["a", "c"]))]
    (out,) = steps(("x",), iter(parts), state)
    assert list(zip(out["worker"], out["step"], strict=True)) == [("a", "claimed"), ("b", "refused"), ("c", "refused"), (None, "refused")]
    assert state.held == ("QUEUED", "a", 1010) and state.until == 1009
    state.exists, state.get, state.hasTimedOut, state.mark = True, state.held, True, 1009
    assert list(steps(("x",), iter([]), state)) == [] and state.held[0] == "QUEUED"
    state.mark = 1010
    (out,) = steps(("x",), iter([]), state)
    assert out["step"].tolist() == ["expired"] and state.held[0] == "PENDING"
