"""Segments of steps and the stop rule on state, against a plain loop."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialwright.session import scratch_path
from trialwright.streaming import live, steps


def plain(scores, n, threshold=None):
    """(iteration, best) of the first stop; iterations count from 1."""
    best, held = None, 0
    for i, s in enumerate(scores, 1):
        if s is None:
            continue
        if best is None or s > best:
            best, held = s, 1
        else:
            held += 1
        if held >= n or (threshold is not None and best >= threshold):
            return i, best
    return None


def through_segments(pieces, n, threshold):
    best, held, last = None, 0, -1
    for batch in pieces:
        found = [live.pack(np.array([i for i, _ in p], np.int64), np.array([np.nan if s is None else s for _, s in p], float)) for p in batch if p]
        for segment in live.joined(found, last):
            best, held, at = live.advance(best, held, segment, n, threshold)
            last = segment["last"]
            if at is not None:
                return at, best
    return None


@given(st.lists(st.one_of(st.none(), st.integers(0, 6).map(float)), max_size=40), st.integers(1, 8), st.one_of(st.none(), st.integers(2, 7).map(float)), st.data())
@settings(max_examples=300, deadline=None)
def test_any_cut_into_batches_and_segments(scores, n, threshold, data):
    """Batches come in order; inside one, steps are dealt to tasks anyhow, and some old steps come again."""
    rows, batches, at = list(enumerate(scores, 1)), [], 0
    while at < len(rows):
        size = data.draw(st.integers(1, 15))
        fresh = rows[at:at + size]
        repeated = rows[max(0, at - data.draw(st.integers(0, 4))):at]
        tasks = data.draw(st.integers(1, 3))
        dealt = [[] for _ in range(tasks)]
        for row in repeated + fresh:
            dealt[data.draw(st.integers(0, tasks - 1))].append(row)
        batches.append(dealt)
        at += size
    assert through_segments(batches, n, threshold) == plain(scores, n, threshold)


def test_busy_run_is_packed_by_many_tasks(spark):
    log = spark.range(1, 50_001).select(F.lit("busy").alias("run"), F.col("id").alias("iter"), (F.col("id") % 997).cast("double").alias("score")).repartitionByRange(6, "iter")
    got = live.segments(log, 1000).collect()
    assert len(got) >= 50 and sum(r["scored"] for r in got) == 50_000 and max(r["scored"] for r in got) <= 1000
    # A segment says where the best rose: the merge reads these few numbers and not the steps.
    assert max(len(r["rise_at"]) for r in got) <= 8 * 1000
    source, out = scratch_path(spark, "steps"), scratch_path(spark, "stops")
    log.write.json(source)
    steps.live_stop(spark.readStream.schema("run string, iter long, score double").json(source), 600, out).awaitTermination()
    assert [tuple(r) for r in steps.read_stops(spark, out).collect()] == [("busy", 1595, 996.0)]


def test_restart_and_null_runs(spark):
    source, out = scratch_path(spark, "steps"), scratch_path(spark, "stops")
    schema = "run long, iter long, score double"
    data = {None: [1, 3, 2, 2, 4, 1, 1, 1], 7: [1, 2, 3, 4, 5, 5, 5, 5], 8: [None, None, 1, 2, 3, 4, 5, 6]}
    log = spark.createDataFrame([(r, i, None if s is None else float(s)) for r, ss in data.items() for i, s in enumerate(ss, 1)], schema)
    for lo, hi in ((1, 3), (2, 4), (5, 6), (7, 8)):
        log.where(F.col("iter").between(lo, hi)).coalesce(1).write.mode("append").json(source)
        steps.live_stop(spark.readStream.schema(schema).json(source), 3, out).awaitTermination()
    got = sorted(map(tuple, steps.read_stops(spark, out, "bigint").collect()), key=str)
    want = [(r, *plain([None if s is None else float(s) for s in ss], 3)) for r, ss in data.items() if plain(ss, 3)]
    assert got == sorted(want, key=str) and len(got) == 2


def test_silent_runs_are_forgotten(spark):
    source, out = scratch_path(spark, "steps"), scratch_path(spark, "stops")
    schema = "run string, iter long, score double"
    part = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0)], schema).coalesce(1)
    part.write.mode("append").json(source)
    query = steps.live_stop(spark.readStream.schema(schema).json(source), 3, out, forget_minutes=0.01, processingTime="1 second")
    try:
        until = time.time() + 40
        seen = lambda: sum(p["numInputRows"] for p in query.recentProgress)
        for want in (2, 4):
            while seen() < want and time.time() < until:
                time.sleep(0.2)
            assert seen() == want
            time.sleep(4)
            part.withColumn("iter", F.col("iter") + 2).write.mode("append").json(source) if want == 2 else None
    finally:
        query.stop()
    # The state of a had gone, so its later steps were its first ones again.
    assert steps.read_stops(spark, out).count() == 0
    with pytest.raises(ValueError):
        steps.live_stop(spark.readStream.schema(schema).json(source), 3, out, forget_minutes=1, availableNow=True)


def test_bad_types_are_refused(spark):
    with pytest.raises(Exception):
        live.stops(spark.createDataFrame([(1,)], "x long"), 3)


def test_small_batches_make_one_segment_a_run(spark):
    log = spark.range(1, 1001).select((F.col("id") % 2).alias("run"), F.col("id").alias("iter"), F.col("id").cast("double").alias("score")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = live.segments(log).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r["run"], r["first"], r["last"], r["scored"]) for r in got) == [(0, 2, 1000, 500), (1, 1, 999, 500)]


def test_steps_in_sets_of_files(spark, monkeypatch, rows):
    from trialwright.queries import QUERIES, streams

    one = rows(QUERIES["q_live_stop_files"](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(streams, "FILE_STEPS", 200)
    assert rows(QUERIES["q_live_stop_files"](spark, "/root/testdata/sf0.001")) == one and one
