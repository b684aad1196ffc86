import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import label as L
from ticketloom.plans import model_queries as Q
from ticketloom.plans.views import ticket_view
from ticketloom.session import work_path
from ticketloom.streaming import backfill as B
from ticketloom.streaming import jobs as J


def _files(spark, sf_dir, name):
    """The ticket view as a folder of several files."""
    path = work_path(spark, name)
    view = ticket_view(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    view.repartition(4).write.parquet(path)
    return path, spark.read.parquet(path)


def test_stream_equals_batch_and_reruns_add_nothing(spark, sf_dir):
    path, batch = _files(spark, sf_dir, "test-stream")
    out = work_path(spark, "test-stream-out")
    for _ in range(2):
        stream = J.stream_messages(spark, path, batch.schema, max_files=1)
        landed = J.run_available(J.stream_label(stream, "event_id"), f"{out}/data", f"{out}/checkpoint")
    want = J.stream_label(batch, "event_id")
    assert sorted(map(str, landed.collect())) == sorted(map(str, want.collect()))
    # One row per text of the stream result is the batch job's text set.
    texts = {r[0] for r in L.process_messages(batch, "event_id").select("clean_text").collect()}
    assert {r["clean_text"] for r in landed.select("clean_text").collect()} == texts


def test_stream_dedupe_drops_repeats_across_batches(spark, sf_dir):
    path, batch = _files(spark, sf_dir, "test-dedupe")
    out = work_path(spark, "test-dedupe-out")
    stream = J.stream_messages(spark, path, batch.schema, max_files=1).filter("text is not null").select("ts", "text")
    landed = J.run_available(J.stream_dedupe(stream, "text", "ts", "60 days"), f"{out}/data", f"{out}/checkpoint")
    assert landed.count() == batch.select("text").filter("text is not null").distinct().count()


def test_closed_windows_equal_batch(spark, sf_dir):
    path, batch = _files(spark, sf_dir, "test-monitor")
    out = work_path(spark, "test-monitor-out")
    stream = J.stream_messages(spark, path, batch.schema)
    landed = J.run_available(
        J.stream_monitor(stream, "ts", "truth", "prediction", "confidence"), f"{out}/data", f"{out}/checkpoint"
    )
    whole = J.stream_monitor(batch, "ts", "truth", "prediction", "confidence")
    rows, all_rows = {tuple(r) for r in landed.collect()}, {tuple(r) for r in whole.collect()}
    assert rows <= all_rows and len(rows) >= len(all_rows) - 1


def test_window_drift_counts_unknown_classes(spark):
    counts = spark.createDataFrame([("w1", "a", 5), ("w1", "b", 5), ("w2", "c", 4)], "window_start string, category string, n long")
    reference = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "category string, share double")
    got = {r["window_start"]: (r["drift_score"], r["drift"]) for r in J.window_drift(counts, reference).collect()}
    assert got == {"w1": (0.0, False), "w2": (1.0, True)}


def test_foreach_batch_drift(spark, sf_dir):
    path, batch = _files(spark, sf_dir, "test-foreach")
    seen = []
    on_batch = J.foreach_batch_drift(batch, "truth", lambda df, epoch: seen.append(df.first()["drift_score"]))
    stream = J.stream_messages(spark, path, batch.schema)
    query = stream.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", work_path(spark, "test-foreach-cp")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [0.0]


def test_a_backfill_of_many_unsorted_files_loses_no_row(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(1000, F.desc("ts")).write.parquet(f"{tmp_path}/events.parquet")
    files = sorted(Path(tmp_path, "events.parquet").glob("part-*"))
    assert len(files) > 900
    # The newest events are in the oldest files, so that they would be read first.
    for k, file in enumerate(files):
        os.utime(file, (1_700_000_000 + k,) * 2)
    for query in (Q.stream_monitor, Q.stream_drift, Q.stream_dedupe):
        one, many = (sorted(map(tuple, query(spark, d).collect()), key=str) for d in (sf_dir, str(tmp_path)))
        assert len(one) == len(many) and one, query.__name__
        # Means of the same rows in another order differ in the last place.
        assert all(a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b) for x, y in zip(one, many, strict=True) for a, b in zip(x, y, strict=True))


def test_a_backfill_that_loses_rows_fails(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    path = f"{tmp_path}/events"
    events.repartitionByRange(4, F.desc("ts")).write.parquet(path)
    for k, file in enumerate(sorted(Path(path).glob("part-*"))):
        os.utime(file, (1_700_000_000 + k,) * 2)
    stream = J.stream_messages(spark, path, events.schema, max_files=1).withColumn("c", F.lit("a"))
    with pytest.raises(ValueError, match="late rows"):
        J.run_available(J.stream_class_counts(stream, "ts", "c"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", backfill=True)


ROWS = [(1, "2024-01-02 10:00:00", "b"), (2, "2024-01-01 10:00:00", "b"), (3, "2024-01-01 10:00:00", "a"), (4, "2024-01-01 10:00:00", "b"),
        (5, "2024-01-05 00:00:00", "a"), (6, None, "c"), (7, "2024-01-05 23:00:00", None), (8, "2024-01-01 23:59:59", None)]


def _timed(spark, rows):
    return spark.createDataFrame(rows, "id long, at string, text string").withColumn("at", F.col("at").cast("timestamp"))


@pytest.mark.parametrize("max_rows", [1, 4, 100])
def test_replay_hands_whole_ranges_on_in_order(spark, tmp_path, max_rows):
    rows = _timed(spark, ROWS)
    backfill = B.Backfill(rows, "at", 86_400, f"{tmp_path}/rows")
    assert list(backfill.counts.values()) == [4, 1, 2]
    seen = []

    def handle(batch, earlier):
        # The batch itself, and how many rows were there before it.
        seen.append(sorted(r["id"] for r in batch.collect()))
        return batch.select("id", F.lit(0 if earlier is None else earlier.count()).alias("before"))

    got = {r["id"]: r["before"] for r in backfill.replay(f"{tmp_path}/out", handle, max_rows=max_rows).collect()}
    batches = {1: [[2, 3, 4, 8], [1], [5, 7]], 4: [[2, 3, 4, 8], [1, 5, 7]], 100: [[1, 2, 3, 4, 5, 7, 8]]}[max_rows]
    # The first call learns the schema from no rows.
    assert seen == [[], *batches]
    assert got == {i: sum(map(len, batches[:k])) for k, b in enumerate(batches) for i in b}


def test_replay_goes_on_after_a_failure(spark, tmp_path):
    rows, calls = _timed(spark, ROWS), []

    def handle(batch, earlier):
        ids = sorted(r["id"] for r in batch.collect())
        calls.append(ids)
        if ids == [1] and len(calls) < 4:
            raise RuntimeError("lost")
        return batch.select("id")

    with pytest.raises(RuntimeError):
        B.Backfill(rows, "at", 86_400, f"{tmp_path}/rows").replay(f"{tmp_path}/out", handle, max_rows=1)
    again = B.Backfill(rows, "at", 86_400, f"{tmp_path}/rows").replay(f"{tmp_path}/out", handle, max_rows=1)
    assert calls == [[], [2, 3, 4, 8], [1], [], [1], [5, 7]]
    assert sorted(r["id"] for r in again.collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_replay_leaves_open_ranges_to_the_stream(spark, tmp_path):
    backfill = B.Backfill(_timed(spark, ROWS), "at", 86_400, f"{tmp_path}/rows")
    got = backfill.replay(f"{tmp_path}/out", lambda batch, _: batch.select("id"), delay=3600)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 8]
    nothing = B.Backfill(_timed(spark, ROWS[5:6]), "at", 86_400, f"{tmp_path}/none")
    assert nothing.replay(f"{tmp_path}/none-out", lambda batch, _: batch.select("id"), delay=3600).count() == 0


@pytest.mark.parametrize("max_rows", [1, 4, 100])
def test_first_copy_does_not_depend_on_batches(spark, tmp_path, max_rows):
    backfill = B.Backfill(_timed(spark, ROWS).repartition(3), "at", 86_400, f"{tmp_path}/rows")
    got = backfill.replay(f"{tmp_path}/out", B.first_copies("text", "at", "id"), max_rows=max_rows)
    assert {r["text"]: r["id"] for r in got.collect()} == {"b": 2, "a": 3, None: 8}
    assert got.count() == 3


def test_truth_that_arrives_late(spark, tmp_path):
    predictions = _timed(spark, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 01:00:00", "b"), (3, "2024-01-01 02:00:00", "c"),
                                 (4, "2024-01-05 00:00:00", "d")])
    # In time, too late, never, not yet.
    truth = _timed(spark, [(1, "2024-01-01 20:00:00", "A"), (2, "2024-01-03 00:00:00", "B"), (9, "2024-01-05 00:00:00", "X")])
    truth = truth.select("id", F.col("at").alias("known_at"), F.col("text").alias("truth"))
    for name, df in (("p", predictions), ("t", truth)):
        df.write.parquet(f"{tmp_path}/{name}")
    p, t = (J.stream_messages(spark, f"{tmp_path}/{n}", df.schema) for n, df in (("p", predictions), ("t", truth)))
    joined = J.stream_truth(p, t, "id", "at", "known_at", "24 hours")
    landed = J.run_available(joined, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {(r["id"], r["truth"]) for r in landed.collect()} == {(1, "A"), (2, None), (3, None)}
    batch = J.stream_truth(predictions, truth, "id", "at", "known_at", "24 hours")
    assert {(r["id"], r["truth"]) for r in batch.collect()} == {(1, "A"), (2, None), (3, None), (4, None)}
